"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the passages of toxic texts that ordinary text does not explain
(runs of bytes whose 5-grams several toxic texts of the sample hold and no ordinary one), so that it holds what sets toxic text apart. Every window of a
text is compressed twice: with the ordinary dictionary alone, and with the toxic one in front of it. Ordinary passages match at the same
distances either way, so the difference of the two lengths is what the toxic dictionary explains. A logistic curve over the differences of a
stretch of windows gives its score, and the best of the overlapping stretches that cover the text gives the text's. The curve is fitted on the best
stretches of sample texts that trained no dictionary and shifted to the share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import bounded_sample, held_out, slices
from gridpanel.llm.logistic import fit_logistic, sigmoid

WINDOW, SLACK, LEVEL, GRAM = 64, 24, 9, 5
TOXIC_BYTES, ORDINARY_BYTES = 2048, 8192
STRETCH = 32  # windows that are scored together; stretches overlap by half
REFITS = 5  # rounds of choosing the best stretches and fitting on them
# The fit reads about so many labelled texts of a class, whole ones.
SAMPLE_ROWS = 2000
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
RECURRING = 0.01  # share of the toxic texts that must hold an n-gram, two texts at least
STRONG = 4  # bytes that a window must save to count as strong evidence


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    center: tuple
    scale: tuple
    weights: tuple  # the last is the intercept


def windows(text: str) -> list[bytes]:
    """The whole lower-cased text in windows of about ``WINDOW`` bytes that end before a space where one is near."""
    data, out, start = text.lower().encode("utf-8", "surrogatepass"), [], 0
    while start < len(data):
        stop = start + WINDOW
        if stop < len(data) and (gap := data.find(b" ", stop, stop + SLACK)) >= 0:
            stop = gap
        out.append(data[start:stop])
        start = stop
    return out or [b""]


def _grams(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | codes[i : i + len(out)]
    return out


def _recurring(texts: list[bytes], known: np.ndarray) -> np.ndarray:
    """The 5-grams outside ``known`` that several of the texts hold."""
    each = [g[~np.isin(g, known)] for g in (np.unique(_grams(t)) for t in texts)]
    found, counts = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)
    return found[counts >= max(2, RECURRING * len(texts))]


def _passages(data: bytes, wanted: np.ndarray) -> bytes:
    """The runs of ``data`` that consist of 5-grams of ``wanted``."""
    new = np.isin(_grams(data), wanted)
    covered = np.zeros(len(data) + 1, np.int8)
    for i in range(GRAM):
        covered[i : i + len(new)] |= new
    edge = np.flatnonzero(np.diff(covered, prepend=0))
    return b" ".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=False))


def _dictionary(samples: list[bytes], size: int, segment: int, dmer: int) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=dmer).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return b" ".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(texts: list[str], ordinary: bytes, toxic: bytes) -> list[np.ndarray]:
    """One array for each text, with a row for each of its stretches; ordinary windows beside others add nothing and take nothing away."""
    alone, both = _compressor(ordinary).compress, _compressor(toxic + ordinary).compress
    out = []
    for text in texts:
        saved = np.array([max(0, len(alone(w)) - len(both(w))) for w in windows(text)])
        last = max(0, len(saved) - STRETCH)
        parts = [saved[a : a + STRETCH] for a in (*range(0, last, STRETCH // 2), last)]
        out.append(np.array([(p.sum() / STRETCH, np.sort(p)[-3:].sum() / 3, (p >= STRONG).sum() / STRETCH) for p in parts]))
    return out


def _best(x: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The row of each array that ``weights`` (of the plain features) put first."""
    return np.array([a[np.argmax(a @ weights)] for a in x]).reshape(len(x), 3)


def _scores(texts: list[str], model: Model) -> np.ndarray:
    weights = np.array(model.weights)
    best = _best(features(texts, model.ordinary, model.toxic), weights[:-1] / np.array(model.scale))
    return sigmoid((best - np.array(model.center)) / np.array(model.scale) @ weights[:-1] + weights[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out; label, lang, source and id of a document never enter a score."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    drawn = F.broadcast(bounded_sample(known, ["toxic"], SAMPLE_ROWS, 7))  # bounded by its parameter
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(drawn, "doc_id")
    rows = sorted((r["toxic"], r["doc_id"], r["text"]) for r in sample.collect())
    groups = {c: [t for k, _, t in rows if k == c] for c in (0, 1)}
    fold = {c: [t.lower().encode("utf-8", "surrogatepass") for i, t in enumerate(groups[c]) if i % 3] for c in groups}
    grams = [np.unique(_grams(t)) for t in fold[0]]
    seen = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
    ordinary = _dictionary([w for t in fold[0] for w in windows(t.decode("utf-8", "surrogatepass"))], ORDINARY_BYTES, 64, 8)
    wanted = _recurring(fold[1], seen)
    toxic = _dictionary([_passages(t, wanted) for t in fold[1]], TOXIC_BYTES, 16, 6)
    texts = [(t, c) for c in groups for i, t in enumerate(groups[c]) if i % 3 == 0]
    x = features([t for t, _ in texts], ordinary, toxic)
    y = np.array([c for _, c in texts], float)
    ranks = np.array([1.0, 0.0, 0.0])  # the mean saving chooses first
    for _ in range(REFITS):
        center, scale, weights = fit_logistic(_best(x, ranks), y)
        ranks = weights[:-1] / scale
    if min(counts.get(0, 0), counts.get(1, 0)) and 0 < y.sum() < len(y):  # from the shares of the sample to those of the labels
        weights[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(ordinary, toxic, tuple(center), tuple(scale), tuple(weights))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            score = _scores([t or "" for t in batch.column("text").to_pylist()], model)
            kept = [n for n in batch.schema.names if n != "text" or batch.schema.names.count("text") > 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(score)], names=[*kept, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every row; null counts as empty. Repeated rows score alike; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), f"doc_id {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``. Without labels of both classes all scores are alike."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keeper(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            s = _scores([t or "" for t in batch.column("text").to_pylist()], model)
            yield batch.filter(pa.array(s < threshold))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in one narrow pass."""
    return docs.mapInArrow(_keeper(fit(docs, labels), threshold), docs.schema)
