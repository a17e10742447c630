"""Language identification by bit-sliced Bloom filters of n-grams.

One table of words holds the Bloom filters of all languages: bit l of a word belongs to language l, and the words that an n-gram hashes to, taken
together by AND, are the mask of the languages that contain it. Per-language counts of set bits over all n-grams of a text, corrected for the
false positives that the fill of a language's slice makes expected, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import bounded_sample, held_out
from gridpanel.llm.shingles import mix
from gridpanel.llm.token_counts import _classes

SIZES, HASHES, SLOTS = (3, 4), 3, 8
# Counting reads about so many texts of a language; a language contains an n-gram whose share of its n-grams is at least RATE (so at most 1 / RATE
# n-grams of a size) and no less than an eighth of the largest share of any language.
SAMPLE_ROWS, RATE, RELATIVE = 1500, 2e-5, 1 / 8
MODULUS, HELD_OUT = 3, 1
PART = 1_000_000


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: np.ndarray  # slots x (languages / 64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the letters of ``texts`` (other characters are one blank), the text of each, and whether a text has letters."""
    code = np.frombuffer("\n".join(" " + t.lower() + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, end = _classes()[code] == 1, code == 10
    # a line feed inside a text is a blank as well; the joints are known by their places
    joint = np.zeros(len(code), bool)
    joint[(np.cumsum([len(t.lower()) + 3 for t in texts]) - 1)[:-1]] = True
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = letter | joint | np.append(True, letter[:-1])  # the first of a run of blanks
    code, joint, letter = code[keep], joint[keep], letter[keep]
    owner = np.cumsum(joint)
    out, owners = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = max(0, len(code) - n + 1)
            h = np.full(m, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : i + m]
            whole = owner[:m] == owner[n - 1 : n - 1 + m]
            whole &= ~joint[:m]
            out.append(mix(h[whole]))
            owners.append(owner[:m][whole])
    return np.concatenate(out), np.concatenate(owners), np.bincount(owner[letter], minlength=len(texts)) > 0


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            texts = part["text"].tolist()
            for i in range(0, len(texts), 200):
                found, counts = np.unique(grams(texts[i : i + 200])[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": found.view(np.int64), "n": counts})


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of rows that are not held out and have a lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, HELD_OUT))
    sample = bounded_sample(known.select("doc_id", "lang", "text"), ["lang"], SAMPLE_ROWS, 5).select("lang", "text")
    counts = sample.mapInPandas(_counter, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where((F.col("rate") >= RATE) & (F.col("n") > 1))
    best = rates.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("l"), F.max("rate").alias("top"))
    kept = best.select("gram", F.transform(F.filter("l", lambda x: x["rate"] >= F.col("top") * RELATIVE), lambda x: x["lang"]).alias("langs")).collect()
    languages = tuple(sorted({x for r in kept for x in r["langs"]}))
    words = np.zeros((max(64, SLOTS * len(kept)), -(-max(1, len(languages)) // 64)), np.uint64)
    number = {x: i for i, x in enumerate(languages)}
    at = _slots(np.array([r["gram"] for r in kept], np.int64).view(np.uint64), len(words))
    for i, r in enumerate(kept):
        for lang in r["langs"]:
            w, b = divmod(number[lang], 64)
            words[at[:, i], w] |= np.uint64(1) << np.uint64(b)
    return Model(languages, words)


def _slots(gram: np.ndarray, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = mix(gram) | np.uint64(1)
        return np.stack([((gram + np.uint64(i) * step) % np.uint64(m)).astype(np.int64) for i in range(HASHES)])


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    found, owner, lettered = grams(texts)
    total = np.bincount(owner, minlength=len(texts))
    at = _slots(found, len(model.words))
    votes = np.zeros((len(texts), len(model.languages)))
    for w in range(model.words.shape[1]):
        mask = model.words[at[0], w]
        for i in range(1, HASHES):
            mask &= model.words[at[i], w]
        for i in range(w * 64, min(len(model.languages), w * 64 + 64)):
            bit = np.uint64(1) << np.uint64(i % 64)
            false = ((model.words[:, w] & bit) != 0).mean() ** HASHES
            hits = np.bincount(owner[(mask & bit) != 0], minlength=len(texts))
            votes[:, i] = np.maximum(0, hits - false * total) / (1 - min(false, 0.99))
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    order = np.sort(votes, axis=1)
    first, second = order[:, -1], order[:, -2] if votes.shape[1] > 1 else np.zeros(len(texts))
    score = np.where(lettered & (first > 0), first / np.maximum(first + second, 1e-9), 0.0)
    best = votes.argmax(1)  # of equal votes the first language by name
    return [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.clip(score, 0, 1)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, i = [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < PART):
                    size, j = size + len(texts[j]), j + 1
                lang, score = predict(model, texts[i:j])
                langs += lang
                scores.append(score)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                                             names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row of ``docs``.

    ``und`` with score 0 for null texts and texts without letters, and for all if no row has a lang to learn from; of equal votes the first
    language by name. Repeated rows are judged alike; lang, source and doc_id are no inputs of a prediction.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))  # bounded by RATE
    out = docs.select("doc_id", "text").mapInArrow(_predictor(shared), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "lang_pred", "score")
