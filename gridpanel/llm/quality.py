"""Quality by co-training of two views.

One classifier sees the content of a text (character classes, runs of marks, word lengths, repetition), the other the metadata of its page
(source, language, length, url, size of the html). In every round each labels the documents of an unlabelled pool that it is sure about, and the
other learns from them. Both views are then calibrated on labelled documents that trained neither, and combined to score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import bounded_sample, fresh, held_out
from gridpanel.llm.logistic import fit_logistic, sigmoid
from gridpanel.llm.shingles import word_hashes
from gridpanel.llm.token_counts import _classes
from gridpanel.llm.url_filter import url_host, url_path

MODULUS, HELD_OUT = 5, 3
# The fit reads about so many labelled documents of a class and so many unlabelled ones: the bound of what the driver holds (features only).
SAMPLE_ROWS, POOL_ROWS = 3000, 6000
ROUNDS, SURE, STEP = 6, 0.95, 200
SOURCE_BUCKETS = 32
TEXT_FEATURES, PAGE_FEATURES = 12, SOURCE_BUCKETS + 8 + 8


def text_features(text: str | None) -> list[float]:
    """Content of a whole text as numbers; all 0 for null, empty and blank texts."""
    text = text or ""
    if not text.strip():
        return [0.0] * TEXT_FEATURES
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.bincount(_classes()[code], minlength=4) / len(code)
    words, _ = word_hashes([text.encode("utf-8", "surrogatepass")])
    n = max(1, len(words))
    repeated = (words[1:] == words[:-1]).sum() / n
    _, counts = np.unique(words, return_counts=True)
    twin = (code[1:] == code[:-1]) & (_classes()[code[1:]] == 3)
    upper = sum(map(str.isupper, text)) / len(text)
    return [*kind[1:].tolist(), upper, repeated, len(counts) / n, counts.max(initial=0) / n, twin.sum() / len(code), np.log1p(n), len(code) / n,
            text.count("\n") / n, ((code == 124) | (code == 9)).sum() / n]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "_text"]
        x = pa.array([text_features(t) for t in batch.column("_text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), x], names=[*kept, "x"])


def metadata(source: Column, lang: Column, chars: Column, url: Column, html_chars: Column) -> list[Column]:
    """Metadata as numbers; a document without a page has zeros for it."""
    bucket = lambda c, salt, n: F.pmod(F.xxhash64(F.coalesce(c, F.lit("")), F.lit(salt)), F.lit(n))
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    path = url_path(url)
    return [
        *[one(bucket(source, 1, SOURCE_BUCKETS) == i) for i in range(SOURCE_BUCKETS)], *[one(bucket(lang, 2, 8) == i) for i in range(8)],
        F.coalesce(F.log1p(F.greatest(chars, F.lit(0)).cast("double")), F.lit(0.0)), one(url.isNotNull()), one(url.startswith("https:")),
        one(F.contains(url, F.lit("?"))), one(F.contains(url, F.lit("#"))), one(url_host(url).startswith("www.")), F.size(F.split(path, "/")).cast("double"),
        F.coalesce(F.log1p(html_chars.cast("double")), F.lit(0.0)),
    ]


@dataclass(frozen=True)
class View:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale @ self.weights[:-1] + self.weights[-1]


@dataclass(frozen=True)
class Model:
    text: View
    page: View
    final: np.ndarray  # weights of the two calibrated logits, intercept


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_page: np.ndarray) -> tuple[View, View]:
    """Fit both views on the labelled rows and on what the other view is sure about in the pool."""
    views, taken = [text, page], [dict(), dict()]  # pool row -> label, for each view's training
    pools = [pool_text, pool_page]
    fitted: list[View] = []
    for _ in range(ROUNDS + 1):
        fitted = []
        for v in (0, 1):
            rows = np.fromiter(taken[v], int, len(taken[v]))
            x = np.vstack((views[v], pools[v][rows]))
            labels = np.concatenate((y, np.fromiter(taken[v].values(), float, len(taken[v]))))
            fitted.append(View(*fit_logistic(x, labels)))
        before = len(taken[0]) + len(taken[1])
        for v in (0, 1):
            p = sigmoid(fitted[v].logit(pools[v]))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                new = [int(i) for i in np.argsort(-sure, kind="stable") if sure[i] >= SURE and int(i) not in taken[1 - v]][:STEP]
                taken[1 - v].update((i, label) for i in new)
        if len(taken[0]) + len(taken[1]) == before:
            break
    return fitted[0], fitted[1]


def _features(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, x (text view) and m (page view) for every row; texts do not move."""
    names = {"doc_id": F.col("doc_id"), "_source": F.col("source"), "_lang": F.col("lang"), "_chars": F.col("n_chars"), "_text": F.col("text")}
    slim = docs.select(*[c.alias(n) for n, c in names.items()])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    rows = slim.mapInArrow(_texts, f"{kinds}, x array<double>")
    (page_id,) = fresh("page")
    page = pages.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias(page_id)).agg(F.max(F.struct("url", F.length("html").alias("h"))).alias("page"))
    both = rows.join(page, F.col("doc_id") == F.col(page_id), "left")
    m = metadata(F.col("_source"), F.col("_lang"), F.col("_chars"), F.col("page.url"), F.col("page.h"))
    return both.select("doc_id", "x", F.array(*m).alias("m"))


def fit(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> Model:
    """Learn from labelled rows that are not held out and from a pool of rows without labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = F.broadcast(bounded_sample(known.where(~held_out(F.col("doc_id"), MODULUS, HELD_OUT)), ["quality"], SAMPLE_ROWS, 9))
    pool = docs.select("doc_id").join(known, "doc_id", "left_anti").distinct().withColumn("quality", F.lit(-1))
    pool = F.broadcast(bounded_sample(pool, ["quality"], POOL_ROWS, 9))
    chosen = docs.join(drawn.unionByName(pool).withColumnRenamed("quality", "_quality"), "doc_id")
    sample = _features(chosen, pages).join(F.broadcast(drawn), "doc_id", "left").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # bounded by the two parameters
    x = np.array([r["x"] for r in sample], float).reshape(len(sample), TEXT_FEATURES)
    m = np.array([r["m"] for r in sample], float).reshape(len(sample), PAGE_FEATURES)
    y = np.array([-1 if r["quality"] is None else r["quality"] for r in sample], float)
    labelled = np.flatnonzero(y >= 0)
    calibration, training = labelled[::3], np.setdiff1d(labelled, labelled[::3])
    unlabelled = np.flatnonzero(y < 0)
    text, page = co_train(x[training], m[training], y[training], x[unlabelled], m[unlabelled])
    counts = dict(known.groupBy("quality").count().collect())
    logits = np.column_stack((text.logit(x[calibration]), page.logit(m[calibration])))
    center, scale, w = fit_logistic(logits, y[calibration])
    final = np.append(w[:-1] / scale, w[-1] - (w[:-1] * center / scale).sum())
    ones = y[calibration].sum()
    if min(counts.get(0, 0), counts.get(1, 0)) and 0 < ones < len(calibration):
        final[-1] += np.log(counts[1] / counts[0]) - np.log(ones / (len(calibration) - ones))
    return Model(text, page, final)


def _logit(x: Column, view: View) -> Column:
    """The linear form of a view over an array column."""
    slope = view.weights[:-1] / view.scale
    intercept = float(view.weights[-1] - (view.center * slope).sum())
    products = F.zip_with(x, F.array(*[F.lit(float(s)) for s in slope]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(intercept), lambda a, b: a + b)


def judge(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), and the two views' logits for every row of ``docs``.

    Null and empty texts have zero content features; missing pages, sources and languages are values of their own. Repeated rows score alike. Without
    labels of both classes every score is the share of the class that is there.
    """
    model = fit(docs, labels, pages)
    rows = _features(docs, pages).select("doc_id", _logit(F.col("x"), model.text).alias("text_logit"), _logit(F.col("m"), model.page).alias("page_logit"))
    a, b, c = map(float, model.final)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * F.col("text_logit") + b * F.col("page_logit") + c))))
    rows = rows.withColumn("score", score)
    return rows.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       "text_logit", "page_logit")
