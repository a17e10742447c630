"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. A conditional random field over the tokens of a document that hold a
digit or an ``@`` adds what they miss: tokens in base spans are observed, others have potentials of their shape and of the word before them,
neighbours share chain potentials, and all tokens of a document with the same characters share skip potentials with one hub node, which holds the label
of those that are observed. Loopy message passing spreads labels over the
document until the messages settle; a token with a clear label becomes a span, touching tokens of one label one span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
FEATURES = 2048
# The potentials are fitted on the tokens of about so many documents.
SAMPLE_ROWS = 4000
CERTAIN, ROUNDS, SETTLED = 0.9, 30, 1e-4
SAME_CHARS = 6  # letters and digits that two tokens must share to be linked
NEAR = 2  # characters between neighbours of a chain
_EDGE = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACE = re.compile(r"\s")
_DIGIT = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost without overlap for each kind; by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EDGE.match(text, at)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that hold a digit or @, without punctuation around them."""
    out, end = [], 0
    for m in _DIGIT.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        gap = _SPACE.search(text, m.end())
        end = gap.start() if gap else len(text)
        body = text[start:end].strip(".,;:!?\"'<>[]{}|*&$%#")
        if body:
            start += text[start:end].find(body)
            out.append((start, start + len(body)))
    return out


def _shape(token: str) -> str:
    kinds = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token))
    return re.sub(r"a{2,}", "a+", kinds)[:40]


def _features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the two features of each token: its shape, and the shape class with the word before it."""
    out = np.zeros((len(spans), 2), np.int64)
    for i, (a, b) in enumerate(spans):
        shape = _shape(text[a:b])
        before = text[max(0, a - 16) : a].split()
        out[i, 0] = _bucket("s" + shape)
        out[i, 1] = _bucket("w" + (before[-1].lower() if before else "") + "|" + re.sub(r"9+", "9", shape))
    return out


def _bucket(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def _observed(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of the tokens that a base span overlaps (kind + 1), else -1."""
    out = np.full(len(spans), -1)
    ordered = sorted((s, e, k) for k, s, e in base)
    i = 0
    for j, (a, b) in enumerate(spans):
        while i < len(ordered) and ordered[i][1] <= a:
            i += 1
        for s, e, k in ordered[i:]:
            if s >= b:
                break
            if e > a:
                out[j] = k + 1
                break
    return out


def _edges(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Chain edges of close tokens, and groups of two or more tokens with the same letters and digits."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= NEAR]
    groups: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(spans):
        key = "".join(c for c in text[a:b].lower() if c.isalnum())
        if len(key) >= SAME_CHARS:
            groups.setdefault(key, []).append(i)
    return chain, [g for g in groups.values() if len(g) > 1]


def _hubs(unary: np.ndarray, seen: np.ndarray, groups: list[list[int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """``unary`` with a row for the hub of each group, and skip edges from hubs to occurrences. A hub has the most frequent label of the observed ones."""
    hubs, skip = np.zeros((len(groups), unary.shape[1])), []
    for k, group in enumerate(groups):
        known = seen[group]
        counts = np.bincount(known[known >= 0], minlength=unary.shape[1])
        hubs[k, counts < counts.max()] = -1e9  # more than any number of occurrences can outweigh
        skip += [(len(unary) + k, i) for i in group if seen[i] < 0]
    return np.concatenate((unary, hubs)), skip


@dataclass(frozen=True)
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log potentials
    skip: float  # log potential of equal labels


def beliefs(unary: np.ndarray, chain: list, skip: list, model: Model) -> np.ndarray:
    """Label probabilities by loopy message passing (``unary`` holds log potentials)."""
    if not chain and not skip:
        return _softmax(unary)
    labels = unary.shape[1]
    tables = np.stack([model.chain] * len(chain) + [np.eye(labels) * model.skip] * len(skip))
    a, b = np.array(chain + skip).T
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    tables = np.concatenate((tables, tables.transpose(0, 2, 1)))
    messages, m = np.zeros((len(source), labels)), len(a)
    back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, target, messages)
        inner = (total[source] - messages[back])[:, :, None] + tables
        top = inner.max(1)
        new = top + np.log(np.exp(inner - top[:, None]).sum(1))
        new = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
        moved = np.abs(new - messages).max()
        messages = new
        if moved < SETTLED:
            break
    total = unary.copy()
    np.add.at(total, target, messages)
    return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def find_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text."""
    base = base_spans(text)
    spans = tokens(text) if _DIGIT.search(text) else []
    if not spans:
        return base, []
    seen = _observed(spans, base)
    unary = model.unary[_features(text, spans)].sum(1)
    unary[seen >= 0] = np.where(np.arange(unary.shape[1]) == seen[seen >= 0][:, None], 0.0, -30.0)
    chain, groups = _edges(text, spans)
    unary, skip = _hubs(unary, seen, groups)
    p = beliefs(unary, chain, skip, model)[: len(spans)]
    added: list[tuple[int, int, int]] = []
    for (a, b), label, sure, known in zip(spans, p.argmax(1), p.max(1), seen, strict=True):
        if known < 0 and label > 0 and sure >= CERTAIN:
            if added and added[-1][0] == label - 1 and 0 <= a - added[-1][2] <= NEAR:
                added[-1] = (label - 1, added[-1][1], b)
            else:
                added.append((int(label) - 1, a, b))
    return base, added


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (kind of evidence, feature, label): 0 and 1 for the two features, 2 for chain pairs, 3 for equal skip pairs."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = tokens(text)
            if not spans:
                continue
            label = _observed(spans, base_spans(text)).clip(0)
            f = _features(text, spans)
            chain, groups = _edges(text, spans)
            skip = [pair for g in groups for pair in zip(g, g[1:], strict=False)]
            rows += [(0, int(x), int(y)) for x, y in zip(f[:, 0], label, strict=True)]
            rows += [(1, int(x), int(y)) for x, y in zip(f[:, 1], label, strict=True)]
            rows += [(2, int(label[i]), int(label[j])) for i, j in chain]
            rows += [(3, 0, int(label[i] == label[j])) for i, j in skip]
        if rows:
            yield pd.DataFrame(rows, columns=["what", "x", "y"]).groupby(["what", "x", "y"]).size().reset_index(name="n")


def fit(docs: DataFrame) -> Model:
    """Potentials from the base labels of a sample: log-odds of labels given each feature, and of label pairs on chain and skip edges."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.lit(0).alias("g"))
    sample = bounded_sample(rows, ["g"], SAMPLE_ROWS, 3).select("text")
    counts = sample.mapInPandas(_evidence, "what int, x long, y long, n long").groupBy("what", "x", "y").agg(F.sum("n").alias("n")).collect()  # FEATURES bounds it
    labels = len(KINDS) + 1
    table, chain, skip = np.zeros((2, FEATURES, labels)), np.zeros((labels, labels)), np.array([1.0, 20.0])  # equal strings mostly mean the same
    for what, x, y, n in counts:
        if what < 2:
            table[what, x, y] += n
        elif what == 2:
            chain[x, y] += n
        else:
            skip[y] += n
    share = (table[0].sum(0) + 0.5) / (table[0].sum() + 0.5 * labels)
    # a feature's log-odds shrink to nothing where it is rare
    unary = np.log((table + 2 * share) / (table.sum(2, keepdims=True) + 2)) - np.log(share)
    merged = unary.sum(0) + 0.5 * np.log(share)  # a token sums the rows of its two features
    pair = (chain + share[:, None] * share * 10) / (chain.sum() + 10)
    tie = np.log(pair) - np.log(pair.sum(1, keepdims=True)) - np.log(pair.sum(0, keepdims=True))
    return Model(merged, np.clip(tie, -4, 4), float(np.clip(np.log(skip[1] / skip[0]), 1, 6)))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _finder(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = find_spans(text or "", model)
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, spans (base and added) and n_added for every row of ``docs``.

    Null counts as empty; a text without digits and @ has no spans. Repeated rows are judged alike; with no base span anywhere nothing is added.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(_finder(fit(docs)), schema)
