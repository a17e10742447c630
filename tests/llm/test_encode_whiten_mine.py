"""The trie encoder against its library, whitening against exact arithmetic, and collocations against brute force."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.llm import bpe_trie, collocations, queries, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "row string, node string, n string, f string, c string, ids string, phrase string, word string, x string, score string, gram string, rank string"


# ---- encoding ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_every_code_point_like_the_library(library):
    path, tokenizer = library
    encoder = bpe_trie.Encoder(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}B 1{c}!" for c in chars[k : k + 128]) for k in range(0, len(chars), 128)]
    for text, ids, e in zip(texts, encoder.encode(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == np.array(e.ids, "<u4").tobytes(), text


def test_token_counts_of_new_code_points_like_the_library(library):
    from gridpanel.llm import token_counts

    path, tokenizer = library
    chars = [chr(c) for c in (0xA7CB, 0xA7DC, 0x105C0, 0x16D40, 0x1E5D0, *range(0x323B0, 0x323B0 + 600, 7), *range(0x3FFF0, 0x3FFFE))]
    texts = [f"a{c}B 1{c}! Σ{c}{c.lower()}" for c in chars] + ["".join(chars)]
    assert token_counts.count_tokens(token_counts.Transducer(path), texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_small_caches_and_parts_change_nothing(library, monkeypatch):
    path, tokenizer = library
    monkeypatch.setattr(bpe_trie, "WORDS", 20)
    monkeypatch.setattr(bpe_trie, "NODES", 50)
    monkeypatch.setattr(bpe_trie, "PART", 100)
    monkeypatch.setattr(bpe_trie, "DEEP", 4)
    rnd = random.Random(1)
    pool = "abcdeiou'stre'll d'mAÉéΣσ日Ị̇́ \t\n\x1c\x85 12½٣-_.<|>"
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 400))) + rnd.choice(["", "<|endoftext|>", "<|startoftext|>x "]) for _ in range(2000)]
    encoder = bpe_trie.Encoder(path)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == want, text
        assert bpe_trie.decode_ids(got, bpe_trie.strings_for(path)) == tokenizer.decode(want, skip_special_tokens=False)


def test_round_trip_on_messy_tables(spark, library):
    path, tokenizer = library
    long = "word'll 12 Übung " * 20_000 + "x" * 50_000
    texts = [None, "", " \n", "One", "ONE", long, "a" * 3000, "<|endoftext|><|endoftext|> b", "ﬁ İ 東京", "One"]
    rows = [(i if i % 4 else None, t, None, None, None, *["?"] * 12) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")
    got = sorted(map(tuple, bpe_trie.round_trip(docs, path).collect()), key=repr)
    want = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe_trie.round_trip(docs.limit(0), path).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe_trie.decode(nothing, path).first()["decoded"] == ""


# ---- whitening ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 9, 64])
def test_eigen_of_random_matrices(size):
    x = np.random.default_rng(size).normal(size=(300, size)) * 8
    check_eigen(np.cov(x.T).reshape(size, size))


def check_eigen(a):
    values, vectors = whitening.eigen(a)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * scale * len(a), rtol=0)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() <= 1e-13


def test_eigen_of_close_and_equal_values():
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(40, 40)))
    spectra = [np.repeat([9.0, 4, 1, 0], 10), np.logspace(0, -14, 40), np.append(np.ones(39), 1e6), np.append(np.full(39, 1e-6), 1), 1 + 1e-10 * np.arange(40)]
    for e in spectra:
        m = q @ np.diag(e) @ q.T
        check_eigen((m + m.T) / 2)
    check_eigen(np.eye(7))
    check_eigen(np.zeros((3, 3)))
    check_eigen(np.diag([5.0, 5, 5, 1, 1, 0, 0, 1e-9]))


def test_whitening_equals_exact_arithmetic(spark):
    rnd = np.random.default_rng(5)
    mixing = rnd.normal(size=(6, 6))
    vectors = [list(map(float, rnd.normal(size=6) @ mixing + 40)) for _ in range(200)]
    vectors += [vectors[0]] * 30
    rows = [(i if i else None, v) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0, 2.0]), (7, vectors[7])]
    table = spark.createDataFrame([(*r, *["?"] * 12) for r in rows], f"vec_id long, embedding array<double>, {CLASHING}").repartition(5)
    whole = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    n, x = len(whole), [w for _, w in whole]
    sums = [sum(c) for c in zip(*x, strict=True)]
    cov = np.array([[float(sum(Fraction((n * r[i] - sums[i]) * (n * r[j] - sums[j])) for r in x) / n**3) for j in range(6)] for i in range(6)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    got = collections.defaultdict(list)
    for r in whitening.whiten(table, 4).collect():
        got[r["vec_id"], r["deviation"]].append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-12
    seen = collections.Counter((i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in whole)
    assert {k: len(v) for k, v in got.items()} == {k: 4 * c for k, c in seen.items()}
    for i, v in whole:
        w = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)]) @ basis[:, :4] / np.sqrt(values[:4])
        mine = got[i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))]
        for r in mine:
            assert abs(abs(r["whitened"]) - abs(w[r["component"] - 1])) < 1e-9
    # one sign for all rows
    for k in range(4):
        signs = {np.sign(r["whitened"]) * np.sign(w @ np.eye(4)[k]) for i, v in whole[:1] for r in got[i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))] if r["component"] == k + 1
                 for w in [np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)]) @ basis[:, :4]]}
        assert len(signs) == 1


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)], schema)
    assert whitening.whiten(flat).select("component").distinct().count() == 1


def test_large_values_stay_exact():
    x = np.array([[3_000_000_000, 5], [-3_000_000_000, 7]])
    apart, squares = whitening._deviations(x, 10**7, [1, 2])
    assert squares.tolist() == [sum((10**7 * int(c) - s) ** 2 for c, s in zip(r, (1, 2), strict=True)) for r in x]


# ---- collocations ------------------------------------------------------------------------------------------------------------


def mined(rows, least, within, top):
    """Brute force over all phrases."""
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "within", "top"), [(2, 50, 2000), (3, 80, 25)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, within, top):
    monkeypatch.setattr(collocations, "TOKENS", 32 if least == 2 else 1 << 20)  # texts are cut and counted in parts
    rnd = random.Random(least)
    vocabulary = ["a", "B", "c", "é", "d'e", "𝄞", "x\x01", " ", ""] + [f"w{i}" for i in range(30)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, None), ("", "en"), (" . ,, \n", None), ("solo", None), ("und", "und"), ("x x x x x x", "en"), ("x y x y x y", "en")]
    for _ in range(300):
        text = "".join(rnd.choice(vocabulary[: rnd.choice([4, 12, 39])]) + rnd.choice([" ", " ", "\t ", ". ", "\n"]) for _ in range(rnd.randint(0, 40)))
        rows.append((text + (passage if rnd.random() < 0.2 else "") + rnd.choice(["", "!", " a b"]), rnd.choice(["en", "en", "de", None, "und"])))
    rows += rows[:40]
    docs = spark.createDataFrame([(1, t, lang, None, None, *["?"] * 12) for t, lang in rows], f"{SCHEMA}, {CLASHING}").repartition(4)
    got = sorted(map(tuple, collocations.mine(docs, least, within, top).collect()))
    assert got == mined(rows, least, within, top)
    assert len(got) > 40


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).count() == 0


def test_unary_paths_are_compacted(spark):
    text = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(i, f"{text}. p7 p8 z", "en", None, None) for i in range(12)], SCHEMA)
    counts = collocations.grams(docs, 12).persist()
    assert counts.where("gram = 'p3 p4 p5'").first()["c"] == 12 and counts.where("gram = 'p48 p49'").first()["single"] is False
    assert counts.where("kind = 0 and gram = 'p7'").agg(F.sum("c")).first()[0] == 24
    edges = counts.where("kind = 2").select("lang", "gram", "c")
    pairs = collocations.unary_nodes(counts.where("kind = 1").select("lang", F.col("gram").alias("node"), F.col("c").alias("f"), "single"), edges)
    found = sorted(len(r["words"]) for r in collocations.paths(edges, pairs.where("unary")).collect())
    assert found == [3, 9, 43]  # cut at the node "p7 p8", which two edges leave


def test_collocation_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = queries.QUERIES["op13_collocations"](spark, DIR)
    want = con.execute(queries.ORACLES["op13_collocations"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want) and want
    assert df.where(F.col("score") < 0).count() == 0
