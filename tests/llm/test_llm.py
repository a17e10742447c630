"""Text operators against brute force, exact round trips, held-out accuracy and messy tables."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridpanel.llm import components, decontaminate, exact_dedup, jaccard_join, language_id, mixing, pii, quality, queries, token_counts, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use themselves
CLASHING = "row string, node string, tag string, size string, n string, key string, rule string, score string, target string, prefix string, t string, hits string"
LABELS, PAGES, BENCHMARK = "doc_id long, quality int, toxic int", "page_id long, url string, html string", "item_id long, text string"


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 4))) for _ in range(n))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing columns."""
    rnd = random.Random(3)
    long = words(rnd, 20_000) + " " + "x" * 5000
    texts = [None, "", " \n\t", "One", "ONE", "one two", long, long.upper(), "a@b.co 1.2.3.4", "Ünï 東京 ﬁ İ", "<|endoftext|>", "1" * 3000, "%%% ||| !!"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if i % 4 else 5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "One", None, None, None), (None, None, None, None, None), (5, "other text of id five", "fr", "t", 1)]
    return frame(spark, [(*r, *["?"] * 12) for r in rows], f"{SCHEMA}, {CLASHING}")


def empty_like(df):
    return df.limit(0)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- urls -----------------------------------------------------------------------------------------------------------------


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r.index("/"), r, a) for r, a in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_cascade_equals_brute_force(spark):
    rnd = random.Random(1)
    part = lambda: rnd.choice(["a", "b", "ab", "A", "c"])
    urls = [f"http://{'.'.join(part() for _ in range(rnd.randint(1, 4)))}/{'/'.join(part() for _ in range(rnd.randint(0, 4)))}{rnd.choice(['', '?q=/a', '#f'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "http://a", "http://a?x", "x://y://a/b", "http://a..b/a", "http://" + "a." * 300 + "b/a", urls[0]]
    rules = {f"{'.'.join(rnd.choice(['a', 'b', 'ab', 'c']) for _ in range(rnd.randint(1, 3)))}/{rnd.choice(['', 'a', 'b/', 'ab/c', 'a/b'])}" for _ in range(80)}
    rules = [(r, rnd.choice(["allow", "block"])) for r in sorted(rules)]
    pages = frame(spark, [(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.filter_urls(pages, frame(spark, rules, "rule string, action string"))
    assert rows_of(got.select("page_id", "host", "path", "rule", "verdict")) == sorted(((i, *judged(u, rules)) for i, u in enumerate(urls)), key=repr)
    none = url_filter.filter_urls(empty_like(pages), frame(spark, rules, "rule string, action string"))
    assert none.count() == 0
    plain = url_filter.filter_urls(pages, frame(spark, [], "rule string, action string"))
    assert {r["verdict"] for r in plain.collect()} == {"allow"}


# ---- mixing ---------------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, messy):
    rnd = random.Random(2)
    sizes = {"a": 400, "b": 60, "c": 30, None: 20, "z": 5, "hot": 900}
    rows = [(i, words(rnd, rnd.randint(0, 40)), "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sizes(frame(spark, rows[::-1]).repartition(3)).collect()))
    source = {r[0]: r[3] for r in rows}
    total, weight, limit, taken = sum(r["size"] for r in got), {}, {}, collections.Counter()
    for i, s in enumerate(sorted({r[3] for r in rows}, key=lambda s: (s is None, s))):
        weight[s] = (5, 2, 1)[i % 3]
        limit[s] = 2 * sum(r["size"] for r in got if source[r["doc_id"]] == s)
    fixed = set()
    while True:
        left = 1.5 * total - sum(limit[s] for s in fixed)
        want = {s: left * w / sum(weight[x] for x in weight if x not in fixed) for s, w in weight.items() if s not in fixed}
        over = {s for s in want if want[s] > limit[s]}
        if not over:
            break
        fixed |= over
    want |= {s: limit[s] for s in fixed}
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    mixed = mixing.mix(messy)
    assert mixed.count() == messy.count() and set(messy.columns) - {"size", "target"} < set(mixed.columns)
    assert mixing.mix(empty_like(messy)).count() == 0 == mixing.mix_sizes(empty_like(messy)).count()
    assert all(r["taken"] == 0 for r in mixing.mix_sizes(frame(spark, [(1, None, None, None, None)])).collect())


# ---- exact copies ---------------------------------------------------------------------------------------------------------


def low(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text or "")


def test_exact_groups_equal_brute_force(spark, messy):
    rnd = random.Random(4)
    stem = words(rnd, 3000)
    texts = [stem[:n] + t for n in (0, 10, 63, 64, 65, 1000, 1024, 1025, 9000) for t in ("", "é", "É", "x", "X")] * 3 + ["hot"] * 200
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    got = exact_dedup.exact_groups(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = [(r[0], max(g := groups[low(r[1])]), len(g), r[0] == max(g), hashlib.sha256(low(r[1]).encode()).hexdigest()) for r in rows]
    assert rows_of(got) == sorted(want, key=repr)
    found = exact_dedup.exact_groups(messy).collect()
    assert len(found) == messy.count()
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})  # one of each group, of repeated rows too
    kept = exact_dedup.drop_exact_copies(messy)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in found)
    assert exact_dedup.exact_groups(empty_like(messy)).count() == 0


# ---- near copies ----------------------------------------------------------------------------------------------------------


def shingles(text, width):
    w = low(text).encode().split()
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(rows, width, num, den):
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def near_rows(rnd):
    """Clusters that drift apart, passages shared by many documents, short texts."""
    passage, rows = words(rnd, 30), []
    for _ in range(12):
        stem = words(rnd, rnd.choice([5, 20, 60, 150])).split()
        for _ in range(rnd.randint(1, 9)):
            if rnd.random() < 0.7:
                stem = stem.copy()
                stem[rnd.randrange(len(stem))] = words(rnd, 1)
            rows.append(" ".join(stem) + (" " + passage if rnd.random() < 0.3 else ""))
    rows += [words(rnd, rnd.randint(20, 60)) + " " + passage for _ in range(20)]
    rows += ["", None, "a", "A", "a b", "a  b", " ", rows[0]]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "num", "frequent"), [(3, 90, 16), (3, 90, 2), (5, 80, 2)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, width, num, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "SMALL_BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "LEADERS", (1,))
    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", 3)
    rows = near_rows(random.Random(frequent + width))
    docs = frame(spark, [(d, t, "en", "s", 1) for d, t in rows])
    assert rows_of(jaccard_join.similar_components(docs, width, num, 100)) == sorted(brute_components(rows, width, num, 100), key=repr)


def test_pairs_verified_grow_with_the_size_of_a_group_not_its_square(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEADERS", ())  # all is left to the chunks
    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", 40)
    seen, real = [], jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    rnd = random.Random(32)
    stem, rows = words(rnd, 200).split(), []
    for i in range(150):  # up to five changed words: similar to some of the group, not to all
        copy = stem.copy()
        for _ in range(rnd.randint(1, 5)):
            copy[rnd.randrange(20, 200)] = f"new{i}x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    docs = frame(spark, [(d, t, "en", "s", 1) for d, t in rows])
    assert rows_of(jaccard_join.similar_components(docs, 5, 80, 100)) == sorted(brute_components(rows, 5, 80, 100), key=repr)
    assert 0 < sum(seen) < 10 * len(rows)  # pairs of the group: 11,175


def test_jaccard_on_messy_tables(spark, messy):
    got = jaccard_join.similar_components(messy).collect()
    assert len(got) == messy.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    assert by_id[4]["component_id"] == 3 == by_id[3]["component_id"] and by_id[7]["component_id"] == 6 and by_id[1] == (1, 0, 1)
    assert jaccard_join.similar_components(empty_like(messy)).count() == 0


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = dict(components.components(frame(spark, edges, "a long, b long")).collect())
    assert all(got.get(x, x) == p for x, p in parent.items())


# ---- tokens ---------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, messy, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(5)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABC''' \n\t.,!?0123456789éÉßΣσςİıñ東京한국🙂½²Ⅷ٣\x85\u0301\u200d")
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 80))) for _ in range(1500)]
    texts += ["'s't're''s", "<|endoftext|>a <|startoftext|><|endoftext|>", "a" * 3000, "ab" * 2000 + " x", "", " ", "i'Ve 'Tis 'LL"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    machine = token_counts.Transducer(path)
    assert token_counts.count_tokens(machine, texts) == want
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 60_000)  # the machine is dropped again and again
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "PART", 500)
    assert token_counts.count_tokens(machine, texts) == want
    monkeypatch.undo()
    got = token_counts.token_counts(messy, path).collect()
    source = collections.Counter((r["doc_id"], r["text"] or "") for r in messy.collect())
    want = sorted(((d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for (d, t), k in source.items() for _ in range(k)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert token_counts.token_counts(empty_like(messy), path).count() == 0


# ---- decontamination ------------------------------------------------------------------------------------------------------


def test_templates_catch_new_parameters(spark, messy):
    items = [(1, "Then Alice walked 12 km in 3 hours, and after 12 km the old dog of Alice slept for 2.5 days."), (2, "tiny one"), (3, None), (4, ""), (None, "x")]
    benchmark = frame(spark, items, BENCHMARK)
    renamed = "Then Bob walked 7 km in 5 hours, and after 7 km the old dog of Bob slept for 4,25 days."
    mixed = "Then Bob walked 7 km in 5 hours, and after 9 km the old dog of Carol slept for 4,25 days."
    filler = " ".join(f"w{chr(97 + i)}" for i in range(20))
    texts = {10: items[0][1], 11: f"{filler}. {items[0][1]} {filler}", 12: f"{filler}. {renamed}", 13: mixed, 14: items[0][1].upper().replace("ALICE", "Alice"), 15: filler,
             16: items[0][1][:40], 17: f"{filler} tiny, ONE! {filler}", 18: None, 19: ""}
    docs = frame(spark, [(d, t, "en", "s", 1) for d, t in texts.items()])
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontaminate.judge(docs, benchmark).collect()}
    assert got.pop(14)[0] in (True, False)  # capitals hide names
    yes, no = {10: 1, 11: 1, 12: 1, 17: 2}, (False, None)
    assert got == {d: (True, yes[d]) if d in yes else no for d in got}
    assert rows_of(decontaminate.drop_contaminated(docs, benchmark).select("doc_id").where("doc_id <> 14")) == [(13,), (15,), (16,), (18,), (19,)]
    assert decontaminate.judge(messy, benchmark).count() == messy.count() == decontaminate.drop_contaminated(messy, benchmark).count()
    assert decontaminate.judge(messy, empty_like(benchmark)).where("contaminated").count() == 0
    assert decontaminate.judge(empty_like(messy), benchmark).count() == 0


def test_names_at_sentence_starts_and_in_other_case(spark):
    item = "Tom has 5 apples and 3 pears. Tom gives 2 apples to his sister Ann. Ann eats 1 apple and keeps the rest for Tom."
    lone = "Zed sold 4 boxes of old books on the market. Zed bought a red bike from the money he got there."  # a name at sentence starts only
    benchmark = frame(spark, [(1, item), (2, lone), (3, "Where is the red house")], BENCHMARK)
    renamed = item.replace("Tom", "Bob").replace("Ann", "Eve")
    other = renamed.replace("Bob gives", "Eve gives")  # two for one
    docs = {1: renamed, 2: item.upper(), 3: item.lower(), 4: f'He said: "{renamed}"', 5: f"Filler text\n{renamed}", 6: lone.replace("Zed", "Ida"), 7: lone.upper(),
            8: lone.lower(), 9: other, 10: "Here is the red house", 11: "WHERE IS THE RED HOUSE"}
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.judge(frame(spark, [(d, t, "en", "s", 1) for d, t in docs.items()]), benchmark).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: None, 10: None, 11: 3}


def test_capitals_do_not_hide_a_copy(spark):
    text = "Then Alice walked 12 km in 3 hours, and after 12 km the old dog of Alice slept for 2.5 days."
    docs = frame(spark, [(14, text.upper().replace("ALICE", "Alice"), "en", "s", 1)])
    assert decontaminate.judge(docs, frame(spark, [(1, text)], BENCHMARK)).first()["contaminated"]


def test_rows_without_id_and_slots_both_ways(spark):
    item = "Then Alice walked 12 km in 3 hours, and after 12 km the old dog of Bella slept for 2.5 days."
    benchmark = frame(spark, [(1, item)], BENCHMARK)
    filler = " ".join(f"w{chr(97 + i)}" for i in range(20))
    texts = [(None, item), (None, filler), (None, None), (7, filler), (7, item), (7, item)]
    docs = frame(spark, [(d, t, "en", "s", 1) for d, t in texts])
    assert [r["contaminated"] for r in decontaminate.judge(docs, benchmark).collect()].count(True) == 3  # rows with the item, not those that share their id
    left = decontaminate.drop_contaminated(docs, benchmark).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(None, filler), (None, None), (7, filler)], key=repr)
    # two names become one: another text; two numbers become equal: chance
    other = item.replace("Alice", "Carol").replace("Bella", "Carol")
    equal = item.replace("Alice", "Carol").replace("12", "4").replace(" 3 ", " 4 ")
    got = decontaminate.judge(frame(spark, [(1, other, "en", "s", 1), (2, equal, "en", "s", 1)]), benchmark).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == {1: False, 2: True}


def test_verbatim_leaks_equal_brute_force(spark):
    docs, benchmark = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    tokens = lambda t: re.findall(r"[^\W\d_]+|\d+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = {r["item_id"]: grams(tokens(r["text"])) for r in benchmark.collect()}
    want = {r["doc_id"] for r in docs.collect() if (g := grams(tokens(r["text"]))) and any(len(x & g) >= 0.8 * len(x) for x in items.values())}
    assert {r["doc_id"] for r in decontaminate.judge(docs, benchmark).where("contaminated").collect()} == want and want


# ---- classifiers ----------------------------------------------------------------------------------------------------------


def auc(score, label):
    ones, zeros = ([s for s, y in zip(score, label, strict=True) if y == v] for v in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_language_held_out(spark, messy):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    found = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.identify(messy).collect() if r["doc_id"] is not None}
    assert {(0, True), (1, True), (2, True), (11, True), (12, True), (3, False)} <= found
    assert language_id.identify(empty_like(messy)).count() == 0


def test_toxicity_held_out(spark, messy):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.judge(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert auc([r["score"] for r in got], [r["toxic"] for r in got]) >= 0.7  # few toxic texts here, and most of them in English
    small = frame(spark, [(i, i % 2, i % 2) for i in range(13)] + [(3, None, None), (None, 1, 1)], LABELS)
    for table in (small, empty_like(small)):
        scored = toxicity.judge(messy, table).collect()
        assert len(scored) == messy.count() and all(0 <= r["score"] <= 1 for r in scored)
        assert len({r["score"] for r in scored if r["doc_id"] in (0, 1)}) == 1  # null is empty
    assert toxicity.judge(empty_like(messy), small).count() == 0
    assert toxicity.drop_toxic(messy, small, threshold=1.1).count() == messy.count()


def test_toxic_passage_in_a_long_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"), toxicity.MODULUS, toxicity.HELD_OUT)).orderBy("doc_id")
    clean = " ".join(r["text"] for r in held.where("toxic = 0 and lang = 'en'").limit(40).collect())
    assert len(clean) > 20_000
    toxic = [r["text"] for r in held.where("toxic = 1 and length(text) < 3000").limit(40).collect()]
    hits = lambda texts: [s >= toxicity.THRESHOLD for s in toxicity._scores(texts, model)]
    short, long = hits(toxic), hits([f"{t} {clean[:20_000]}" for t in toxic])
    assert sum(short) and sum(a and b for a, b in zip(short, long, strict=True)) >= 0.8 * sum(short)


def test_quality_held_out(spark, messy):
    docs, labels, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels", "pages"))
    got = quality.judge(docs, labels, pages).where("held_out").join(labels, "doc_id").collect()
    assert auc([r["score"] for r in got], [r["quality"] for r in got]) >= 0.9
    small = frame(spark, [(i, i % 2, 0) for i in range(13)], LABELS)
    page = frame(spark, [(3, None, None), (3, "http://a/b", "x"), (None, "u", "h")], PAGES)
    for table in (small, empty_like(small)):
        assert quality.judge(messy, table, page).count() == messy.count()
    assert quality.judge(empty_like(messy), small, page).count() == 0


# ---- personal data --------------------------------------------------------------------------------------------------------

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p.lstrip("0")[:4] or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield f"{kind}:{m.start()}:{m.end()}"


def test_base_spans_equal_the_patterns(spark, messy):
    rnd = random.Random(6)
    bits = ["a.b@c.de", "@", "x@y", ".@a.b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "+", " ", "é", "-", ".", "7"]
    for _ in range(3000):
        text = "".join(rnd.choices(bits, k=rnd.randint(0, 8)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text)] == list(brute_spans(text)), text
    for text in ("0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 5000 + "255 x", "9" * 5000 + ".1.1.1"):  # octets beyond Python's limit for int()
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text)] == list(brute_spans(text))
    got = pii.find_pii(messy).collect()
    texts = collections.defaultdict(set)
    for r in messy.collect():
        texts[r["doc_id"]].add(hashlib.sha256(",".join(brute_spans(r["text"] or "")).encode()).hexdigest())
    assert len(got) == messy.count() and all(r["base_sha256"] in texts[r["doc_id"]] for r in got)
    assert pii.find_pii(empty_like(messy)).count() == 0


def test_skip_edges_carry_labels(spark):
    rnd = random.Random(7)
    number = lambda: f"+1{rnd.randint(10**9, 10**10 - 1)}"
    rows = [(i, f"call {number()} or room {rnd.randint(1, 99)} now", "en", "s", 1) for i in range(300)]
    model = pii.fit(frame(spark, rows))
    phone = "+15551234567"
    text = f"call {phone} today. {'word ' * 50}later dial {phone[1:]} or room 12"
    base, added = pii.find_spans(text, model)
    assert base == [(3, 5, 17)] and [(k, text[a:b]) for k, a, b in added] == [(3, phone[1:])]


@pytest.mark.parametrize("lean", [0.0, 0.5])
def test_one_base_span_labels_all_repeats(lean):
    labels = len(pii.KINDS) + 1
    unary = np.zeros((pii.FEATURES, labels))
    unary[:, 0] = lean / 2  # a token sums two features
    model = pii.Model(unary, unary[:labels, :] * 0, 6.0)
    phone = "+15551234567"
    text = f"call {phone} today. " + f"{'word ' * 5}later dial {phone[1:]} again. " * 50
    base, added = pii.find_spans(text, model)
    assert base == [(3, 5, 17)] and [(k, text[a:b]) for k, a, b in added] == [(3, phone[1:])] * 50


# ---- queries and pipeline -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_exact_dedup"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    got = queries.QUERIES[name](spark, DIR)
    cur = con.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert rows_of(got) == sorted((tuple(r[at[c]] for c in got.columns) for r in cur.fetchall()), key=repr)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, DIR).toPandas())
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after.items() <= before.items() and len(after) > 0.6 * len(before)
        if name == "exact dedup":
            groups = collections.defaultdict(list)
            for d, t in before.items():
                groups[low(t)].append(d)
            assert set(after) == {max(g) for g in groups.values()}
        if name == "n-gram Jaccard join":
            assert set(after) == {d for d, _, c in brute_components(list(before.items()), 5, 80, 100) if d == c}
        if name != "mixing sources to target weights":
            assert set(kept.columns) == set(docs.columns)
    assert kept.agg(F.sum("taken")).first()[0] > 0


def test_texts_reach_the_kernels_a_megabyte_at_a_time(monkeypatch):
    """op8 and toxicity: the memory of a Python worker follows the slice, not the Arrow batch."""
    import pyarrow as pa

    from gridpanel.llm import jaccard_join, toxicity
    from gridpanel.llm.shingles import shingle_sets

    texts = [None, "", *(f"word{i} " * 50_000 for i in range(8)), "a b c d"]
    seen: list[int] = []

    def sets(some, width):
        seen.append(sum(len(t or "") for t in some))
        return shingle_sets(some, width)

    monkeypatch.setattr(jaccard_join, "shingle_sets", sets)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches([*jaccard_join._sketch(3, 90, 100)(iter([batch]))])
    assert out["doc_id"].to_pylist() == [*range(len(texts))] and sum(seen) == sum(len(t or "") for t in texts)
    assert max(seen) <= 1_000_000
    seen.clear()
    digests = pa.RecordBatch.from_arrays([out["doc_id"].combine_chunks(), *(out[c].combine_chunks() for c in ("n", "s1", "s2")), batch["text"]], names=["node", "n", "s1", "s2", "text"])
    kept = pa.Table.from_batches([*jaccard_join._digests(3)(iter([digests]))])
    assert kept["node"].to_pylist() == [*range(len(texts))] and kept["text"].to_pylist() == texts and max(seen) <= 1_000_000
    monkeypatch.setattr(toxicity, "_scores", lambda some, model: (seen.append(sum(map(len, some))), np.zeros(len(some)))[1])
    seen.clear()
    assert pa.Table.from_batches([*toxicity._keeper(None, 0.5)(iter([batch]))])["text"].to_pylist() == texts and max(seen) <= 1_000_000


def test_written_sends_small_batches_to_python_and_restores_the_setting(spark):
    import pyarrow as pa

    from gridpanel.session import ARROW_ROWS, written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(ARROW_ROWS, None)
    got = written(spark.range(0, 100, 1, 2).mapInArrow(sizes, "n bigint"), 8).toPandas()["n"]
    assert got.sum() == 100 and got.max() <= 8 and spark.conf.get(ARROW_ROWS, None) == before


def test_written_removes_the_shuffle_files_of_its_write(spark):
    import time

    from gridpanel.session import CLEANUP, written

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, was = files(), spark.conf.get(CLEANUP, None)
    grouped = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    assert len(written(grouped).collect()) == 100 and spark.conf.get(CLEANUP, None) == was
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left


def test_dropping_copies_leaves_only_ids_on_disk(spark):
    from gridpanel.session import checkpoint_dir

    rnd = random.Random(6)
    texts = [words(rnd, 60) for _ in range(30)]
    near = [t + " tail" for t in texts[:10]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *near, *texts[:5], texts[0].upper(), "", None])]
    rows += [(3, texts[3], "fr", "t", 2), (3, texts[3], "en", "s", 1), (40, texts[0], "de", "u", 7), (None, texts[6], None, None, None), (100, "single", None, None, None), (100, "single", None, None, 1)]
    docs = frame(spark, rows)
    top = checkpoint_dir(spark).removeprefix("file:")
    for drop in (exact_dedup.drop_exact_copies, jaccard_join.drop_near_copies):
        before = set(os.listdir(top))
        kept = drop(docs).collect()
        for name in set(os.listdir(top)) - before:
            columns = spark.read.parquet(f"{top}/{name}").columns
            assert len(columns) <= 4 and not {"row", "text", "prefix", "bits", "r", "seen"} & set(columns)
            assert sum(os.path.getsize(f"{top}/{name}/{f}") for f in os.listdir(f"{top}/{name}")) < 20_000
        if drop is exact_dedup.drop_exact_copies:
            best = {}
            for r in rows:
                best[low(r[1])] = max(best.get(low(r[1]), -1), -1 if r[0] is None else r[0])
            assert sorted((low(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in kept) == sorted(best.items())
            assert {tuple(r) for r in kept} <= set(rows)


def test_rows_that_share_no_id_with_dropped_copies_are_not_shuffled(spark):
    rnd = random.Random(9)
    texts = [words(rnd, 40) for _ in range(300)]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *texts[:10]])])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = exact_dedup.drop_exact_copies(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(10, 310))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = [line for line in plan if line.startswith("   :")]  # the first branch of the union
    assert first and not any("Exchange" in line or "Join" in line for line in first)


def test_bit_maps_never_rule_out_a_similar_pair(spark):
    rnd = np.random.default_rng(5)
    schema, sets = "node long, n long, bits array<long>", []
    for n in (1, 30, 250, 257, 510, 520, 3000, 9000):
        a = rnd.integers(0, 2**64, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 10] = rnd.integers(0, 2**64, n // 10, dtype=np.uint64)  # similarity 9 / 11 or more
        sets += [a, b[: n - n // 100]]
    maps = frame(spark, [(i, len(s), jaccard_join._bit_map(np.sort(s)).tolist()) for i, s in enumerate(sets)], schema)
    pairs = frame(spark, [(i, i + 1) for i in range(0, len(sets), 2)] + [(4, 7), (12, 15)], "a long, b long")
    open_ = rows_of(jaccard_join.promising(pairs, maps, 80, 100))
    assert open_ == sorted(((i, i + 1) for i in range(0, len(sets), 2)), key=repr)  # and unrelated sets of 250 and 3000 are ruled out
    assert sum(len(jaccard_join._bit_map(s)) * 64 for s in sets if len(s) > 256) <= 4 * sum(map(len, sets))


def test_jaccard_join_shingles_a_text_of_an_unrepeated_id_once(spark, monkeypatch):
    """Bit maps leave with the sketches; only ids that several rows have are checked against their node."""
    seen, real = [], jaccard_join._digests

    def digests(width):
        def run(batches):
            for batch in batches:
                checked.add(batch.num_rows)
                yield from real(width)(iter([batch]))

        return run

    checked = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(jaccard_join, "_digests", digests)
    monkeypatch.setattr(jaccard_join, "blocks", lambda *a, real=jaccard_join.blocks: (seen.append(a), real(*a))[1])
    rnd = random.Random(5)
    stems = [words(rnd, 60) for _ in range(6)]
    rows = [(10 * i + k, f"{s} tail{k % 2}") for i, s in enumerate(stems) for k in range(4)]
    brute = lambda rows: sorted(brute_components(rows, 3, 90, 100), key=repr)
    docs = frame(spark, [(d, t, "en", "s", 1) for d, t in rows])
    assert rows_of(jaccard_join.similar_components(docs)) == brute(rows) and checked.value == 0 and len(seen) == 1
    sketched = jaccard_join.sketches(docs.coalesce(1), 3, 90, 100)
    first = {r["s1"]: r["tag"] for r in sketched.groupBy("s1").agg(F.min("tag").alias("tag")).collect()}
    assert {r["tag"] for r in sketched.where("bits is not null").collect()} == set(first.values())
    messy = [*rows, (3, stems[5] + " tail0"), (None, stems[2] + " tail1"), (None, words(rnd, 9)), (0, words(rnd, 40))]  # ids with two texts, and none
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(frame(spark, [(d, t, "en", "s", 1) for d, t in messy])).collect() if r["doc_id"] not in (None, 0, 3)}
    assert checked.value > 0 and got[20] == got[21] == 20 and got[1] == got[2] == 0 and got[50] == got[52] == 3
