"""Spelling variants, the quality classifier and hard negatives against brute force, and their edge cases."""

import collections
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from glyphmill.llm import catalog, quality, rtree, shared, spelling  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CLASH = "part string, id string, word string, n string, p string, s string, kind string, x string, run string, h string, block string, home string, row string, v string, asked string, label2 string"


def counted(docs, every, least=7):
    out = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                out[run] += 1
    return out


def variants(counts, least=2, factor=10):
    n = {w: c for w, c in counts.items() if c >= least and w}
    gaps, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1:]].add(w)
    for (a, b), some in gaps.items():
        some = some | ({a + b} & set(n))
        for w in some:
            near[w] |= some - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def messy_documents():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcß") for _ in range(rng.randint(5, 9))) for _ in range(250)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀÉÎõüýÿ", "zz" * 3000, "zz" * 3000 + "y"]
    words = base + [w[:k] + c + w[k:] for w in base[:60] for k, c in ((1, "a"), (len(w) - 1, "c"))] + [w[:3] + w[4:] for w in base[:60]] + [w[:2] + "x" + w[3:] for w in base[:60]]
    docs = [(i, " ".join(rng.choice(words[:1 + rng.randrange(len(words))]) for _ in range(150))) for i in range(60)]
    return docs + [(None, "Frequent-frequent2frequent"), (1, "frequent " * 300), (2, "frequemt " * 25 + "frequemts " * 2), (3, None), (4, ""), (3, "frequent×÷ĀbcdefgH"), (5, base[253] * 2)] * 2


@pytest.mark.parametrize("every,range_words", [(None, 100_000), (31, 40), (3, 7)])
def test_spelling(spark, every, range_words):
    docs = messy_documents()
    df = spark.createDataFrame([(i, t, *["c"] * 16) for i, t in docs], "doc_id long, text string, " + CLASH)
    counts = spelling.counted(df, every=every)
    assert {r["word"]: r["n"] for r in counts.collect()} == counted(docs, every)
    got = spelling.group_variants(counts, range_words=range_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(counted(docs, every))
    assert found(got) == want
    assert sum(r[0] is not None for r in want.values()) > 3


def test_spelling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(catalog.QUERIES["op11_trie_pairs"](spark, SMALL)) == variants(counted(docs, 31))


def test_spelling_small_tables(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(none).collect() == [] and spelling.group_variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    # Ties go to the smaller word; null and empty words and rare ones take no part.
    rows = [("b", 20), ("c", 20), ("aa", 200), ("a", 2), (None, 50), ("", 50), ("d", 1), ("ab", 2)]
    got = found(spelling.group_variants(spark.createDataFrame(rows, "word string, n long")))
    assert got == variants(dict(r for r in rows if r[0])) and got["a"][0] == "aa" and got["ab"][:2] == ("aa", "aa") and got["b"][:2] == (None, "b")
    chain = [("x" * k, 10**k) for k in range(1, 8)]
    got = found(spelling.group_variants(spark.createDataFrame(chain, "word string, n long")))
    assert {r[1] for r in got.values()} == {"x" * 7} and got["xx"][0] == "xxx"
    with pytest.raises(ValueError):
        spelling.group_variants(none, factor=1)


def test_node_numbers_agree_between_ranges():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(200)})
    splitters = [words[20], words[21], words[60] + "a"]
    seen = {}
    for part in range(4):
        some = [w for w in words if sum(s <= w for s in splitters) == part]
        nodes, first = spelling._range_nodes(some, part, splitters)
        for k, w in enumerate(some):
            mine = nodes[first[k]:first[k + 1]].tolist()
            shared_with = max(len(os.path.commonprefix([w, v])) for v in words if v != w)
            assert len(mine) > shared_with
            for depth, number in enumerate(mine):
                assert seen.setdefault(number, w[:depth]) == w[:depth]
    assert len(set(seen.values())) == len(seen)


def quality_tables(spark):
    rng = random.Random(2)
    fine, junk = [f"word{k}" for k in range(40)], [f"buy{k}!!" for k in range(40)]
    rows = [(i, " ".join(rng.choice(junk if i % 4 == 0 else fine) for _ in range(rng.randint(5, 60)))) for i in range(400)]
    odd = [(None, None), (None, "word1 word2"), (1000, ""), (1001, " \t\n"), (1002, "x" * 200000), (3, rows[3][1]), (1003, "word1 " * 30000), (1004, "日本語 ﷽ 123")]
    docs = spark.createDataFrame([(i, t, "l", "s", *["c"] * 16) for i, t in rows + odd], "doc_id long, text string, lang string, source string, " + CLASH)
    return docs, spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows] + [(None, 1), (5, None), (5, 1), (9999, 0)], "doc_id long, quality int"), rows, odd


def test_quality(spark):
    docs, labels, rows, odd = quality_tables(spark)
    held = F.expr("doc_id % 5 = 1")
    out = quality.classify(docs, labels, held, buckets=512, dim=32)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and r["doc_id"] % 5 == 1) for r in got)
    judged = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(judged) == 80 and sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in judged) >= 78
    twice = {r["score"] for r in got if r["doc_id"] == 3}
    assert len(twice) == 1 and len({round(r["score"], 12) for r in got if r["doc_id"] in (1000, 1001)}) == 1
    # Held-out labels are not learnt from, wherever they are; the order and number of parts of the table change nothing.
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs.repartition(7), wrong, held, buckets=512, dim=32).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    assert np.allclose([r["score"] for r in sorted(got, key=key)], [r["score"] for r in sorted(again, key=key)], atol=1e-9)


def test_quality_without_labels_or_texts(spark):
    docs, labels, rows, odd = quality_tables(spark)
    scores = lambda d, l: {r["score"] for r in quality.classify(d, l, buckets=64, dim=16).collect()}
    assert scores(docs, labels.limit(0)) == {0.5}
    assert scores(docs, labels.where("quality = 1")) == {1.0}
    assert scores(docs.limit(0), labels) == set()


def test_random_index_contexts():
    """Context sums equal a plain count over neighbours."""
    texts = ["a b, c a", "", "b b b", "é12 x"]
    hashes, first = quality.tokens(pa.array(texts))
    plain = [re.findall(r"[A-Za-z\u0080-￿]+|[0-9]+|[^\sA-Za-z0-9\u0080-￿]+", t) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    buckets, dim = 1 << 20, 16
    total, seen = quality.contexts(hashes, first, buckets, dim)
    single = {w: quality.contexts(hashes[[k, k]], np.array([0, 2]), buckets, dim)[0][int(hashes[k] % np.uint64(buckets))] / 2 for k, w in enumerate(flat)}
    want, times = collections.defaultdict(lambda: np.zeros(dim)), collections.Counter()
    for p in plain:
        for i, w in enumerate(p):
            for j in range(max(0, i - 2), min(len(p), i + 3)):
                if i != j:
                    want[w] += single[p[j]]
                    times[w] += 1
    for k, w in enumerate(flat):
        at = int(hashes[k] % np.uint64(buckets))
        assert np.array_equal(total[at], want[w]) and seen[at] == times[w]


def test_quality_query_on_held_out_labels(spark):
    got = catalog.QUERIES["op12_random_index"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got) / len(got)
    junk = [r["predicted"] for r in got if r["quality"] == 0]
    assert len(got) > 900 and right > 0.97 and junk.count(0) / len(junk) > 0.9


def vectors():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 5))
    rows = [(k, (centre[k % 6] + rng.normal(size=5) * 0.3).tolist(), int(k % 3)) for k in range(0, 260)]
    rows += [(300 + k, [0.5, 0.25, -0.5, 1.0, 0.0], k % 2) for k in range(40)]
    rows += [(20, rows[1][1], 0), (20, rows[20][1], 2), (20, rows[20][1], 2), (7, rows[9][1], 1)] + [(30, rows[30][1], 0)] * 3
    odd = [(500, None, 1), (501, [1.0, None, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 5, 1), (503, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (504, [1.0] * 5, None), (None, [1.0] * 5, 1),
           (510, [1.0, 2.0], 1), (511, [1.0, 2.0], 1), (512, [2.0, 1.0], 0), (520, [], 1), (530, [0.0] * 5, 1), (540, [-30000.0, 1e7, 0.0, 0.0, 1.0], 2)]
    return rows + odd


def brute_negatives(rows, is_anchor, positives, negatives, percent=(30, 90), scale=256):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(x * scale)) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if not is_anchor(i):
            continue
        others = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(kept) if b != a and len(w) == len(v)]
        best = sorted([(-s, j) for s, j, other in others if other == label])[:positives]
        for s, j in best:
            hard = sorted((-t, k) for t, k, other in others if other != label and percent[0] * -s <= 100 * t <= percent[1] * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,packet,parts", [(16384, 64, 1), (100, 3, 3), (7, 2, 4)])
def test_hard_negatives(spark, block_rows, packet, parts):
    rows = vectors()
    df = spark.createDataFrame([(*r, *["c"] * 16) for r in rows], "vec_id long, embedding array<double>, label int, " + CLASH).repartition(parts, "vec_id")
    got = rtree.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=4, negatives=6, block_rows=block_rows, packet=packet)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, lambda i: i % 10 == 0, 4, 6)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_on_small_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert rtree.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 2)], schema)
    assert rtree.hard_negatives(alone, F.col("vec_id") == 0).collect() == []
    assert rtree.hard_negatives(alone, F.col("vec_id") == 7).collect() == []


def test_tree_bounds_and_order():
    rng = np.random.default_rng(0)
    values = rng.integers(-300, 300, (1000, 6))
    order, begins = rtree.str_order(values, 16)
    assert sorted(order.tolist()) == list(range(1000)) and begins[0] == 0 and (np.diff(np.append(begins, 1000)) <= 16).all()
    same, _ = rtree.str_order(np.zeros((50, 3), int), 16)
    assert sorted(same.tolist()) == list(range(50))
    tree = rtree.Tree(np.arange(1000), np.zeros(1000, int), values[order], begins)
    q = rng.integers(-300, 300, 6)
    for exact, query in ((True, q.astype(float)), (False, q)):
        low, high = tree.bounds(0, slice(None), query, exact)
        for k in range(len(begins)):
            s = values[order][begins[k]:np.append(begins, 1000)[k + 1]] @ q
            assert low[k] <= s.min() and s.max() <= high[k]


def test_new_queries_on_small_tables(spark):
    for name, columns in (("op12_random_index", ["doc_id", "held_out", "score", "predicted"]), ("op13_rtree", ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])):
        out = catalog.QUERIES[name](spark, SMALL)
        assert out.columns[:len(columns)] == columns and out.count() > 0
    assert shared.table(spark, SMALL, "documents").count() == catalog.QUERIES["op12_random_index"](spark, SMALL).count()
