"""Rule and word tables against plain replacement, one rule after the other."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphmill.operators import lexicon as LX, rollups as A
from glyphmill.sources import staging


def plain(text, rules):
    used = []
    for number, wrong, correct in sorted(rules):
        if wrong in text:
            used.append({"rule": number, "times": text.count(wrong)})
            text = text.replace(wrong, correct)
    return text, used


BIT = st.text("abก", min_size=1, max_size=4)


@settings(max_examples=600, deadline=None)
@given(st.text("abก ", max_size=40), st.lists(st.tuples(BIT, BIT), max_size=8))
def test_rules_act_in_order(text, pairs):
    rules = [(k, *p) for k, p in enumerate(pairs)]
    assert LX.Lexicon(rules).replace(text) == plain(text, rules)


@settings(max_examples=300, deadline=None)
@given(st.text("abก", max_size=30), st.sets(BIT, max_size=6))
def test_counts(text, words):
    rows = list(enumerate(sorted(words)))
    assert LX.Lexicon(rows).counts(text) == {k: text.count(w) for k, w in rows if w in text}


RULES = [(3, "tne", "the"), (5, "the cat", "a cat"), (1, " c4t ", "cat"), (2, "c4t", "cat"), (7, "", "x"), (8, "same", "same"), (9, None, "x"), (10, "a cat", "tne dog"), (12, "dog", "dogs"), (13, "zz", "z")]


@pytest.mark.parametrize("limit", [2_000_000, 8, 1])
def test_table_in_slices(spark, limit):
    texts = [(1, "tne c4t"), (2, "the c4t dog zzzz"), (3, None), (4, ""), (5, "tne c4t " * 400)]
    docs = spark.createDataFrame(texts, "doc_id long, raw_text string")
    rules = spark.createDataFrame(RULES, "rule long, wrong string, correct string").withColumn("used", F.lit(2))
    done = LX.apply_table(docs, rules, "raw_text", limit=limit)
    live = [(n, w.strip(), c.strip()) for n, w, c in RULES if w and c and w.strip() != c.strip()]
    got = {r["doc_id"]: (r["text"], [u.asDict() for u in r["used"]]) for r in done.collect()}
    want = {i: plain(t, live) if t is not None else (None, []) for i, t in texts}
    assert got == want
    uses = {r["rule"]: r["used"] for r in LX.count_used(rules, done).collect()}
    assert uses == {n: 2 + sum(u["rule"] == n for _, us in want.values() for u in us) for n, _, _ in RULES}
    none = LX.apply_table(docs, rules.limit(0), "raw_text")
    assert {r["doc_id"]: r["text"] for r in none.collect()} == dict(texts)


def test_a_hundred_thousand_rules(spark):
    rng = random.Random(1)
    rules = [(k, f"w{k:06d}x", f"W{k}") for k in range(100_000)]
    texts = [(i, " ".join(rng.choice(rules)[1] for _ in range(50))) for i in range(200)]
    done = LX.apply_table(spark.createDataFrame(texts, "doc_id long, raw_text string"), spark.createDataFrame(rules, "rule long, wrong string, correct string"), "raw_text").collect()
    names = {w: c for _, w, c in rules}
    assert {r["doc_id"]: r["text"] for r in done} == {i: " ".join(names[w] for w in t.split()) for i, t in texts}


def test_guarded_rules(spark):
    rules = spark.createDataFrame([(1, "ab", "abcdefgh"), (2, "12", "xx"), (3, "cd", "ef")], "rule long, wrong string, correct string")
    out = LX.apply_table(spark.createDataFrame([(1, "ab 12 cd")], "doc_id long, raw_text string"), rules, "raw_text", guarded=True).first()
    assert out["text"] == "ab 12 ef"


@pytest.mark.parametrize("limit", [2_000_000, 3])
def test_count_words(spark, limit):
    docs = spark.createDataFrame([(1, "URL url aaaa"), (2, None), (3, "Ab ab")], "doc_id long, raw_text string")
    words = spark.createDataFrame([("URL",), ("url",), ("aa",), ("ab",), ("zz",), ("",), (None,), ("aa",)], "word string")
    assert {tuple(r) for r in LX.count_words(docs, words, limit=limit).collect()} == {("URL", 2), ("url", 2), ("aa", 2), ("ab", 2)}
    assert LX.count_words(docs, words.limit(0)).collect() == []
    assert {r["word"] for r in A.vocabulary_counts(docs, ["url", "x"]).collect()} == {"url"}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "rules")
    assert staging.read_version(spark, root) is None and staging.read_version(spark, root, "rule long").count() == 0
    for k in range(5):
        before = staging.read_version(spark, root, "rule long")
        staging.write_version(before.union(spark.createDataFrame([(k,)], "rule long")), root, keep=2)
    assert staging.versions(spark, root) == [4, 5]
    assert {r["rule"] for r in staging.read_version(spark, root).collect()} == set(range(5)) and staging.read_version(spark, root, number=4).count() == 4
    spark.range(3).write.parquet(f"{root}/version-00000009/_temporary/0")
    assert staging.versions(spark, root) == [4, 5]
