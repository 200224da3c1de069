"""Steps mended for the findings of round 3: the same results, with less work a row."""

import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.functions import distance as DI, extract as E, predicates as R, text as P
from glyphmill.operators import lexicon as LX, matching as M, windows as WI
from glyphmill.patterns import java
from glyphmill.plans import jobs as G
from glyphmill.sources import tables as T

from test_scale_steps import TEXTS, lev


def test_first_better_words():
    rng = random.Random(3)
    word = lambda: (rng.choice("ab") + "x" * rng.randint(0, 9), float(rng.randint(0, 9)))
    for _ in range(200):
        bad, words = [word() for _ in range(rng.randint(0, 9))], [word() for _ in range(rng.randint(0, 40))]
        want = [next((k for k, (w, s) in enumerate(words) if w[0] == b[0] and abs(len(w) - len(b)) <= 4 and s > t + 2), None) for b, t in bad]
        assert DI.first_better_words(bad, words, 2, 4) == want


def test_learned_pairs_leave_the_row_alone(spark):
    """A document of n new words is n rows, not n rows with all its words in each."""
    edits = spark.createDataFrame([(1, "w0rd", "w{rd word wordy"), (2, None, "x"), (3, "abc", None), (4, "same", "same")], "doc_id long, raw string, edited string")
    found = M.learn_corrections(edits.withColumn("raw", F.replace("raw", F.lit("w0rd"), F.lit("w{rd wxx"))))
    assert [(r["doc_id"], r["wrong"], r["correct"]) for r in found.collect()] == [(1, "wxx", "wordy")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generate = [line for line in plan.split("\n") if "Generate" in line]
    assert len(generate) == 1 and "inline" in generate[0]


def test_bounds_hold_the_distance():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        low, high = DI.bounds(DI.codes(a), DI.codes(b))
        assert low <= lev(a, b) <= high
    text = "the moon over the old wood " * 400
    assert DI.bounds(DI.codes(text), DI.codes(text.replace("o", "0"))) == (text.count("o"),) * 2
    assert DI.bounds(DI.codes(text), DI.codes(text.replace("o", ""))) == (text.count("o"),) * 2
    wide = np.array([1, 1 << 20, 5, 7])
    assert DI.bounds(wide, np.array([1, 1 << 20, 5, 9])) == (1, 1)


def test_aligned_lines_carry_no_texts(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nc"), (2, None, "x")], "doc_id long, ref string, hyp string")
    out = M.align_lines(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, 1, 1, "a", "a"), (1, 1, 2, None, "b", None), (1, 2, 3, 2, "c", "c"), (2, 0, None, 1, None, "x")], key=str)
    # The rows that leave the explode hold the pair and the key alone.
    generate = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in line)
    assert "_r#" not in generate.split("], false, [")[1] and "Project [doc_id" in out._jdf.queryExecution().optimizedPlan().toString()


def test_spread_of_items(spark):
    items = spark.createDataFrame([(1, 0, 10.0), (1, 1, 30.4), (1, 2, 90.0), (None, 3, 5.0), (2, 4, None), (3, 5, 7.5), (3, 6, 7.5), (3, 7, 48.0)], "doc_id long, item_id long, x double")
    assert {tuple(r) for r in M.item_spread(items).collect()} == {(1, 80.0, 2), (3, 40.5, 2)}
    old = M.item_columns(items).groupBy("doc_id").agg((F.max("x") - F.min("x")).alias("x_spread"), F.countDistinct("column_no").alias("columns"))
    assert {tuple(r) for r in old.collect()} == {tuple(r) for r in M.item_spread(items).collect()}
    # No join of the items with their columns.
    assert "Join" not in M.item_spread(items)._jdf.queryExecution().optimizedPlan().toString()


def test_entity_parts_are_in_every_entity(spark):
    texts = [*TEXTS, "http://a.b A@B.CO 1.2.3.4 00-1a:2B:3c:4D:55 $ 5 12 thb 3บาท 1-2-24 9:05 x.co v1.2 case-123 increase", "5 uSd", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.concat(*[E._tagged(P.find_all(F.col("t"), p, "i" if n == "amount" else f), n) for n, p, f in E.ENTITIES])
    rows = df.select(plain.alias("a"), E.important_fields(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a or ()) for r in rows) > 15
    assert set(E.ENTITY_PARTS) < {n for n, _, _ in E.ENTITIES}


def test_plain_words_hold_no_span(spark):
    texts = [*TEXTS, "increase the case, INC; errors a@b.co see v1.2 and C:\\x y https://a.b/c, word.word wo-rd", "plain, words; only and\nmore", "case CASE12 required"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = "|".join("(?i:" + java(p) + ")" if "i" in f else "(?:" + java(p) + ")" for _, p, f in E.PROTECTED)
    rows = df.select(F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("a"), E.protected_spans(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_review_tests_its_documents_after_they_are_spread(spark):
    docs = spark.createDataFrame([(1, "บันทึกข้อความ\nเรื่อง x"), (2, "plain"), (3, None)], "doc_id long, raw_text string")
    out = G.government_review(docs.repartition(5))
    assert [r["doc_id"] for r in out.collect()] == [1]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan[plan.index("Repartition"):]


def test_more_tasks_for_larger_tables(spark, tmp_path, monkeypatch):
    spark.range(20000).selectExpr("id", "cast(xxhash64(id) as string) as s").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    least = 3 * spark.sparkContext.defaultParallelism
    assert T.task_count(df) == least
    monkeypatch.setattr(T, "TASK_BYTES", 1000)
    assert T.task_count(df) > 5 * least and T.spread(df).rdd.getNumPartitions() == T.task_count(df)


def test_fingerprints_of_windows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abก") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    filled = np.zeros(8192, np.uint8)
    for k in range(WI.PROBES):
        for place in WI.places(WI.keys_of(words), 65536, k).tolist():
            filled[place >> 3] |= 1 << (place & 7)
    lengths = sorted({len(w) for w in words})
    texts = ["", *["".join(rng.choice("abก") for _ in range(rng.randint(0, 30))) for _ in range(40)]]
    keys = dict(zip(words, WI.keys_of(words).view(np.int64).tolist()))
    for text, found in zip(texts, WI.text_keys(texts, lengths, filled)):
        assert {keys[w] for w in words if w in text} == found
    assert WI.text_keys([], lengths, filled) == []


def test_many_rules_write_the_texts_twice(spark, monkeypatch):
    """Whatever the number of rules; cut into slices, the texts were written once for each of them."""
    kept = []
    monkeypatch.setattr(LX, "staged", lambda df, kind, real=LX.staged: kept.append(kind) or real(df, kind))
    rules = spark.range(300).selectExpr("id as rule", "concat('w', lpad(cast(id as string), 3, '0')) as wrong", "concat('w', lpad(cast(id + 1 as string), 3, '0'), '.') as correct")
    docs = spark.createDataFrame([(1, "w299 x w299"), (2, "none"), (3, None), (1, "w298")], "doc_id long, raw_text string")
    done = LX.apply_table(docs, rules, "raw_text", limit=100)
    # The last text takes two rules, of which the change by the first calls for the second.
    assert {(r["doc_id"], r["text"], len(r["used"])) for r in done.collect()} == {(1, "w300. x w300.", 1), (2, "none", 0), (3, None, 0), (1, "w300..", 2)}
    assert kept.count("texts") == 1 and kept.count("ruled") == 2
    same = LX.apply_table(docs, rules, "raw_text", "raw_text", limit=100)
    assert same.columns == ["doc_id", "raw_text", "used"] and {(r["doc_id"], r["raw_text"]) for r in same.collect()} == {(r["doc_id"], r["text"]) for r in done.collect()}
    assert done.columns == ["doc_id", "raw_text", "text", "used"]


def test_deep_cascades_end_slice_by_slice(spark):
    rules = spark.range(40).selectExpr("id as rule", "concat('w', lpad(cast(id as string), 3, '0')) as wrong", "concat('w', lpad(cast(id + 1 as string), 3, '0'), '.') as correct")
    docs = spark.createDataFrame([(1, "w020"), (2, "w039"), (3, None)], "doc_id long, raw_text string")
    done = LX.apply_table(docs, rules, "raw_text", limit=100).collect()
    assert {(r["doc_id"], r["text"], len(r["used"])) for r in done} == {(1, "w040" + "." * 20, 20), (2, "w040.", 1), (3, None, 0)}


def test_parts_of_memos(spark):
    texts = ["เรื่อง x\nที่ กค 1\nจึงเรียนมาเพื่อโปรดทราบ (นาย กข)", "เรื่อง \nส่วนราชการ\n", "ส่วนราชการ  a b ที่ 3", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    plain = F.array(*[F.struct(F.lit(n).alias("name"), P.squeeze(P.find(c, p)).alias("value"), P.has(c, p).alias("found")) for n, p in E.STRUCTURE])
    assert all(r.a == r.b for r in df.select(plain.alias("a"), E.memo_structure(c).alias("b")).collect())


def test_mojibake_of_clean_texts(spark):
    texts = [*TEXTS, "b~ M:I QJ C9l", "b~ m:i", "1'u ~ ... e:J e:i \x0b-oooo", "E:J fle:J U~V VHN", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for variant, signs in R.MOJIBAKE.items():
        hits = sum((P.has(c, p.replace(r"\v", r"\x0B"), f).cast("int") for p, f in signs), F.lit(0))
        thai = P.count(c, "[ก-ฮ]{3,}")
        clue = P.has(c, R.ENCODING_CLUE, "i")
        little = (thai < 8) if variant == "document" else (thai < 12) | (P.count(c, "[A-Za-z~'`:]{2,}") > thai * 2)
        rows = df.select(((hits >= 3) & (little | clue)).alias("a"), R.mojibake(c, variant).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(r.a for r in rows)


def test_pages_are_cleaned_in_many_tasks(spark):
    pages = spark.createDataFrame([(k, 1, "text layer of a page", "text", 70) for k in range(50)], "doc_id long, page_no int, layer_text string, ocr_text string, ocr_confidence int")
    items = pages.select("doc_id", "page_no", F.lit(3.0).alias("x"))
    out = G.paged_documents(pages, items=items).select("doc_id", "columns", "cleaned_text")
    assert len(out.collect()) == 50 and "RepartitionByExpression [doc_id" in out._jdf.queryExecution().optimizedPlan().toString()
