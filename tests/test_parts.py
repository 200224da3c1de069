"""Parts of ranking, gate and review that depend on optional inputs."""

from pyspark.sql import functions as F

from glyphmill.functions import classify as K
from glyphmill.operators import readings as V, rollups as A


def test_retry_bonus(spark):
    rows = [(1, "a", "total 100", 70, "success", 50, 70), (1, "b", "total 100", 70, "success", 60, 60), (1, "c", "total 100", 70, "success", None, 90)]
    df = spark.createDataFrame(rows, "doc_id int, engine_id string, text string, confidence int, status string, retry_before int, retry_after int")
    with_retry = {r["engine_id"]: r["rank_score"] for r in V.rank_engines(V.score_readings(df)).collect()}
    plain = {r["engine_id"]: r["rank_score"] for r in V.rank_engines(V.score_readings(df.drop("retry_before"))).collect()}
    assert round(with_retry["a"] - plain["a"], 1) == 5 and with_retry["b"] == plain["b"] and with_retry["c"] == plain["c"]


def test_candidates_are_a_reason(spark):
    gate = lambda n: K.text_quality_gate(F.lit("plain text"), F.lit("plain text"), F.lit(90), F.lit(0), n)["reasons"]
    row = spark.range(1).select(gate(None).alias("a"), gate(F.lit(1)).alias("b"), gate(F.lit(2)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (["ready"], ["ready"], ["candidates"])


def test_government_items_are_queued(spark):
    conflicts = spark.createDataFrame([(1, 1, "x", True, False, ["x", "y"])], "doc_id int, line_no int, selected string, conflict boolean, resolved boolean, candidates array<string>")
    issues = spark.createDataFrame([], "doc_id int, kind string, item string, reason string")
    reviews = spark.createDataFrame([(2, [("02-555", "phone", "check")] * 2)], "doc_id int, review array<struct<text:string,type:string,reason:string>>")
    assert {tuple(r) for r in A.review_queue(conflicts, issues, reviews=reviews).collect()} == {(1, "conflict", "x", "x | y"), (2, "phone", "02-555", "check")}


def test_engine_rollup(spark):
    words = spark.createDataFrame([(1, "a", "w", 50), (1, "a", "x", 51), (1, "a", " ", 0), (1, "b", "y", None)], "doc_id int, engine_id string, word string, confidence int")
    assert {tuple(r) for r in V.engine_rollup(words).collect()} == {(1, "a", 51, 2), (1, "b", None, 0)}
