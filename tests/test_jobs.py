from pyspark.sql import functions as F

from conftest import SMALL
from glyphmill.operators import matching as M, readings as V
from glyphmill.plans import catalog
from glyphmill.sources import fixtures as S
from glyphmill.streaming import streams as T


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_decision_is_a_candidate(spark):
    df = spark.createDataFrame([(1, f"ocr-{k}", t, 80, "success") for k, t in enumerate(["a b", "A  b", "ab", "x", ""], 1)],
                               "doc_id int, engine_id string, text string, confidence int, status string")
    row = V.majority_line(V.align_candidates(df)).first()
    assert row.decision == "a b" and row.reason == "Majority vote 3/5" and row.confidence == 92


def test_self_diff_is_empty(spark):
    rows = S.engine_lines(spark, SMALL).select(F.col("doc_id").alias("pair_id"), "page_no", "line_no", F.col("text").alias("line"))
    assert M.diff_lines(rows, rows).count() == 0


def test_cluster_vote(spark):
    texts = ["total 100 baht", "total 100 bahT", "tota1 100 baht", "zzz", "total 100 baht"]
    df = spark.createDataFrame([(1, f"ocr-{k}", t, 80, "success") for k, t in enumerate(texts, 1)],
                               "doc_id int, engine_id string, text string, confidence int, status string")
    row = V.cluster_vote(V.align_candidates(df, squeeze=True)).first()
    assert row.conflict and row.selected == "total 100 baht" and row.votes == 4 and row.resolved


def test_neighbour_vote_keeps_backbone(spark):
    df = spark.createDataFrame([(1, "ocr-1", "hel|o w{rld\nline two", 1), (1, "ocr-2", "extra\nhello world\nline two", 0)],
                               "doc_id int, engine_id string, text string, score int")
    rows = [r.line for r in V.neighbour_vote(df).orderBy("line_no").collect()]
    assert rows == ["hello world", "line two"]


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(2).write.parquet(str(src))
    T.stream_clean(spark, str(src), docs.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.doc_id, r.cleaned_text, r.confidence) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = T.clean_stream(docs.withColumn("raw_text", F.translate(F.coalesce("text", F.lit("")), " \r", " ")))
    assert got == {(r.doc_id, r.cleaned_text, r.confidence) for r in batch.collect()}
