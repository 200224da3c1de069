"""Stages of the pipeline on tables with odd columns and rows, and the whole of it."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from glyphmill.llm import secret_scan, sentencepiece_chunks, shared, toxicity  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SMALL = "/root/testdata/sf0.001"
NAMES = ["__row", "row", "hash", "doc", "found", "clean", "id", "copy", "times", "mixed", "kept", "judged", "size", "a.b", "c`d"]


def odd_columns(df):
    """``df`` with a map, a struct that holds a map, a variant, and columns named like those of the stages."""
    df = df.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("nest", F.struct(F.array("tags").alias("m"), F.col("source").alias("s")))
    df = df.withColumn("any", F.parse_json(F.lit("[1, {}]")))
    return df.select("*", *[F.lit(7 + k).alias(c) for k, c in enumerate(NAMES)])


def documents(spark):
    prose = " ".join(f"w{k}" for k in range(40))
    rows = [(1, prose), (2, prose), (None, prose), (3, "api_key = " + "Ab9" * 8), (4, None), (5, ""), (6, "x " * 40), (6, "y " * 40 + "z"), (None, None), (7, "long " * 20000)]
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def plain(df, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns(spark, name, step):
    docs = documents(spark)
    wide = odd_columns(docs)
    out = step(spark, wide, SMALL)
    assert out.dtypes == wide.dtypes
    assert plain(out, docs.columns) == plain(step(spark, docs, SMALL), docs.columns)
    for r in out.select("*").collect():
        assert [r[c] for c in NAMES] == [7 + k for k in range(len(NAMES))] and r["tags"] == {"k": r["doc_id"]} and r["nest"]["s"] == r["source"]
    none = step(spark, wide.limit(0), SMALL)
    assert none.columns == wide.columns and none.count() == 0


def test_last_stage(spark):
    docs = documents(spark)
    got = sorted(map(str, corpus_pipeline.encode(spark, odd_columns(docs), SMALL).collect()))
    assert got == sorted(map(str, corpus_pipeline.encode(spark, docs, SMALL).collect())) and len(got) == docs.count()
    assert corpus_pipeline.encode(spark, docs.limit(0), SMALL).count() == 0


def test_redact(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, docs, SMALL).collect()}
    assert "Ab9" not in got[3]["text"] and got[3]["n_chars"] == len(got[3]["text"]) and got[4]["text"] is None and got[1]["text"] == documents(spark).where("doc_id = 1").first()["text"]


def test_run(spark):
    """The rows of ``run`` are those of its stages done one by one in plain Python or by the operator itself."""
    out = corpus_pipeline.run(spark, SMALL).collect()
    docs = shared.table(spark, SMALL, "documents")
    labels = shared.table(spark, SMALL, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    toxic = {r["doc_id"] for r in toxicity.classify(docs, labels).where("is_toxic").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in toxic}
    groups = brute.near([(i, r["text"]) for i, r in rows.items()], 80)
    kept = docs.where(F.col("doc_id").isin([i for i, g in groups.items() if g[2]]))
    spans = {r["doc_id"]: r for r in secret_scan.scan(kept).collect()}
    clean = corpus_pipeline.redact_secrets(spark, kept, SMALL)
    assert {r["doc_id"] for r in clean.collect() if r["text"] != rows[r["doc_id"]]["text"]} == {i for i, r in spans.items() if any(r[k] for k in ("assign", "access", "hex", "entropy"))}
    mixed = corpus_pipeline.mix_sources(spark, clean, SMALL)
    import public_tokenizers

    model = sentencepiece_chunks.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], len(r["ids"]), brute.sha(" ".join(map(str, r["ids"])))) for r in sentencepiece_chunks.encode(mixed, model).collect())
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in out) == want
