"""Stages of the training-data pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``, of any type and under any name: a stage that adds columns of its own keeps the row as one
struct beside them. ``doc_id``, ``text``, ``source`` and ``n_chars`` must be there. Rows are judged by themselves, whatever ids they
share or lack; each function states what becomes of null and empty texts. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import minhash, mixing, secret_scan, sentencepiece_chunks, toxicity
from .shared import keyed, named, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on ``labels``, doesn't judge toxic. Null and empty texts stay."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.keep_clean(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id (a null id comes last). Texts without words are linked with nothing and stay."""
    rows = keyed(docs, "rows")
    judged = minhash.near_duplicates(rows.select("row", F.col("doc.text").alias("text")), id_col="row", threshold=0.8).select(F.col("doc_id").alias("judged"), "component_id")
    order = rows.select("row", F.struct(F.col("doc.doc_id").isNull().alias("last"), F.col("doc.doc_id").alias("id"), "hash", "row").alias("place"))
    first = judged.join(order, F.col("judged") == F.col("row")).groupBy("component_id").agg(F.min("place").alias("first"))
    return rows.join(first.select(F.col("first.row").alias("kept")), F.col("row") == F.col("kept"), "left_semi").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span found replaced in the text; ``n_chars`` follows where the text changed. A null text stays null."""
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"))
    text = F.coalesce("doc.text", F.lit(""))
    spans = rows.withColumn("found", F.concat(*[secret_scan.fixed_spans(text, k[0]) for k in secret_scan.KINDS], secret_scan.entropy_spans(text)))
    clean = spans.withColumn("clean", F.when(F.size("found") > 0, secret_scan.redact(F.col("doc.text"), F.col("found"))))
    new = {"text": F.coalesce("clean", "doc.text"), "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean").cast("long")).otherwise(F.col("doc.n_chars"))}
    return clean.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whole: the words taken over its size, rounded; rows without words once."""
    rows = keyed(docs, "rows")
    # Rows without an id are shuffled by their content.
    name = F.coalesce(F.col("doc.doc_id").cast("string"), F.concat(F.lit("null "), "hash"))
    plain = rows.select("row", "hash", name.alias("id"), F.col("doc.text").alias("text"), F.col("doc.source").alias("source"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    mixed = mixing.mix(plain, id_col="id", keys=("hash", "row")).select(F.col("row").alias("mixed"), times.alias("times"))
    taken = rows.join(mixed.where("times > 0"), F.col("row") == F.col("mixed"))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row, as numbers and digests. A null text has the end id alone."""
    import public_tokenizers

    out = sentencepiece_chunks.encode(docs, sentencepiece_chunks.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("source_mix", mix_sources), ("sentencepiece", encode)]
