"""Readers: documents, engine payloads, lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import ingest_text, lines_of, trim, words_of
from .payloads import POINTS, parsed_payloads

RAW = "raw_text"


# Bytes of a stored table that one task takes where its rows become texts.
TASK_BYTES = 2 << 20


def task_count(df: DataFrame) -> int:
    """Tasks for the texts made of a table: several a core, and more as the table grows, so that no task does."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(3 * df.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), 100_000))


def shuffle_tasks(df: DataFrame) -> int:
    """Tasks behind a shuffle whose work is large beside its bytes: as many as it is set to have, and several a core."""
    return max(3 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Split a scan into enough tasks (``task_count``), as texts made of its rows are much larger; scans of as many splits stay as they are."""
    want = min_partitions or task_count(df)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def load_documents(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id",
                   text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``raw_text`` and the kept columns.

    ``fmt="text"`` reads one document per file and uses the file path as id.
    """
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("doc_id"), ingest_text(F.col("value")).alias(RAW))
    df = spark.read.format(fmt).load(path).select(id_col, text_col, *keep)
    return spread(df).select(F.col(id_col).alias("doc_id"), ingest_text(F.col(text_col)).alias(RAW), *keep)


def split_lines(df: DataFrame, text_col: str = RAW, keys=("doc_id",)) -> DataFrame:
    """Rows ``(keys, line_no, line)``: trimmed, blanks dropped, then numbered from 1."""
    return df.select(*keys, F.posexplode(lines_of(F.col(text_col))).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line")


def split_words(df: DataFrame, text_col: str = RAW, keys=("doc_id",)) -> DataFrame:
    return df.select(*keys, F.posexplode(words_of(F.col(text_col))).alias("pos", "word")).select(
        *keys, (F.col("pos") + 1).alias("pos"), "word")


def fold_language(lang: Column) -> Column:
    low = F.lower(F.coalesce(lang, F.lit("th")))
    return F.when(low.isin("tha", "thai", "th", "tha+eng", "th+en"), "th").when(
        low.isin("eng", "english", "en"), "en").otherwise(low)


def as_percent(score: Column) -> Column:
    return F.floor(F.when(score <= 1, score * 100).otherwise(score) * 100 + F.lit(0.5)) / 100


def region_type(text: Column, box: Column, height: Column) -> Column:
    """Header, footer, key-value, table row or text, by position and shape."""
    ys = F.transform(box, lambda p: F.element_at(p, 2))
    return (
        F.when(F.size(box) > 0, F.when(F.array_min(ys) < height * 0.13, "header").when(F.array_max(ys) > height * 0.88, "footer"))
        .otherwise(F.lit(None))
    )


def ingest_engine_json(df: DataFrame, payload: str = "payload", keys=("doc_id",), height: float | None = None) -> DataFrame:
    """Engine payloads of any shape to line rows; scores up to 1 become percentages, blanks drop.

    Lines keep their position in their result as ``line_no``. What gives no line is in ``rejected_payloads``.
    """
    rows = parsed_payloads(df, payload, keys).select(*keys, F.inline("lines")).where("not bad")
    text, box = F.col("text"), F.coalesce("box", F.array().cast(POINTS))
    shape = F.when(text.contains(":") & (F.length(text) <= 90), "key_value").when(
        F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 2, "table_row").otherwise("text")
    block = shape if height is None else F.coalesce(region_type(text, box, F.lit(height)), shape)
    return rows.where(text != "").select(*keys, "page_no", fold_language(F.col("lang")).alias("language"), "line_no", "text", as_percent(F.col("score")).alias("confidence"),
                                         box.alias("bounding_box"), block.alias("block_type"))


def rejected_payloads(df: DataFrame, payload: str = "payload", keys=("doc_id",)) -> DataFrame:
    """``(keys, page_no, line_no, reason, value)``: payloads without a line, and lines whose score is no number (with their text)."""
    rows = parsed_payloads(df, payload, keys)
    whole = rows.where("reason is not null").select(*keys, F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("int").alias("line_no"), "reason", F.col(payload).alias("value"))
    lines = rows.select(*keys, F.inline("lines")).where("bad and text <> ''").select(*keys, "page_no", "line_no", F.lit("score is no number").alias("reason"), F.col("text").alias("value"))
    return whole.unionByName(lines)


def text_layer_lines(df: DataFrame, text_col: str, keys=("doc_id", "page_no")) -> DataFrame:
    """Lines of an embedded text layer, numbered before blanks drop, at confidence 98."""
    rows = df.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("pos", "text"))
    return rows.select(*keys, (F.col("pos") + 1).alias("line_no"), trim(F.col("text")).alias("text"),
                       F.lit(98.0).alias("confidence")).where(F.col("text") != "")


def page_range(pages: DataFrame, spec: str, page_col: str = "page_no") -> DataFrame:
    """Keep the pages a spec such as ``1-3,7`` names; ``all`` keeps every page."""
    import re

    value = (spec or "all").strip().lower()
    if value in ("", "all", "*", "ทุกหน้า"):
        return pages
    test = F.lit(False)
    for chunk in filter(None, re.split(r"[,;\s]+", value)):
        ends = chunk.split("-", 1)
        if not all(e.isdigit() for e in ends):
            raise ValueError(f"invalid page spec: {chunk}")
        low, high = sorted((int(ends[0]), int(ends[-1])))
        test = test | F.col(page_col).between(low, high)
    return pages.where(test)


def page_numbers(spec: Column, total: Column) -> Column:
    """Per-row specs: ordered distinct page numbers, clamped to the page count."""
    chunks = F.filter(F.split(spec, r"[,;\s]+"), lambda c: c != "")

    def expand(c):
        a = F.greatest(F.lit(1), F.substring_index(c, "-", 1).try_cast("int"))
        b = F.least(total, F.substring_index(c, "-", -1).try_cast("int"))
        ok = F.substring_index(c, "-", 1).try_cast("int").isNotNull() & F.substring_index(c, "-", -1).try_cast("int").isNotNull()
        # A range beyond the last page is cut off there, so a long spec makes no long array.
        span = F.when(ok, F.sequence(F.least(a, b, total), F.least(F.greatest(a, b), total)))
        one = c.try_cast("int")
        return F.coalesce(F.when(c.contains("-"), span).when(one.between(1, total), F.array(one)), F.array().cast("array<int>"))

    everything = F.sequence(F.lit(1), total)
    return F.when(F.lower(F.trim(spec)).isin("", "all", "*", "ทุกหน้า"), everything).otherwise(
        F.array_distinct(F.flatten(F.transform(chunks, expand))))
