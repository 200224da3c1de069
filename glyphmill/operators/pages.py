"""Page tables: source choice, page features, accuracy report, document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as K, extract as E, predicates as R, scores as Q, text as P
from ..sources.exports import ordered_text


def choose_page_source(pages: DataFrame, strategy: str = "auto", margin: float = 12) -> DataFrame:
    """Text layer or engine text per page.

    ``pages`` holds ``layer_text``, ``ocr_text`` and ``ocr_confidence``. Scores
    are only computed for pages where both texts compete.
    """
    layer, ocr = P.trim(F.coalesce("layer_text", F.lit(""))), F.coalesce("ocr_text", F.lit(""))
    df = pages.withColumn("_layer", layer).withColumn("_ocr", ocr)
    had, usable = F.col("_layer") != "", R.usable(F.col("_layer"))
    use_ocr = {"text-first": ~usable, "ocr": F.lit(True), "compare": ~usable, "auto": ~had | ~usable, "auto-all": F.lit(True)}[strategy]
    df = df.withColumn("had_text_layer", had).withColumn("_usable", usable).withColumn("used_ocr", use_ocr)
    contest = F.col("used_ocr") & F.col("_usable") & F.lit(strategy.startswith("auto"))
    wins = F.when(contest, Q.ocr_text_score(F.col("_ocr"), F.col("ocr_confidence")) > Q.ocr_text_score(F.col("_layer"), F.lit(98)) + margin)
    method = F.when(~F.col("used_ocr"), F.when(F.col("_usable"), "text-layer").otherwise("ocr")).when(
        contest, F.when(wins, "mixed").otherwise("text-layer")).otherwise("ocr")
    df = df.withColumn("method", method)
    from_ocr = F.col("used_ocr") & (F.col("method") != "text-layer")
    return df.withColumn("raw_text", P.trim(F.when(from_ocr, F.col("_ocr")).otherwise(F.col("_layer")))).withColumn(
        "confidence", F.when(F.col("method") == "text-layer", 98).when(from_ocr, F.coalesce("ocr_confidence", F.lit(0))).otherwise(0)
    ).drop("_layer", "_ocr", "_usable")


def page_features(pages: DataFrame, x_spread: str | None = None) -> DataFrame:
    """Language, layout, size and the blank flag of each page."""
    text = F.col("raw_text")
    spread = F.col(x_spread) if x_spread else None
    return pages.withColumn("language", K.detect_language(text)).withColumn("layout", K.page_layout(text, spread)).withColumn(
        "char_count", F.length(P.compact(text))).withColumn("skipped_blank", R.blank(text))


def line_and_word_confidence(pages: DataFrame, keys=("doc_id", "page_no"), words: int | None = None, low_lines: int | None = None, low_words: int | None = None) -> DataFrame:
    """Low-confidence lines and words of a page, all of them unless display limits are given."""
    some = lambda a, n: a if n is None else F.slice(a, 1, n)
    base, method = F.col("confidence"), F.col("method")
    start = F.when(F.coalesce(base, F.lit(0)) == 0, 76).otherwise(base)
    lines = F.transform(P.lines_of(F.col("raw_text")), lambda x, i: F.struct(
        (i + 1).alias("line_no"), x.alias("text"), Q.line_confidence(x, base, method).alias("confidence")))
    tokens = F.transform(some(P.words_of(F.col("raw_text")), words), lambda x: F.struct(
        x.alias("text"), Q.line_confidence(x, base, method).alias("confidence")))
    return pages.withColumn(
        "low_lines", some(F.filter(lines, lambda x: x["confidence"] < F.greatest(F.lit(65), start - 14)), low_lines)).withColumn(
        "low_words", some(F.filter(tokens, lambda x: x["confidence"] < F.greatest(F.lit(60), start - 18)), low_words))


def page_accuracy_report(pages: DataFrame, check_set: str = "review") -> DataFrame:
    """Review flag, symbol score, entity, issue and suspicious counts per page."""
    clean = F.when(F.col("cleaned_text") != "", F.col("cleaned_text")).otherwise(F.col("raw_text"))
    df = pages.withColumn("_clean", clean).withColumn("_fields", E.important_fields(F.col("_clean")))
    issues = F.size(F.filter("_fields", lambda x: E.field_issue(x["type"], x["value"]).isNotNull()))
    df = df.withColumn("fields", F.size("_fields")).withColumn("field_issues", issues).withColumn(
        "suspicious", Q.suspicious_count(F.col("_clean"), check_set)).withColumn("symbol_score", Q.symbol_score(F.col("raw_text"), F.col("_clean")))
    review = (F.coalesce("confidence", F.lit(0)) < 75) | (F.col("field_issues") > 0) | (F.col("suspicious") > 0) | (F.col("symbol_score") < 92)
    return df.withColumn("source_kind", F.when(F.col("method") == "text-layer", "text-layer").otherwise("ocr")).withColumn(
        "review_required", review).drop("_clean", "_fields")


RULE = "━" * 36


def document_text(pages: DataFrame, keys=("doc_id",), separate: bool = True) -> DataFrame:
    """Page blocks joined in page order; blank pages are left out."""
    text = F.when(F.col("cleaned_text") != "", F.col("cleaned_text")).otherwise(F.col("raw_text"))
    block = F.concat(F.lit(RULE + "\nหน้า "), F.col("page_no").cast("string"), F.lit("\n" + RULE + "\n"), P.trim(text)) if separate else text
    rows = pages.where(~F.col("skipped_blank")).select(*keys, "page_no", block.alias("_block"))
    return ordered_text(rows, list(keys), "page_no", "_block", "document_text", "\n\n")


def document_blocks(pages: DataFrame, keys=("doc_id",), separate: bool = True) -> DataFrame:
    """``(keys, page_no, value)``: the block of each page that isn't blank, for an ordered export; a page without text says so."""
    text = F.when(F.col("cleaned_text") != "", F.col("cleaned_text")).otherwise(F.col("raw_text"))
    text = F.when(P.trim(F.coalesce(text, F.lit(""))) == "", F.lit("ไม่พบข้อความในหน้านี้")).otherwise(P.trim(text))
    block = F.concat(F.lit(RULE + "\nหน้า "), F.col("page_no").cast("string"), F.lit("\n" + RULE + "\n"), text) if separate else text
    return pages.where(~F.col("skipped_blank")).select(*keys, "page_no", block.alias("value"))
