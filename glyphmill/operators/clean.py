"""Level-based cleaning of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import extract as E, scores as Q, text as P
from ..functions.predicates import is_ui_garbage
from .rules import accuracy_spell, apply_rules, join_rules, join_spaced_words, typed_fixes

THAI = "[\u0e00-\u0e7f]"
LEVELS = ("raw", "light", "safe", "normal", "strict", "aggressive")
_NO_FIXES = "array<struct<from:string,to:string,type:string>>"


def drop_ui_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_ui_garbage(x)), "\n")


def _close(c: Column) -> Column:
    c = P.normalize_repeats(c)
    c = P.sub(c, rf"\s+([{P.TONES}])", "$1")
    c = P.sub(c, r"([เแโใไ])\s+", "$1")
    c = P.sub(c, r"([ก-ฮ])\s+([่้๊๋์])", "$1$2")
    return P.drop_garbage_lines(P.trim(P.sub(P.sub(c, r"\s{2,}", " "), r"\n\s+", "\n")))


# The closing review, one projection per step so that no step is inlined twice.
REVIEW_STEPS = (
    P.normalize_ip_like,
    P.repair_email_domain,
    lambda c: join_spaced_words(P.fold_set(c, "final_direct"), fixed.words("review")),
    P.normalize_ip_like,
    P.repair_email_domain,
    _close,
)


def clean_text(df: DataFrame, text_col: str = "raw_text", level: str = "safe", corrections=(), extra_rules=()) -> DataFrame:
    """Add ``cleaned_text`` and ``fixes``.

    Entities stay untouched, and a result that loses too many symbols falls
    back to the normalised raw text (not at level ``aggressive``). Everything up
    to level ``safe`` is native except the logged exact corrections, which only
    see rows holding Thai; the stages stay narrow, so no shuffle is added.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    raw = P.ws_normalize(F.col(text_col))
    df = df.withColumn("_raw", raw)
    if level == "raw":
        return df.withColumn("cleaned_text", F.col("_raw")).withColumn(
            "fixes", F.array().cast(_NO_FIXES)).drop("_raw")
    # One step per projection: a Python function inside a projection makes the
    # optimizer inline every step below it.
    df = df.withColumn("_norm", P.nfc(F.col("_raw"))).withColumn("_norm", P.reattach(F.col("_norm")))
    df = df.withColumn("_spans", E.protected_spans(F.col("_raw")))
    df = df.withColumn("_text", E.mask_spans(F.col("_raw"), F.size("_spans")))
    df = df.withColumn("_text", P.nfc(F.col("_text"))).withColumn("_text", P.reattach(F.col("_text")))
    if level == "light":
        df = df.withColumn("_text", P.fix_capture(F.col("_text"))).withColumn("fixes", F.array().cast(_NO_FIXES))
        return _finish(df, level)
    exact = list(fixed.rules("exact"))
    if level == "safe":
        df = apply_rules(df, exact, "_text", only_if=P.has(F.col("_text"), THAI))
    else:
        df = apply_rules(df, exact + list(fixed.rules("dictionary")) + list(extra_rules), "_text")
        df = df.withColumn("_text", accuracy_spell(F.col("_text"), list(corrections)))
        df = df.withColumn("_text", P.repair_email_domain(F.col("_text")))
        spelling = list(fixed.rules("wrong_words")) + join_rules(fixed.correct_words(), thai_only=True)
        df = apply_rules(df, spelling, "_text", only_if=P.has(F.col("_text"), THAI + "|ITNT|0CR|Pv4|(?i:mask|gateway|dhcp|lease|scnan)"))
        df = df.withColumn("_text", P.repair_email_domain(F.col("_text")))
    if level in ("strict", "aggressive"):
        df = df.withColumn("_text", P.strip_strange(F.col("_text"))["text"])
        thai_rules = list(fixed.rules("noise")) + list(fixed.rules("thai_pairs")) + join_rules(fixed.words("join")) + list(fixed.rules("split_words"))
        df = apply_rules(df, thai_rules, "_text")
        df = apply_rules(df.withColumn("_text", drop_ui_lines(F.col("_text"))), fixed.rules("ui"), "_text")
        joined = lambda c: join_spaced_words(c, fixed.words("join"))
        df = df.withColumn("_text", drop_ui_lines(F.col("_text")))
        df = df.withColumn("_text", P.collapse_repeats(F.col("_text"), joined))
    df = df.withColumn("_text", P.fix_capture(F.col("_text")))
    df = _finish(df.withColumn("fixes", typed_fixes(F.col("fixes"))), level)
    if level == "strict":
        for step in REVIEW_STEPS:
            df = df.withColumn("cleaned_text", step(F.col("cleaned_text")))
    return df


def line_trim(c: Column) -> Column:
    return F.array_join(P.lines_of(c), "\n")


def _finish(df: DataFrame, level: str) -> DataFrame:
    df = df.withColumn("_out", E.restore_spans(F.col("_text"), F.col("_spans")))
    out = F.col("_out")
    if level != "aggressive":
        out = F.when(Q.symbol_score(F.col("_raw"), out) < 92, F.col("_norm")).otherwise(out)
    return df.withColumn("cleaned_text", line_trim(out)).drop("_raw", "_out", "_norm", "_text", "_spans")
