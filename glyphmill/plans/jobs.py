"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import classify as K, extract as E, predicates as R, scores as Q, text as P
from ..operators import fields as FD, lines as L, matching as M, pages as PG, readings as V
from ..operators.clean import REVIEW_STEPS, clean_text
from ..operators.lexicon import apply_table
from ..operators.rules import accuracy_spell
from ..sources.exports import append_keep_last_n, ordered_text, write_ordered
from ..sources.staging import read_version, staged, write_version
from ..sources.tables import page_range, spread, task_count

REVIEW_ITEM = "array<struct<text:string,type:string,reason:string>>"
HEADER = "บันทึกข้อความ|หนังสือราชการ|ส่วนราชการ"
CODE_LIKE = r"\d+[/\-.]\d+|[ก-ฮA-Z]{1,6}\.?\s*\d+|วันที่|โทร|พ.ศ.|๒๕[0-9๐-๙]{2}"


def _review(text: Column, kind, reason: str) -> Column:
    return F.struct(text.alias("text"), (kind if isinstance(kind, Column) else F.lit(kind)).cast("string").alias("type"), F.lit(reason).alias("reason"))


def government_review(docs: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Review of government documents; every step works inside the document row.

    Adds clean_text, structure counts, corrections, removed noise, uncertain
    parts, must-check items, warnings and a confidence.
    """
    # An explode and not a filter: a filter on a computed value would move below the exchange that spreads the documents, and repeat the value there.
    kind = F.filter(F.array(K.government_type(F.col(text_col))), lambda k: k.isNotNull())
    df = docs.select(*[F.col(c) for c in docs.columns if c != "document_type"], F.explode(kind).alias("document_type"))
    df = df.withColumn("_l", P.squeezed_lines_of(F.col(text_col)))
    df = df.withColumn("_at", F.array_position(F.transform("_l", lambda x: P.has(x, HEADER)), F.lit(True)).cast("int"))
    df = df.withColumn("_head", F.when(F.col("_at") > 1, F.slice("_l", F.lit(1), F.greatest(F.lit(0), F.col("_at") - 1))).otherwise(F.array().cast("array<string>")))
    tagged = F.transform("_head", lambda x: F.struct(x.alias("x"), F.when(P.has(x, CODE_LIKE), "code").when(
        Q.meaning_score(x) < 25, "noise").otherwise("unclear").alias("k")))
    df = df.withColumn("_head", tagged)
    df = df.withColumn("removed_noise", F.transform(F.filter("_head", lambda t: t["k"] == "noise"), lambda t: t["x"]))
    df = df.withColumn("_body", F.array_join(F.slice("_l", F.greatest(F.lit(1), F.col("_at")), F.greatest(F.size("_l"), F.lit(1))), "\n"))
    df = df.withColumn("_spans", E.protected_spans(F.col("_body"), E.SENSITIVE))
    df = df.withColumn("_masked", E.mask_spans(F.col("_body"), F.size("_spans"), E.SENSITIVE))
    fired, text = [], F.col("_masked")
    for r in fixed.rules("government"):
        fired.append(F.when(text.contains(r.pattern), F.struct(F.lit(r.pattern).alias("wrong"), F.lit(r.replacement).alias("correct"))))
        text = F.replace(text, F.lit(r.pattern), F.lit(r.replacement))
    df = df.withColumn("corrections", F.filter(F.array(*fired), lambda x: x.isNotNull())).withColumn("_masked", text)
    df = df.withColumn("clean_text", E.restore_spans(F.col("_masked"), F.col("_spans")))
    df = df.withColumn("_parts", E.memo_structure(F.col("clean_text")))
    df = df.withColumn("found", E.parts_found(F.col("_parts"))).withColumn("year_warning", K.budget_year_warning(F.col("clean_text")))
    missing = F.transform(F.filter("_parts", lambda p: (p["value"] == "") & ~p["found"]), lambda p: p["name"])
    df = df.withColumn("uncertain", F.concat(missing, F.when(F.col("year_warning"), F.array(F.lit("budget_year_unlikely"))).otherwise(
        F.array().cast("array<string>"))))
    by_hand, recheck = "sensitive_value", "compare_with_page"
    phone, mac = E.SENSITIVE[1], E.SENSITIVE[2]
    items = F.concat(
        F.transform(F.filter("_head", lambda t: t["k"] == "code"), lambda t: _review(t["x"], F.lit(None), "code_before_heading")),
        F.transform(F.filter("_head", lambda t: t["k"] == "unclear"), lambda t: _review(t["x"], F.lit(None), "unclear_before_heading")),
        F.transform("_spans", lambda s: _review(s, E.span_type(s, E.SENSITIVE), by_hand)),
        F.transform(P.find_all(F.col("clean_text"), phone[1], "i"), lambda s: _review(P.squeeze(s), phone[0], recheck)),
        F.transform(P.find_all(F.col("clean_text"), mac[1], "i"), lambda s: _review(P.squeeze(s), mac[0], recheck)),
    )
    df = df.withColumn("review", F.array_distinct(items.cast(REVIEW_ITEM)))
    score = 60 + F.col("found") * 5 - F.size("corrections") - F.size("uncertain") * 4 - F.size("review") * 2
    df = df.withColumn("confidence", P.clamp(score, 40, 96).cast("int"))
    return df.drop("_l", "_at", "_head", "_body", "_spans", "_masked", "_parts")


def polish_final(df: DataFrame, col: str) -> DataFrame:
    """Profile-driven closing polish, or the rescue text of a broken encoding."""
    c = F.col(col)
    df = df.withColumn("_profile", K.document_profile(c)["profile"])
    good = F.array_join(F.filter(P.squeezed_lines_of(c), lambda x: ~R.is_broken_line(x)), "\n")
    df = df.withColumn("_good", good)
    df = df.withColumn("_good", F.when(F.col("_profile") == "gov", P.polish_government(F.col("_good"))).otherwise(F.col("_good")))
    tidy = P.sub(P.sub(F.col("_good"), r"\bwu\s*[:;]?\b", "", "i"), r"\b[5S][๒2][ลlI1][๐0O][๐0O][2๒]\b", "")
    tidy = F.array_join(F.filter(F.transform(F.split(tidy, "\n"), P.squeeze), lambda x: x != ""), "\n")
    return df.withColumn(col, F.when(F.col("_profile") == "rescue", E.rescue_text(c)).otherwise(tidy)).withColumn(
        "profile", F.col("_profile")).drop("_profile", "_good")


def consensus(candidates: DataFrame, keys=("doc_id",), level: str = "safe", full_score: bool = True) -> DataFrame:
    """Line votes over the engine readings, cleaning, issue penalties, strict filter, polish."""
    keys = list(keys)
    decided = V.majority_line(V.align_candidates(candidates, keys=keys), full_score=full_score)
    # The lines of a document are still together, so one pass over them serves text, confidence and mismatches.
    parts = F.sort_array(F.collect_list(F.when(F.col("decision") != "", F.struct("line_no", "decision"))))
    lines = decided.groupBy(*keys).agg(F.avg("confidence").alias("row_confidence"), F.sum(V.readings_differ(F.col("r")).cast("int")).alias("mismatches"),
                                       F.array_join(F.transform(parts, lambda x: x["decision"]), "\n").alias("base_text"))
    df = V.engine_counts(candidates, keys).join(lines, keys, "left").fillna({"base_text": "", "row_confidence": 0.0, "mismatches": 0})
    df = clean_text(df, "base_text", level)
    for step in REVIEW_STEPS:
        df = df.withColumn("cleaned_text", step(F.col("cleaned_text")))
    kinds = (F.col("mismatches") > 0).cast("int") + (F.col("uncertain") > 0).cast("int") + V.text_issues(F.col("cleaned_text"))
    df = df.withColumn("_doc_issues", kinds).withColumn("issues", F.col("_doc_issues") + (F.col("failed") > 0).cast("int"))
    bonus = F.when(F.col("successful") >= 5, 6).when(F.col("successful") >= 3, 2).otherwise(-8)
    first = P.clamp(P.half_up(F.col("row_confidence") * 0.56 + F.col("engine_confidence") * 0.44 + bonus - F.least(F.lit(18), F.col("issues") * 4)))
    df = df.withColumn("review_1", first)
    df = df.withColumn("review_2", P.clamp(F.col("review_1") + F.when(F.col("_doc_issues") > 0, -3).otherwise(4)))
    df = df.withColumn("confidence", P.clamp(P.half_up((F.col("review_1") + F.col("review_2")) / 2)))
    # Read twice, so written once.
    df = staged(df.select(*keys, "cleaned_text", "confidence", "mismatches", "failed", "issues", "review_1", "review_2"), "consensus")
    strict = L.strict_review(df, "cleaned_text", keys).select(*keys, F.array_join(F.transform("kept", lambda x: x["clean"]), "\n").alias("final_text"), "removed")
    df = df.join(strict, keys, "left").fillna({"final_text": "", "removed": 0})
    penalty = F.when(F.col("removed") > 0, -F.least(F.lit(24), F.col("removed") * 4)).otherwise(4)
    df = df.withColumn("confidence", F.when(F.col("final_text") == "", F.col("confidence")).otherwise(P.clamp(F.col("confidence") + penalty)))
    df = df.withColumn("final_text", F.when(F.col("final_text") == "", F.col("cleaned_text")).otherwise(F.col("final_text")))
    df = polish_final(df, "final_text")
    return df.select(*keys, "final_text", F.col("confidence").cast("int").alias("confidence"), "profile", "mismatches", "failed", "issues", "removed", "review_1", "review_2")


def ensemble(candidates: DataFrame, keys=("doc_id",), dictionary: DataFrame | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """Ranked readings, cluster vote, corrections, government review, fields and final confidence.

    ``dictionary(word)`` and ``corrections(rule, wrong, correct)`` are tables of any size.
    """
    keys = list(keys)
    ranked = V.rank_engines(V.score_readings(candidates, keys=keys), keys)
    low = F.size("uncertain_words") if "uncertain_words" in candidates.columns else F.lit(0)
    ok = F.col("status") == "success"
    best = F.max_by(F.struct("engine_id", "confidence", "completeness"), -F.col("rank"))
    per_doc = ranked.groupBy(*keys).agg(
        F.avg(F.when(ok, F.col("agreement"))).alias("agreement"), F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence"),
        best.alias("best"), F.sum(low).alias("low_words"), F.bool_or(V.improved(ranked)).alias("improved"))
    aligned = V.align_candidates(candidates.where(ok & (F.col("text") != "")), keys=keys, squeeze=True)
    voted = V.cluster_vote(aligned, dictionary)
    # The lines of a document are still together, so one pass over them serves both the counts and the text.
    parts = F.sort_array(F.collect_list(F.struct("line_no", "selected")))
    lines = voted.groupBy(*keys).agg(F.sum(F.col("conflict").cast("int")).alias("conflicts"), F.sum(F.col("resolved").cast("int")).alias("resolved"),
                                     F.array_join(F.transform(parts, lambda x: x["selected"]), "\n").alias("voted_text"))
    df = per_doc.join(lines, keys, "left").fillna({"conflicts": 0, "resolved": 0, "voted_text": ""})
    vote = P.clamp(F.coalesce("mean_confidence", F.lit(0.0)) * 0.48 + F.col("resolved") / F.greatest(F.lit(1), F.col("conflicts")) * 38
                   + F.least(F.lit(14.0), F.size(P.words_of(F.col("voted_text"))) / 12))
    df = df.withColumn("vote_confidence", P.one_decimal(vote))
    df = df.withColumnRenamed("voted_text", "text") if corrections is None else apply_table(df, corrections, "voted_text")
    # Read twice, so written once; the few files are spread again.
    df = spread(staged(df, "ensemble"))
    gov = government_review(df.select(*keys, "text"), "text").select(
        *keys, F.col("document_type").alias("gov_type"), F.col("clean_text").alias("gov_text"), F.col("confidence").alias("gov_confidence"),
        F.col("year_warning").cast("int").alias("gov_warnings"), F.size("review").alias("gov_review"))
    df = df.join(gov, keys, "left").withColumn("final_text", F.coalesce("gov_text", "text"))
    df = FD.with_fields(df, "final_text")
    df = df.withColumn("_type", F.coalesce("gov_type", "_type"))
    df = df.withColumn("_v", E.validate_document(F.col("final_text"), FD.field_columns()))
    df = df.withColumn("validation", F.col("_v.score")).drop("_v")
    unresolved = F.col("conflicts") - F.col("resolved")
    df = df.withColumn("warnings", (F.col("validation") < 60).cast("int") + (unresolved > 0).cast("int") + F.coalesce("gov_warnings", F.lit(0))
                       + F.coalesce((F.col("gov_review") > 0).cast("int"), F.lit(0)))
    best_conf = F.when(F.coalesce("best.confidence", F.lit(0)) > 0, F.col("best.confidence")).otherwise(F.coalesce("mean_confidence", F.lit(0.0)))
    second = F.when(F.col("gov_type").isNotNull(), F.col("gov_confidence") * 0.55 + F.col("validation") * 0.25 + F.col("best.confidence") * 0.20 - F.col("warnings") * 3).otherwise(
        F.col("vote_confidence") * 0.44 + F.col("validation") * 0.36 + F.col("best.confidence") * 0.20 - F.col("warnings") * 4)
    df = df.withColumn("logic_confidence", P.one_decimal(P.clamp(second)))
    resolved_pct = F.when(F.col("conflicts") > 0, F.col("resolved") / F.col("conflicts") * 100).otherwise(100.0)
    logic = F.when(F.col("validation") > 0, F.col("validation")).otherwise(F.col("logic_confidence"))
    final = Q.final_confidence(F.coalesce("agreement", F.lit(0.0)), best_conf, logic, resolved_pct, F.col("best.completeness"), F.col("low_words"), F.col("warnings"), F.col("improved"))
    source = F.when(F.col("gov_type").isNotNull(), "government review").otherwise("document logic")
    return df.withColumn("final_confidence", final).select(
        *keys, "final_text", F.col("_type").alias("document_type"), "final_confidence", "vote_confidence", "logic_confidence", "validation",
        "conflicts", "resolved", "warnings", F.struct(
            F.col("best.engine_id").alias("best_engine"), source.alias("final_source"), P.one_decimal(F.coalesce("agreement", F.lit(0.0))).alias("agreement"),
            P.one_decimal(resolved_pct).alias("resolved_pct"), "low_words").alias("explanation"))


def paged_documents(pages: DataFrame, strategy: str = "auto", level: str = "safe", spec: str = "all", items: DataFrame | None = None, keys=("doc_id", "page_no")) -> DataFrame:
    """Page table: selected pages, chosen source, features, low-confidence parts, cleaned text, accuracy report.

    ``spec`` names pages (``1-3,7``); ``items`` are positioned items with the same keys, from which the layout sees columns.
    """
    df = page_range(pages, spec)
    if items is not None:
        wanted = page_range(items, spec) if "page_no" in keys else items
        # The pages are cleaned behind the join, in as many tasks as this makes of them.
        df = df.repartition(task_count(pages), *keys).join(M.item_spread(wanted, keys), list(keys), "left")
    df = PG.page_features(PG.choose_page_source(df, strategy), None if items is None else "x_spread")
    df = PG.line_and_word_confidence(df)
    return PG.page_accuracy_report(clean_text(df, "raw_text", level))


def export_documents(pages: DataFrame, path: str, parts: int | None = None) -> None:
    """The text of all documents of a page table, page after page, as ordered part files."""
    write_ordered(PG.document_blocks(pages), path, ["doc_id", "page_no"], sep="\n\n", parts=parts)


def accuracy_upgrade(candidates: DataFrame, cleaned: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Neighbour vote taken when its score is within four points, pair fixes, reformat."""
    keys = list(keys)
    merged = ordered_text(V.neighbour_vote(candidates, keys=keys), keys, "line_no", "line", "_voted")
    df = cleaned.join(merged, keys, "left").fillna({"_voted": ""})
    df = df.withColumn("_voted", accuracy_spell(F.col("_voted"))).withColumn("_voted", K.accuracy_reformat(F.col("_voted")))
    better = (F.col("_voted") != "") & (Q.accuracy_text_score(F.col("_voted")) > Q.accuracy_text_score(F.col("cleaned_text")) - 4)
    df = df.withColumn("voted", better).withColumn("_out", F.when(F.col("voted"), F.col("_voted")).otherwise(F.col("cleaned_text")))
    df = df.withColumn("_out", accuracy_spell(F.col("_out"))).withColumn("layout", K.accuracy_layout(F.col("_out")))
    return df.withColumn("upgraded_text", K.accuracy_reformat(F.col("_out"))).drop("_voted", "_out")


def batch_report(docs: DataFrame, level: str = "safe") -> DataFrame:
    """Cleaned text, fixes, confidence and quality level of every file."""
    df = clean_text(docs, "raw_text", level)
    df = df.withColumn("_susp", Q.suspicious_count(F.col("cleaned_text"), "review"))
    df = df.withColumn("confidence", Q.clean_confidence(F.col("raw_text"), F.col("cleaned_text"), F.size("fixes"), F.col("_susp")))
    level_ = F.when(F.col("confidence") >= 85, "good").when(F.col("confidence") >= 70, "warn").otherwise("bad")
    return df.withColumn("level", level_).withColumn("n_fixes", F.size("fixes")).withColumnRenamed("_susp", "suspicious")


def text_quality(c: Column) -> Column:
    return P.half_up(Q.ocr_text_score(c, F.lit(80)))


def benchmark_runs(texts: DataFrame, keys=("item_id",), level: str = "safe") -> DataFrame:
    """Raw against enhanced reading with ground truth: the better one and its error rates."""
    keys = list(keys)
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("raw").alias("_in")), F.struct(F.lit(1).alias("k"), F.col("enhanced").alias("_in")))
    df = clean_text(texts.select(*keys, "truth", F.inline(both)), "_in", level)
    df = df.select(*keys, "truth", "k", "cleaned_text").withColumn("score", text_quality(F.col("cleaned_text")))
    # The aggregate also keeps the optimizer from repeating the cleaning in each metric.
    best = F.max_by(F.struct("cleaned_text", "score"), F.struct("score", "k")).alias("best")
    df = df.groupBy(*keys).agg(F.max("truth").alias("truth"), best, F.max(F.when(F.col("k") == 0, F.col("score"))).alias("raw_score"))
    df = df.withColumn("final_text", F.col("best.cleaned_text")).withColumn("final_score", F.col("best.score"))
    rates = M.error_rates(df, keys, "truth", "final_text")
    metrics = [Q.token_accuracy(F.col("truth"), F.col("final_text"), p, f).alias(f"{n}_accuracy") for n, (p, f) in Q.TOKEN_CLASSES.items()]
    df = df.select(*keys, "raw_score", "final_score", "final_text", Q.symbol_score(F.col("truth"), F.col("final_text")).alias("symbol_accuracy"), *metrics)
    return df.join(rates, keys, "left")


RUN_COLUMNS = ["raw_score", "final_score", "symbol_accuracy", "cer", "wer", "thai_cer", *[f"{n}_accuracy" for n in Q.TOKEN_CLASSES]]


def log_benchmark(texts: DataFrame, root: str, engine: str, created_at, keep: int = 150, level: str = "safe") -> DataFrame:
    """Run the benchmark over ``texts(item_id, name, truth, raw, enhanced, quality_score)`` and append it to the run log under ``root``.

    The log is a versioned table: the new version is written whole and then seen, with the newest ``keep`` runs of each engine. Returns it.
    """
    spark = texts.sparkSession
    runs = benchmark_runs(texts.select("item_id", "truth", "raw", "enhanced"), level=level)
    named = texts.select("item_id", F.col("name"), F.col("quality_score").cast("double").alias("quality_score"))
    new = runs.join(named, "item_id").select(F.col("item_id").cast("string").alias("id"), F.lit(created_at).cast("timestamp").alias("created_at"), "name", F.lit(engine).alias("engine"), "quality_score",
                                             *[F.col(c).cast("double").alias(c) for c in RUN_COLUMNS], "final_text")
    log = read_version(spark, root)
    write_version(append_keep_last_n(new if log is None else log, None if log is None else new, ["engine"], "created_at", keep, "id"), root)
    return read_version(spark, root)


__all__ = [
    "accuracy_upgrade", "batch_report", "benchmark_runs", "consensus", "ensemble", "export_documents", "government_review", "log_benchmark", "paged_documents", "polish_final",
]
