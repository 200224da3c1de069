"""Consensus over several engine readings of the same document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores as Q, text as P
from ..functions.distance import align_arrays, alike_table
from ..functions.predicates import mojibake
from ..sources.tables import shuffle_tasks
from .dictionary import match_texts
from .rules import accuracy_spell


# An entry of the dictionary nearer than this takes the place of its readings.
TAKEN = 0.82


def normal_key(c: Column) -> Column:
    """Comparison key of a line or word: lower case, no whitespace, no bars."""
    return F.translate(F.lower(c), P.WS + "\u200b|", "")


def reading_lines(candidates: DataFrame, keys=("doc_id",), text: str = "text", squeeze: bool = False) -> DataFrame:
    split = P.squeezed_lines_of if squeeze else P.lines_of
    rows = candidates.select(*keys, "engine_id", "confidence", F.posexplode(split(F.coalesce(F.col(text), F.lit("")))).alias("pos", "line"))
    return rows.select(*keys, "engine_id", "confidence", (F.col("pos") + 1).alias("line_no"), "line")


def align_candidates(candidates: DataFrame, keys=("doc_id",), text: str = "text", squeeze: bool = False) -> DataFrame:
    """Line *i* of every reading of a document side by side, whatever the engines are called.

    ``r`` is an array in engine order of STRUCT<engine, text, confidence>; a reading without that line keeps its confidence. One row a
    reading is shuffled, and the lines are laid side by side inside the document's row.
    """
    split = P.squeezed_lines_of if squeeze else P.lines_of
    reading = F.struct(F.col("engine_id").alias("engine"), split(F.coalesce(F.col(text), F.lit(""))).alias("lines"), F.coalesce("confidence", F.lit(0)).alias("confidence"))
    # The work on the lines is large beside their bytes, so their number is not left to be reduced by these.
    spread = candidates.select(*keys, reading.alias("_r")).repartition(shuffle_tasks(candidates), *keys)
    wide = spread.groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    most = F.array_max(F.transform("_r", lambda x: F.size(x["lines"])))
    # The sides are laid out before they are exploded, so that no row of a line carries the whole document.
    side = lambda i: F.transform("_r", lambda x: F.struct(x["engine"].alias("engine"), F.coalesce(F.get(x["lines"], i), F.lit("")).alias("text"), x["confidence"].alias("confidence")))
    rows = wide.where(most > 0).select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), most - 1), side)).alias("_pos", "r"))
    return rows.select(*keys, (F.col("_pos") + 1).alias("line_no"), "r")


def majority_line(aligned: DataFrame, min_votes: int = 3, full_score: bool = True) -> DataFrame:
    """Decision per line: at least ``min_votes`` equal keys, else the best-scored reading.

    ``full_score=False`` ranks by the cheap line score without the text score.
    """
    keyed = F.transform("r", lambda x: F.struct(normal_key(x["text"]).alias("k"), x["text"].alias("text"), x["confidence"].alias("confidence")))
    df = aligned.withColumn("_k", keyed)
    votes = lambda x: F.size(F.filter("_k", lambda y: y["k"] == x["k"]))
    winners = F.filter("_k", lambda x: (x["k"] != "") & (votes(x) >= min_votes))
    df = df.withColumn("_w", F.get(winners, F.lit(0)))
    df = df.withColumn("_n", F.when(F.col("_w").isNotNull(), F.size(F.filter("_k", lambda y: y["k"] == F.col("_w.k")))))
    score = (lambda x: Q.consensus_line_score(x["text"], x["confidence"])) if full_score else (
        lambda x: x["confidence"] * 0.8 + F.length(P.compact(x["text"])) * 0.22)
    # Only lines without a majority are scored.
    open_rows = F.when(F.col("_w").isNull(), F.col("_k"))
    ranked = F.transform(open_rows, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x")))
    df = df.withColumn("_best", F.array_min(ranked)["x"])
    fallback = P.clamp(P.half_up(F.col("_best.confidence") - 8 + F.least(F.lit(18.0), F.length("_best.k") / 8)))
    return df.select(
        *[c for c in aligned.columns],
        F.coalesce("_w.text", "_best.text").alias("decision"),
        F.when(F.col("_w").isNotNull(), F.concat(F.lit("Majority vote "), F.col("_n").cast("string"), F.lit("/"), F.size("r").cast("string")))
        .otherwise("Best scored reading").alias("reason"),
        F.when(F.col("_w").isNotNull(), F.least(F.lit(99), 86 + F.col("_n") * 2)).otherwise(fallback).cast("int").alias("confidence"),
    )


def diff_words(decided: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Each reading's words against the decided line: matched and differing words."""
    wanted = F.transform(P.words_of(F.col("decision")), normal_key)
    rows = decided.select(*keys, "line_no", wanted.alias("_d"), F.inline("r"))
    words = P.words_of(F.col("text"))
    known = lambda w: F.array_contains(F.col("_d"), normal_key(w))
    return rows.where(F.col("text") != "").select(
        *keys, "line_no", "engine", F.size(F.filter(words, known)).alias("matched"),
        F.filter(words, lambda w: ~known(w)).alias("differing"))


def cluster_vote(aligned: DataFrame, dictionary: DataFrame | None = None, min_sim: float = 0.76) -> DataFrame:
    """Greedy similarity clusters per line; the best-scored cluster decides.

    At most one reading per engine takes part, so the fold is over a handful of
    items inside one row. Readings that agree up to case are not in conflict.
    ``dictionary`` is a table of words of any size: a cluster gains by entries
    that are near or part of its readings, and takes over one nearer than 0.82.
    """
    readings = F.transform(F.filter("r", lambda x: x["text"] != ""), lambda x: F.struct(
        P.squeeze(x["text"]).alias("text"), x["confidence"].alias("confidence")))
    df = aligned.withColumn("_r", readings).where(F.size("_r") > 0)
    df = df.withColumn("_texts", F.transform("_r", lambda x: x["text"]))
    df = df.withColumn("conflict", F.size(F.array_distinct(F.transform("_texts", lambda t: F.lower(t)))) > 1)
    cluster_t = "array<struct<anchor:string,items:array<string>>>"

    df = df.withColumn("_t", F.when(F.col("conflict"), F.array_distinct("_texts")))
    if dictionary is None:
        df = df.withColumn("_e", F.array().cast("array<string>"))
    else:
        df = match_texts(df, "_t", dictionary, "_m")
        df = df.withColumn("_m", F.map_from_arrays("_t", "_m"))
        df = df.withColumn("_e", F.transform("_t", lambda t: F.when(F.element_at("_m", t)["similarity"] > TAKEN, F.element_at("_m", t)["entry"])))
    plain = lambda c: F.transform(c, lambda t: F.lower(P.squeeze(t)))
    df = df.withColumns({"_tn": plain("_t"), "_en": plain("_e")})
    df = df.withColumn("_like", alike_table(F.col("_tn"), F.col("_en"), min_sim))

    def like(t, other):
        """Whether a reading is alike the text with number ``other``: readings from 1, then the entries taken for them."""
        return F.get("_like", ((F.array_position("_t", t) - 1) * (F.size("_t") + F.size("_e")) + other - 1).cast("int"))

    def place(acc, t):
        homes = F.transform(acc, lambda c: like(c["anchor"], F.array_position("_t", t)))
        at = F.array_position(homes, F.lit(True))
        grown = F.transform(acc, lambda c, i: F.when(i + 1 == at, F.struct(c["anchor"].alias("anchor"), F.concat(c["items"], F.array(t)).alias("items"))).otherwise(c))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(t.alias("anchor"), F.array(t).alias("items")))))

    fold = F.aggregate(F.when(F.col("conflict"), F.col("_texts")), F.array().cast(cluster_t), place)
    df = df.withColumn("_clusters", fold)

    def word_score(t):
        return F.lit(0) if dictionary is None else F.element_at("_m", t)["score"]

    def suggestion(t):
        none = F.struct(F.lit(0.0).alias("s"), F.lit("").alias("w"))
        if dictionary is None:
            return none
        near = F.element_at("_m", t)
        return F.when(near["similarity"].isNotNull(), F.struct(near["similarity"].alias("s"), near["entry"].alias("w"))).otherwise(none)

    def first_longest(items):
        return F.array_min(F.transform(items, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))["t"]

    def describe(c):
        ranked = F.transform(c["items"], lambda t, i: F.struct(
            (-(word_score(t) + suggestion(t)["s"])).alias("n"), i.alias("i"), word_score(t).alias("d"), suggestion(t).alias("g")))
        best = F.array_min(ranked)
        return F.struct(c["items"].alias("items"), best["d"].alias("d"), best["g"].alias("g"))

    df = df.withColumn("_d", F.transform("_clusters", describe))
    df = df.withColumn("_d", F.transform("_d", lambda c: F.struct(
        c.alias("c"), F.when(c["g"]["s"] > TAKEN, c["g"]["w"]).otherwise(first_longest(c["items"])).alias("pick"))))
    df = df.withColumn("_d", F.transform("_d", lambda x: F.struct(
        x["c"].alias("c"), x["pick"].alias("pick"), F.when(x["c"]["g"]["s"] > TAKEN, F.size("_t") + F.array_position("_e", x["pick"])).otherwise(F.array_position("_t", x["pick"])).alias("at"))))

    def rate(x, i):
        size = F.size(x["c"]["items"])
        boost = F.aggregate("_r", F.lit(0.0), lambda a, r: a + F.when(like(r["text"], x["at"]), r["confidence"].cast("double")).otherwise(0.0)) / size
        return F.struct((-(size * 26 + boost * 0.45 + x["c"]["d"] * 0.18 + x["c"]["g"]["s"] * 18)).alias("s"), i.alias("i"), x["pick"].alias("pick"), size.alias("n"))

    df = df.withColumn("_best", F.array_min(F.transform("_d", rate)))
    confidence = P.clamp(-F.col("_best.s"))
    keep = [c for c in aligned.columns if c != "r"]
    return df.select(
        *keep, "conflict", F.coalesce("_best.pick", F.get("_texts", F.lit(0))).alias("selected"),
        F.when(F.col("conflict"), confidence).alias("confidence"), F.coalesce("_best.n", F.size("_texts")).alias("votes"),
        (F.col("conflict") & (confidence >= 60)).alias("resolved"), F.col("_texts").alias("candidates"),
    )


def engine_agreement(candidates: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Mean share of an engine's distinct words found in each other successful engine, in whole percent.

    One aggregate brings the word sets of a document side by side. All shares of an engine have one denominator, so the mean is rounded
    in whole numbers.
    """
    words = F.array_distinct(F.transform(P.words_of(F.coalesce("text", F.lit(""))), lambda w: F.lower(w)))
    reading = F.struct(F.col("engine_id").alias("engine_id"), (F.col("status") == "success").alias("ok"), words.alias("w"))
    wide = candidates.select(*keys, reading.alias("_r")).groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("_r"))

    def agreement(me):
        others = F.filter("_r", lambda y: (y["engine_id"] != me["engine_id"]) & y["ok"])
        common = F.aggregate(others, F.lit(0).cast("long"), lambda n, y: n + F.size(F.array_intersect(me["w"], y["w"])))
        size, k = F.size(me["w"]).cast("long"), F.size(others).cast("long")
        value = F.when((size > 0) & (k > 0), F.floor((common * 200 + size * k) / (size * k * 2))).otherwise(F.lit(0)).cast("long")
        return F.struct(me["engine_id"].alias("engine_id"), value.alias("agreement"))

    return wide.select(*keys, F.inline(F.transform("_r", agreement)))


def rank_score(confidence, agreement, logic, complete, low_words, broken, improved) -> Column:
    raw = (
        F.coalesce(confidence, F.lit(0)) * 0.32 + agreement * 0.24 + logic * 0.24 + complete * 0.20
        - F.least(F.lit(30.0), low_words * 1.5) - F.when(broken, 70).otherwise(0) + F.when(improved, 5).otherwise(0)
    )
    return P.one_decimal(P.clamp(raw))


def score_readings(candidates: DataFrame, keys=("doc_id",), hint: Column | None = None) -> DataFrame:
    """Completeness, document logic and agreement of every reading."""
    from ..functions import extract as E
    from .fields import FIELD_COLS, field_columns, with_fields

    ok = F.col("status") == "success"
    df = with_fields(candidates, "text", hint)
    df = df.withColumn("completeness", F.when(ok, Q.completeness(F.col("text"))).otherwise(0.0))
    logic = E.document_logic(F.col("text"), field_columns(), F.col("completeness"))
    df = df.withColumn("logic", F.when(ok, logic).otherwise(0.0)).drop(*FIELD_COLS)
    agree = engine_agreement(candidates.withColumn("status", F.when(mojibake(F.col("text"), "engine"), "broken").otherwise(F.col("status"))), keys)
    df = df.join(agree, [*keys, "engine_id"], "left")
    return df.withColumn("agreement", F.when(ok, F.coalesce("agreement", F.lit(0))).otherwise(F.lit(0)))


def improved(df: DataFrame) -> Column:
    """Whether a second attempt at a reading raised its confidence, from ``retry_before`` and ``retry_after`` where they are given."""
    if not {"retry_before", "retry_after"} <= set(df.columns):
        return F.lit(False)
    return F.coalesce(F.col("retry_after") > F.col("retry_before"), F.lit(False))


def rank_engines(scored: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Rank score, rank and best flag; ties keep the engine order. A reading that a retry has improved gains."""
    low = F.size(F.coalesce("uncertain_words", F.array().cast("array<string>"))) if "uncertain_words" in scored.columns else F.lit(0)
    score = rank_score(F.col("confidence"), F.col("agreement"), F.col("logic"), F.col("completeness"), low,
                       mojibake(F.col("text"), "engine"), improved(scored))
    df = scored.withColumn("rank_score", score)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rank_score").desc(), "engine_id"))
    df = df.withColumn("rank", rank)
    return df.withColumn("is_best", (F.col("rank") == 1) & (F.col("status") == "success"))


def top_candidates(scored: DataFrame, n: int = 4, keys=("doc_id",), score: str = "score") -> DataFrame:
    """Non-empty candidates, best ``n`` per document; the limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "engine_id"))
    return scored.where(P.trim(F.col("text")) != "").withColumn("rank", rank).where(F.col("rank") <= n)


def neighbour_vote(candidates: DataFrame, voters: int = 5, min_sim: float = 0.45, keys=("doc_id",), score: str = "score", align: bool = False) -> DataFrame:
    """Backbone lines replaced by a clearly better reading of the same line.

    Lines of the best candidate are the backbone. A voter's line *j* is offered to backbone lines j-1, j and j+1 by equi-key, so each
    group holds at most 1 + 3 x ``voters`` lines. With ``align`` a voter's lines are paired with the backbone first and each is offered
    to its partner only, so that a voter which lost lines still votes on all the others.
    """
    keys = list(keys)
    ranked = top_candidates(candidates, voters + 1, keys, score)
    if align:
        texts = ranked.select(*keys, "rank", F.transform(F.split("text", "\n"), lambda c: accuracy_spell(c)).alias("_l"))
        base_lines = texts.where("rank = 1").select(*keys, F.col("_l").alias("_b"))
        paired = texts.where("rank > 1").join(base_lines, keys).select(*keys, "rank", "_l", align_arrays(F.col("_b"), F.col("_l"), min_sim).alias("_p"))
        paired = paired.select(*keys, "rank", "_l", F.inline("_p")).where("left is not null and right is not null")
        offers = base_lines.select(*keys, F.lit(1).alias("rank"), F.posexplode("_b").alias("j", "line")).withColumn("i", F.col("j")).unionByName(
            paired.select(*keys, "rank", F.col("right").alias("j"), F.get("_l", F.col("right")).alias("line"), F.col("left").alias("i")))
        offers = offers.withColumn("s", Q.accuracy_line_score(F.col("line")))
    else:
        rows = ranked.select(*keys, "rank", F.posexplode(F.split("text", "\n")).alias("j", "line"))
        # Scored before it is offered three times.
        rows = rows.withColumn("line", accuracy_spell(F.col("line")))
        rows = rows.withColumn("s", Q.accuracy_line_score(F.col("line")))
        offers = rows.select(*keys, "rank", "j", "line", "s", F.explode(
            F.when(F.col("rank") == 1, F.array("j")).otherwise(F.array(F.col("j") - 1, F.col("j"), F.col("j") + 1))).alias("i"))
    grouped = offers.groupBy(*keys, "i").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("line", "s"))).alias("_base"),
        F.sort_array(F.collect_list(F.when((F.col("rank") > 1) & (F.col("line") != ""), F.struct("rank", "j", "line", "s")))).alias("offers"),
    ).where(F.col("_base").isNotNull())
    base = F.col("_base.line")
    start = F.struct(base.alias("line"), F.col("_base.s").alias("s"))

    def swap(acc, o):
        s = o["s"]
        better = (s > acc["s"] + 2) & (s > 0) & (Q.overlap_similarity(base, o["line"]) >= min_sim)
        return F.when(better, F.struct(o["line"].alias("line"), s.alias("s"))).otherwise(acc)

    best = F.aggregate("offers", start, swap)
    return grouped.select(*keys, (F.col("i") + 1).alias("line_no"), base.alias("base"), best["line"].alias("line"))


def readings_differ(r: Column) -> Column:
    """Whether the readings of a line, ``r``, differ in more than case, whitespace and bars."""
    return F.size(F.array_distinct(F.filter(F.transform(r, lambda x: normal_key(x["text"])), lambda k: k != ""))) > 1


def engine_counts(candidates: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Failed and successful engines, uncertain words and the mean confidence of a document."""
    words = F.sum(F.size("uncertain_words")) if "uncertain_words" in candidates.columns else F.sum(F.lit(0))
    return candidates.groupBy(*keys).agg(
        F.sum((F.col("status") == "failed").cast("int")).alias("failed"), F.coalesce(words, F.lit(0)).alias("uncertain"),
        F.sum((F.col("status") == "success").cast("int")).alias("successful"),
        F.coalesce(F.avg(F.when(F.col("status") == "success", F.col("confidence"))), F.lit(0.0)).alias("engine_confidence"))


def issue_counts(aligned: DataFrame, candidates: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Mismatching lines, failed engines and uncertain words per document."""
    keys = list(keys)
    lines = aligned.groupBy(*keys).agg(F.sum(readings_differ(F.col("r")).cast("int")).alias("mismatches"), F.count("*").alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return engine_counts(candidates, keys).join(lines, keys, "left").select(*keys, zero("mismatches"), zero("n_lines"), "failed", "uncertain", "successful", "engine_confidence")


def text_issues(c: Column) -> Column:
    """Number of receipt sanity issues and an empty-text issue."""
    bill = P.has(c, "ใบเสร็จ|ใบกำกับ|ราคา|ยอดรวม|รวมทั้งสิ้น|บาท|ภาษี", "i")
    return (
        (bill & ~P.has(c, r"\d+[,.]?\d*")).cast("int")
        + (bill & ~P.has(c, r"วันที่|date|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", "i")).cast("int")
        + (P.trim(c) == "").cast("int")
    )


def low_confidence_words(words: DataFrame, n: int = 12, keys=("doc_id", "engine_id")) -> DataFrame:
    """Worst ``n`` words per reading: below 70 or with stray marks.

    Words come as rows, or those of a reading as an array ``words`` of STRUCT<pos, word, confidence>; then only the worst of each array are
    shuffled and sorted.
    """
    if "words" in words.columns:
        worst = F.filter("words", lambda w: Q.engine_word_is_weak(w["word"], w["confidence"]))
        ranked = F.sort_array(F.transform(worst, lambda w: F.struct(w["confidence"].alias("confidence"), w["pos"].alias("pos"), w["word"].alias("word"))))
        words = words.select(*keys, F.inline(F.slice(ranked, 1, n)))
    weak = words.where(Q.engine_word_is_weak(F.col("word"), F.col("confidence")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("confidence", "pos"))
    return weak.withColumn("rank", rank).where(F.col("rank") <= n)


def low_confidence_line_words(lines: DataFrame, n: int | None = None, threshold: float = 70, keys=("doc_id",), order=("line_no",)) -> DataFrame:
    """Words on lines below ``threshold``, ranked in reading order; the first ``n`` if a number is given."""
    rows = lines.where(F.col("confidence") < threshold).select(*keys, *order, "confidence", F.posexplode(P.words_of(F.col("text"))).alias("pos", "word"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "pos"))
    ranked = rows.withColumn("rank", rank)
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def confidence_rollup(lines: DataFrame, keys=("doc_id",), page: str = "page_no") -> DataFrame:
    """Mean of page means, two decimals; blank pages are left out."""
    keys = list(keys)
    two = lambda c: F.floor(c * 100 + F.lit(0.5)) / 100
    pages = lines.groupBy(*keys, page).agg(two(F.avg("confidence")).alias("page_confidence"))
    return pages.groupBy(*keys).agg(two(F.avg("page_confidence")).alias("confidence"), F.count("*").alias("pages"))


def engine_rollup(words: DataFrame, keys=("doc_id", "engine_id")) -> DataFrame:
    """Confidence of each reading: the rounded mean over its words that have one."""
    return words.where(F.trim("word") != "").groupBy(*keys).agg(F.floor(F.avg("confidence") + F.lit(0.5)).cast("int").alias("confidence"), F.count("confidence").alias("words"))
