"""Line-table operators: cuts, views, noise filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import predicates as R, text as P
from ..functions.scores import meaning_score
from ..sources.exports import ordered_text


def garbage_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("kept", ~P.is_garbage_line(F.col("line")))


def ui_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("kept", ~R.is_ui_garbage(F.col("line")))


def broken_lines(lines: DataFrame) -> DataFrame:
    """``kept`` and the noise score; removed lines stay auditable in the table."""
    line = P.squeeze(F.col("line"))
    return lines.withColumn("score", R.broken_line_score(line)).withColumn("kept", ~R.is_broken_line(line))


def strict_line_table(docs: DataFrame, text_col: str = "raw_text", keys=("doc_id",)) -> DataFrame:
    """Cleaned lines with their score and noise flag, one row per source line."""
    flagged = docs.select(*keys, R.is_memo_text(F.col(text_col)).alias("memo"), F.col(text_col).alias("_text"))
    rows = flagged.select(*keys, "memo", F.posexplode(P.squeezed_lines_of(F.col("_text"))).alias("line_no", "line"))
    memo_steps = [lambda c, f=f: F.when(F.col("memo"), f(c)).otherwise(c) for f in P.STRICT_MEMO_STEPS]
    rows = P.stage(rows.withColumn("clean", R.open_strict_line(F.col("line"))), "clean",
                   *memo_steps, R.scrub_garbled, *memo_steps, P.squeeze)
    stats = R.line_stats(F.col("clean"))
    names = list(stats)
    for n in names:
        rows = rows.withColumn("s_" + n, stats[n])
    s = {n: F.col("s_" + n) for n in names}
    rows = rows.withColumn("score", R.strict_line_score(s))
    rows = rows.withColumn("noise", R.looks_like_noise(s, F.col("score"), F.col("memo")) | (F.col("clean") == ""))
    return rows.select(*keys, "memo", "line_no", "line", "clean", "score", "noise", (F.col("clean") != F.col("line")).alias("changed"))


def strict_review(docs: DataFrame, text_col: str = "raw_text", keys=("doc_id",), fallback: int = 5) -> DataFrame:
    """``(keys, kept, removed)``: the kept lines of a document in order (the best ones by score), and how many were removed or changed.

    Lines that repeat but for case and whitespace are kept once; where all are noise, the best ``fallback`` stay. ``removed`` counts
    different texts: lines before their change, and cleaned ones that are noise; where no line is kept on its merit, all of them. One shuffle
    by document serves the ranks and the result; a document's lines are its own text, cut.
    """
    keys = list(keys)
    rows = strict_line_table(docs, text_col, keys).withColumn("_k", F.lower(P.compact(F.col("clean"))))
    whole = Window.partitionBy(*keys)
    good = ~F.col("noise")
    rows = rows.withColumn("_good", F.max(good.cast("int")).over(whole))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, good, "_k").orderBy("line_no")))
    rows = rows.withColumn("_rank", F.row_number().over(whole.orderBy((F.col("clean") == "").cast("int"), F.col("score").desc(), "line_no")))
    keep = F.when(F.col("_good") == 1, good & (F.col("_first") == 1)).otherwise((F.col("clean") != "") & (F.col("_rank") <= fallback))
    filled = F.col("clean") != ""
    per = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(keep, F.struct(F.when(F.col("_good") == 1, F.col("line_no")).otherwise(F.col("_rank")).alias("o"), "line_no", "clean")))).alias("kept"), F.max("_good").alias("_good"),
        F.collect_list(F.when(F.col("changed"), F.col("line"))).alias("_changed"), F.collect_list(F.when(F.col("noise") & filled, F.col("clean"))).alias("_noise"), F.count("*").alias("_n"))
    best = F.transform("kept", lambda x: x["clean"])
    removed = F.when(F.col("_good") == 1, F.size(F.array_distinct(F.concat("_changed", "_noise")))).when(
        F.size("_noise") == 0, F.col("_n")).otherwise(F.size(F.filter("_noise", lambda x: ~F.array_contains(best, x))) + F.size("_changed") + F.size("_noise"))
    return per.select(*keys, F.transform("kept", lambda x: F.struct(x["line_no"].alias("line_no"), x["clean"].alias("clean"))).alias("kept"), removed.cast("int").alias("removed"))


def strict_noise_filter(docs: DataFrame, text_col: str = "raw_text", keys=("doc_id",), fallback: int = 5) -> DataFrame:
    """Kept lines per document, deduplicated; the best five where all were noise."""
    return strict_review(docs, text_col, keys, fallback).select(*keys, F.inline("kept"))



def pre_header_lines(docs: DataFrame, text_col: str = "raw_text", keys=("doc_id",)) -> DataFrame:
    """Lines before a government header: ``review``, ``noise``, or kept ``body``."""
    lines = P.squeezed_lines_of(F.col(text_col))
    header = lambda x: P.has(x, "บันทึกข้อความ|หนังสือราชการ|ส่วนราชการ")
    docs = docs.select(*keys, lines.alias("_l"))
    at = F.array_position(F.transform("_l", header), F.lit(True))
    rows = docs.select(*keys, at.alias("_at"), F.posexplode("_l").alias("pos", "line"))
    code = P.has(F.col("line"), r"\d+[/\-.]\d+|[ก-ฮA-Z]{1,6}\.?\s*\d+|วันที่|โทร|พ.ศ.|๒๕[0-9๐-๙]{2}")
    before = F.col("pos") + 1 < F.col("_at")
    fate = F.when(before & code, "review-code").when(before & (meaning_score(F.col("line")) < 25), "noise").when(
        before, "review-unclear").otherwise("body")
    return rows.select(*keys, (F.col("pos") + 1).alias("line_no"), "line", fate.alias("fate"))


def dedupe_keep_first(lines: DataFrame, keys=("doc_id",), pos: str = "line_no", text: str = "line",
                      min_score: Column | None = None) -> DataFrame:
    """Unique lines per document by whitespace-free lower-case key; first wins."""
    rows = lines if min_score is None else lines.where(min_score)
    key = F.lower(P.compact(F.col(text)))
    out = rows.groupBy(*keys, key.alias("_k")).agg(F.min(F.struct(pos, text)).alias("r"))
    return out.select(*keys, F.col("r." + pos).alias(pos), F.col("r." + text).alias(text))


def head_tail_lines(c: Column, n: int = 5) -> tuple[Column, Column]:
    lines = P.lines_of(c)
    return F.slice(lines, 1, n), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (n - 1)), F.lit(n))


def to_key_value(lines: DataFrame) -> DataFrame:
    kv = P.key_value(F.col("line"))
    return lines.withColumn("_kv", kv).select(*lines.columns, "_kv.key", "_kv.value")


def email_view(c: Column) -> Column:
    """Headers in preferred order, a blank line, then the body."""
    lines = F.transform(P.lines_of(c), P.normalize_label)
    is_head = lambda x: P.has(x, rf"^({P.LABELS})\s*:", "i")

    def rank(x):
        out = F.lit(99)
        for i, label in reversed(list(enumerate(P.HEADER_ORDER))):
            out = F.when(F.lower(x).startswith(label.lower()), i).otherwise(out)
        return out

    heads = F.filter(lines, is_head)
    tagged = F.sort_array(F.transform(heads, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x"))))
    body = F.transform(F.filter(lines, lambda x: ~is_head(x)), lambda x: P.sub(x, r"^[-•]\s*", "- "))
    return P.trim(F.array_join(F.concat(F.transform(tagged, lambda t: t["x"]), F.array(F.lit("")), body), "\n"))


def ticket_view(c: Column) -> Column:
    lines = F.transform(P.lines_of(c), P.normalize_label)
    is_field = lambda x: P.has(x, rf"^({P.TICKET_LABELS})\s*:", "i")
    info = F.transform(F.filter(lines, is_field), lambda x: F.concat(F.lit("- "), x))
    rest = F.transform(F.filter(lines, lambda x: ~is_field(x)), lambda x: F.concat(F.lit("- "), P.sub(x, r"^[-•]\s*", "")))
    some = lambda a, head: F.when(F.size(a) > 0, F.concat(F.array(*[F.lit(h) for h in head]), a)).otherwise(
        F.array().cast("array<string>"))
    return P.trim(F.array_join(F.concat(some(info, ["Ticket Info"]), some(rest, ["", "Details"])), "\n"))


def compact_blocks(c: Column, min_len: int = 42) -> Column:
    """Merge long lines into blocks; a short line opens a block, header lines stand alone."""
    lines = P.lines_of(c)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    head = lambda x: P.has(x, rf"^({P.BLOCK_LABELS})\s*:", "i")
    flushed = lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(P.trim(acc["cur"])))).otherwise(acc["done"])

    def step(acc, x):
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(" "), x)).otherwise(x)
        is_head, short = head(x), F.length(x) < min_len
        done = F.when(is_head, F.concat(flushed(acc), F.array(P.normalize_label(x)))).when(short, flushed(acc)).otherwise(acc["done"])
        cur = F.when(is_head, "").when(short, x).otherwise(joined)
        return F.struct(done.alias("done"), cur.alias("cur"))

    return F.array_join(F.aggregate(lines, zero, step, flushed), "\n")


def capture_list_layout(c: Column) -> Column:
    """Normalised bullets with a blank line around headings that touch bullets."""
    every = F.filter(F.transform(F.split(P.prepare_capture(c), "\n"), P.normalize_capture_line), lambda x: x != "")

    bullet = lambda x: F.coalesce(P.has(x, r"^•\s+"), F.lit(False))

    def render(cur, prev, nxt):
        heading = P.has(cur, "^[^•]{1,80}:$")
        return F.concat(F.when(heading & bullet(prev), "\n").otherwise(""), cur, F.when(heading & bullet(nxt), "\n").otherwise(""))

    def laid_out(lines):
        beside = lambda k: F.when(k >= 0, F.get(lines, k))
        return F.array_join(F.transform(lines, lambda x, i: render(x, beside(i - 1), beside(i + 1))), "\n")

    return P.trim(P.sub(P.let(every, laid_out), r"\n{3,}", "\n\n"))


def min_line_confidence(lines: DataFrame, flat: DataFrame, cut: int = 45, keys=("doc_id",)) -> DataFrame:
    """Engine text from lines at or above ``cut``; the flat text where fewer than two remain."""
    keys = list(keys)
    strong = lines.where((P.trim(F.col("text")) != "") & (F.col("confidence").isNull() | (F.col("confidence") >= cut)))
    joined = ordered_text(strong.withColumn("text", P.trim(F.col("text"))), keys, "line_no", "text", "line_text")
    kept = strong.groupBy(*keys).agg(F.count("*").alias("n_kept"))
    n = F.coalesce("n_kept", F.lit(0))
    return flat.join(kept.join(joined, keys), keys, "left").select(
        *keys, n.alias("n_kept"), F.when(n >= 2, F.col("line_text")).otherwise(P.trim(F.col("text"))).alias("text"))


def search_text(docs: DataFrame, query: str, text_col: str = "raw_text", keys=("doc_id",)) -> DataFrame:
    """Case-insensitive literal hits and the marked text."""
    from ..patterns import quote

    text = F.col(text_col)
    pattern = quote(query.strip())
    return docs.where(F.lower(text).contains(query.strip().lower())).select(
        *keys, P.count(text, pattern, "i").alias("hits"), P.sub(text, f"({pattern})", "<mark>$1</mark>", "i").alias("marked"))
