"""Mixing sources to target weights along a low-discrepancy schedule, with built-in functions only.

The documents of a source, shuffled by a digest of their ids, lie on a line of tokens, once more behind itself for a second pass. The
line is cut into blocks of equal tokens. A schedule of slots maps golden-ratio points through the cumulative shares of the sources; the
r-th slot of a source takes its r-th block, so every stretch of the schedule holds the sources in nearly their shares. Slots beyond a
source's target fall away, and those the points leave over are put at the end.

Scale: running sums and ranks go in two levels (sums by digest prefix or stretch of slots, then within), so a source with a third of all
documents is spread over 4,096 groups. Points find their source by an equality join on a grid. Only the table of sources (a row for
each) is ever ordered as a whole. Texts are read once, for their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shared import WORD, stage

STRETCH, GRID, PERIOD, STEP = 4096, 4096, 2**31, 1327217885  # STEP / PERIOD is the golden ratio's fraction


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys=()) -> DataFrame:
    """``(doc_id, source, size, digest)`` and ``keys``: words of the whole text (null: 0), and what orders documents."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), digest.alias("digest"), *keys)


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target, take)`` for each source: the target, and the whole words to take.

    Sources in the order of their code points, null last, get the weights in turn. A target stops at ``most`` times its source's size and the
    excess is shared anew by weight: the level at which all targets fill up, found from the order in which sources become full.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)).withColumn("cap", cap)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    full_before, left = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(full_before), F.lit(0.0))) / F.sum("weight").over(left))
    ranked = ranked.withColumn("k", F.row_number().over(by))
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("k", "level"))).over(everything)
    ranked = ranked.withColumn("target", F.least("cap", F.coalesce(first["level"] * F.col("weight"), F.col("cap"))))
    return ranked.select("source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("take"))


def schedule(goals: DataFrame, block: int = 256) -> DataFrame:
    """``(slot, source, rank)``: the slots in order, and which block of its source each takes (from 0)."""
    slots = goals.withColumn("slots", F.ceil(F.col("take") / block).cast("long")).where("slots > 0")
    before = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    shares = slots.withColumn("lo", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("n", F.sum("slots").over(Window.partitionBy(F.lit(1))))
    shares = shares.select("source", "slots", (F.col("lo") / F.col("n")).alias("lo"), ((F.col("lo") + F.col("slots")) / F.col("n")).alias("hi"))
    grid = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))))
    total = slots.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).where("n > 0")
    stretches = total.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {STRETCH}"))).alias("g")).repartition("g")
    drawn = stretches.select("g", F.explode(F.sequence(F.col("g") * STRETCH, F.least((F.col("g") + 1) * STRETCH, F.col("n")) - 1)).alias("slot"))
    drawn = drawn.withColumn("point", ((F.col("slot") % PERIOD) * STEP % PERIOD) / float(PERIOD)).withColumn("cell", F.floor(F.col("point") * GRID))
    # Rows drawn from a one-row table look small to the optimizer; the hints keep it from broadcasting them.
    owned = drawn.hint("merge").join(grid, "cell").where("point >= lo and point < hi").select("g", "slot", "source", "slots")
    counts = owned.groupBy("source", "g").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("source").orderBy("g")) - F.col("n")
    counts = counts.withColumn("offset", offset)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    places = counts.select(F.col("source").alias("s"), F.col("g").alias("sg"), "offset")
    ranked = owned.hint("merge").join(places, same("source", "s") & (F.col("g") == F.col("sg"))).withColumn(
        "rank", F.col("offset") + F.row_number().over(Window.partitionBy("source", "g").orderBy("slot")) - 1).where("rank < slots").select("slot", "source", "rank")
    drawn_of = counts.groupBy("source").agg(F.sum("n").alias("drawn")).withColumnRenamed("source", "s")
    short = shares.join(drawn_of, same("source", "s"), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < slots")
    late = short.select("source", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(late.select(F.lit(None).cast("long").alias("slot"), "source", "rank"))


def lines(sized: DataFrame, keys=()) -> DataFrame:
    """``sized`` with ``start``, the words of the source before the document; ``keys`` order documents that are equal but for them."""
    rows = sized.withColumn("part", F.substring("digest", 1, 3))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("offset"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    within = F.sum("size").over(Window.partitionBy("source", "part").orderBy("digest", F.col("doc_id"), "size", *keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("start", F.col("offset") + within).drop("s", "p", "part", "offset")


def mixture(placed: DataFrame, goals: DataFrame, slots: DataFrame, block: int = 256) -> DataFrame:
    """``(slot, doc_id, source, size, start, first_word, words)``: the pieces of documents in the slots that take them, from ``first_word`` on."""
    goals = goals.select(F.col("source").alias("s"), "source_size", "take")
    rows = placed.where("size > 0").join(goals, F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("a", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("take"))).where("a < b")
    rows = rows.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))
    taken = slots.select("slot", F.col("source").alias("t"), F.col("rank").alias("r"))
    rows = rows.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("t")) & (F.col("rank") == F.col("r")))
    lo, hi = F.greatest(F.col("a"), F.col("rank") * block), F.least(F.col("b"), (F.col("rank") + 1) * block)
    return rows.select("slot", "doc_id", "source", "size", "start", (lo - F.col("a")).alias("first_word"), (hi - lo).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, most: float = 2.0,
        block: int = 256, keys=()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` and the columns ``keys`` for every row: the words the mix takes of it, repeats counted.

    A null text has size 0 and nothing is taken of it; a null source is a source of its own and comes last; rows with a null id take part.
    Repeated rows are documents of their own. At most two passes over a source are made (``most`` up to 2). Other columns are not carried.
    """
    sized = stage(sizes(docs, id_col, text_col, source_col, keys), "sizes")
    goals = stage(targets(sized, weights, share, most), "targets")
    placed = lines(sized, keys)
    taken = mixture(placed, goals, schedule(goals, block), block).groupBy("source", "start", "size").agg(F.sum("words").alias("taken"))
    # A start is one document's, as only those without words share it.
    taken = taken.select(F.col("source").alias("s"), F.col("start").alias("at"), F.col("size").alias("of"), "taken")
    goals = goals.select(F.col("source").alias("g"), "source_size", "target")
    rows = placed.join(goals, F.col("source").eqNullSafe(F.col("g")))
    rows = rows.join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") == F.col("of")), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *keys)
