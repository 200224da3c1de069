"""Spelling variants by a dictionary of trie-node pairs.

Two tries hold all words, one read forward and one read backward. Their nodes are numbered, so (prefix node, suffix node) names what is
left of a word when the position between the two is skipped, or the word itself with a position between them to insert into. Words
that share a pair differ in that one position, exactly: no hash and no second look is needed.

* two words that skip a position under one pair differ by a replacement; each such couple has one position only
* a word under a pair to insert into, and one that skips a position there, differ by an insertion. Of a run of equal code points only
  the first is skipped for this, so each such couple also meets under one pair only, and neighbours are counted without a distinct

A pair has at most as many members as the alphabet has letters, whatever the table holds, so there is no large group and every member
needs only the best of the others. Nodes below which there is one word lead to no pair and are left out.

Scale: words are counted with a partial aggregation. A trie is numbered range by range: ranges of words in sorted order are cut at
splitters from a sample of about 64 words a range, and each range is numbered in its own task. A node that lies on a splitter can reach
into other ranges; it takes its number from the trie of the splitters, which each task builds for itself. So numbers agree without a
join or a pass over all words in one place. What reaches the driver is the sample, bounded by the number of ranges and 1,000 code
points a word. Words that share their first 1,000 code points fall in one range.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import drop_staged, stage

LETTERS = "A-Za-zÀ-ÿ"
_PART = 36
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least_length: int = 7, every: int | None = None) -> DataFrame:
    """``(word, n)``: occurrences of each run of ``letters`` in the whole texts, A-Z as a-z, of ``least_length`` code points or more.

    With ``every``, a run loses a code point where ``every`` divides the crc32 of ``<id>:<run>``: the one at crc32 % length. A null id
    counts as an empty one, a null text has no words; repeated rows count as often as they occur. Extra columns are ignored.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{letters}]{{{least_length},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    if every:
        hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
        cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
        low = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("run"))
    return low.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def number_nodes(words: list[str], start: int, fixed: dict[int, np.ndarray], prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trie nodes on the way of each of the sorted ``words``, from the root on, and where each word's begin.

    ``fixed`` gives the numbers that the nodes on the way of some of the words have. With ``prune`` a word's list ends before the first
    node that neither another word nor a fixed one reaches.
    """
    n = len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    active, above = np.arange(n), np.zeros(n, np.int64)
    levels = []
    depth = 0
    while len(active):
        new = np.ones(len(active), bool)
        new[1:] = above[1:] != above[:-1]
        if depth:
            ch = codes[first[active] + depth - 1]
            new[1:] |= ch[1:] != ch[:-1]
        group = np.cumsum(new) - 1
        number, shared = start + np.arange(group[-1] + 1), np.bincount(group) > 1
        start += len(number)
        for w, numbers in fixed.items():
            at = np.searchsorted(active, w)
            if at < len(active) and active[at] == w:
                number[group[at]], shared[group[at]] = numbers[depth], True
        keep = shared[group] if prune else np.ones(len(active), bool)
        active, above = active[keep], number[group[keep]]
        levels.append((active, above))
        deeper = lengths[active] > depth
        active, above = active[deeper], above[deeper]
        depth += 1
    if not levels:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    word = np.concatenate([a for a, _ in levels])
    order = np.argsort(word, kind="stable")
    return np.concatenate([b for _, b in levels])[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])


def _range_nodes(words: list[str], part: int, splitters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers of the sorted words of one range, the same in every range that a node reaches into."""
    numbers, begin = number_nodes(splitters, 0, {}, prune=False)
    lower, upper = splitters[part - 1:part] if part else [], splitters[part:part + 1]
    fixed = {}
    if lower:
        fixed[0] = -1 - numbers[begin[part - 1]:begin[part]]
    if upper:
        fixed[len(lower) + len(words)] = -1 - numbers[begin[part]:begin[part + 1]]
    nodes, first = number_nodes([*lower, *words, *upper], part << _PART, fixed)
    first = first[len(lower):len(lower) + len(words) + 1]
    return nodes[first[0]:first[-1]], first - first[0]


def _ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, i) with low <= i <= high."""
    size = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    flat = pa.concat_arrays(column.chunks)
    cut = flat.offsets.to_numpy()
    return flat.values.to_numpy()[cut[0]:cut[-1]], cut - cut[0]


def _splitters(words: DataFrame, column, ranges: int, total: int) -> list[str]:
    if ranges < 2:
        return []
    every = max(1, total // (ranges * 64))
    seen = words.where(F.expr(f"pmod(xxhash64(word), {every}) = 0")).select(F.substring(column, 1, 1000).alias("w")).distinct()
    sample = sorted(r["w"] for r in seen.collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)} - {""}) if sample else []


def _part(splitters: list[str]):
    @F.arrow_udf("int")
    def part(words: pa.Array) -> pa.Array:
        return pa.array([bisect_right(splitters, w) for w in words.to_pylist()], pa.int32())

    return part


def pairs(counts: DataFrame, range_words: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``(id, word, n)`` of all words, ids in code-point order, and the pairs ``(p, s, kind, id, n)``: kind 0 inserts, 1 skips, 2 skips the first of a run."""
    spark = counts.sparkSession
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("c")).first()
    ranges = max(math.ceil(size["n"] / range_words), math.ceil((size["c"] or 0) / (range_words * 40)), min(size["n"] // 2000 + 1, spark.sparkContext.defaultParallelism))
    ahead = _splitters(counts, "word", ranges, size["n"])
    behind = _splitters(counts, F.reverse("word"), ranges, size["n"])

    def forward(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        t = t.take(pa.array(sorted(range(t.num_rows), key=t.column("word").to_pylist().__getitem__)))
        nodes, first = _range_nodes(t.column("word").to_pylist(), part, ahead)
        ids = pa.array((part << _PART) + np.arange(t.num_rows))
        return pa.table({"id": ids, "word": t.column("word"), "n": t.column("n"), "prefix": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(nodes))})

    def backward(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        mirrored = [w[::-1] for w in t.column("word").to_pylist()]
        order = sorted(range(len(mirrored)), key=mirrored.__getitem__)
        mirrored, t = [mirrored[k] for k in order], t.take(pa.array(order))
        (suffix, s0), (prefix, p0) = _range_nodes(mirrored, part, behind), _lists(t.column("prefix"))
        codes = np.frombuffer("".join(mirrored).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(w) for w in mirrored], np.int64)
        first = np.cumsum(length) - length
        reach_p, reach_s = np.diff(p0) - 1, np.diff(s0) - 1
        out = []
        for gap in (1, 0):
            row, i = _ragged(np.maximum(0, length - gap - reach_s), np.minimum(reach_p, length - gap))
            kind = np.zeros(len(row), np.int32)
            if gap:
                # Position i of the word is position length - 1 - i of its mirror image.
                at = first[row] + length[row] - 1 - i
                kind = np.where((i == 0) | (codes[at] != codes[np.minimum(at + 1, len(codes) - 1)]), 2, 1).astype(np.int32)
            out.append((prefix[p0[row] + i], suffix[s0[row] + length[row] - gap - i], kind, row))
        p, s, kind, row = (np.concatenate(x) for x in zip(*out))
        row = pa.array(row)
        return pa.table({"p": pa.array(p), "s": pa.array(s), "kind": pa.array(kind), "id": t.column("id").take(row), "n": t.column("n").take(row)})

    words = stage(counts.select("word", "n", _part(ahead)("word").alias("part")).groupBy("part").applyInArrow(forward, "id long, word string, n long, prefix array<long>"), "spelling-words")
    reached = words.where(F.size("prefix") > 0).withColumn("part", _part(behind)(F.reverse("word")))
    found = reached.groupBy("part").applyInArrow(backward, "p long, s long, kind int, id long, n long")
    return words.select("id", "word", "n"), found


def neighbours(found: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of each word with neighbours; best: the least of (-n, id) over these."""
    groups = found.groupBy("p", "s").agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "id", "kind")).alias("all")).where(F.size("all") > 1)
    meet = "x -> struct(x.id as id, filter(all, y -> y.id <> x.id and (x.kind > 0 and y.kind > 0 or x.kind + y.kind = 2 and x.kind * y.kind = 0)) as near)"
    each = groups.select(F.explode(F.expr(f"transform(all, {meet})")).alias("x")).select("x.id", F.size("x.near").alias("c"), F.array_min("x.near").alias("least")).where("c > 0")
    return each.groupBy("id").agg(F.sum("c").alias("n_near"), F.min(F.struct("least.m", "least.id")).alias("best"))


def group_variants(counts: DataFrame, least_count: int = 2, factor: int = 10, range_words: int = 100_000) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word of ``counts(word, n)``; words must be distinct, null or empty words and those with n < ``least_count`` take no part.

    Near: exactly one code point inserted, deleted or replaced. ``form``: the near word of largest n (ties: smallest in code-point order)
    if that n is at least ``factor`` times the word's, else null. ``root``: the word reached by following forms; n grows by the factor
    at each step, so the steps are few and their number is known beforehand. An empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    kept = stage(counts.select("word", F.col("n").cast("long").alias("n")).where(f"word <> '' and n >= {least_count}"), "spelling-counts")
    most = kept.agg(F.max("n").alias("n")).first()["n"] or 1
    words, found = pairs(kept, range_words)
    near = neighbours(found)
    form = F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best"))
    judged = stage(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["id"].alias("form_id"), (-form["m"]).alias("form_n")), "spelling-judged")
    drop_staged(kept)
    steps = int(math.log(max(most / max(least_count, 1), 1)) / math.log(factor)) + 1
    roots = judged.where("form_id is not null").select(F.col("id").alias("at"), F.col("form_id").alias("root_id"))
    for _ in range(steps.bit_length()):
        ahead = roots.select(F.col("at").alias("mid"), F.col("root_id").alias("far"))
        roots = stage(roots.join(ahead, F.col("root_id") == F.col("mid"), "left").select("at", F.coalesce("far", "root_id").alias("root_id")), "spelling-roots")
    names = words.select(F.col("id").alias("name_id"), F.col("word").alias("name"))
    linked = judged.where("form_id is not null").join(roots, F.col("id") == F.col("at"))
    linked = linked.join(names, F.col("form_id") == F.col("name_id")).withColumnRenamed("name", "form").drop("name_id")
    linked = linked.join(names, F.col("root_id") == F.col("name_id")).withColumnRenamed("name", "root")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    alone = judged.where("form_id is null").withColumns({"form": F.lit(None).cast("string"), "root": F.col("word")})
    return linked.select(*columns).unionByName(alone.select(*columns))
