"""Corpus roll-ups: fixes, vocabulary, samples, benchmark runs, spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import scores as Q, text as P
from ..functions.scores import occurrences
from .lexicon import count_words


def fix_groups(cleaned: DataFrame, n: int | None = None, fixes: str = "fixes") -> DataFrame:
    """Fixes by type, before and after, with their number; the ``n`` most frequent if a number is given."""
    # Not the plain column: its explode would bring a filter that makes all fixes a second time, below the exchange that spreads the texts.
    rows = cleaned.select(F.inline(F.transform(fixes, lambda f: F.struct(*[f[n].alias(n) for n in ("type", "from", "to")]))))
    groups = rows.groupBy("type", "from", "to").agg(F.count("*").alias("n"))
    return groups if n is None else groups.orderBy(F.col("n").desc(), "type", "from", "to").limit(n)


def fix_summary(cleaned: DataFrame, n: int | None = None) -> DataFrame:
    """Totals by type over all fixes, or over the ``n`` most frequent."""
    return fix_groups(cleaned, n).groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


def vocabulary_counts(docs: DataFrame, words=None, text_col: str = "raw_text") -> DataFrame:
    """Occurrences of each known word over the corpus, of those in ``words`` (a list or a table with a column ``word``) or else all fixed ones."""
    if not isinstance(words, DataFrame):
        words = docs.sparkSession.createDataFrame([(w,) for w in words or fixed.correct_words()], "word string")
    return count_words(docs, words, text_col)


# Spelling and spacing checks with their suggestion.
WRONG_CHECKS = [
    ("คา(?=ไทย|แก้|ที่)", "คำ", ""), (r"ซ่องว่าง|ช่อ\s*งว่าง|ชอง่\s*ว่าง|ชอ\s*ง่\s*ว่าง", "ช่องว่าง", ""),
    ("อกษร|อักษ[นร]", "อักษร", ""), ("แปตาก|แปสก", "แปลก", ""), ("ศาทหแก้|ศาทหแก|คำทหแก้|คาหแก้?", "คำที่แก้", ""),
    ("พืนที|พืนที่", "พื้นที่", ""), (r"เมาสับน|เมาส์บ\s*น", "เมาส์บน", ""), ("ตั้งคา", "ตั้งค่า", ""), ("แปปลง", "แปลง", ""),
    ("[�ƟθϴƩΣÉÊÈË]", "ตรวจอักษรแปลก", ""),
]
SPACING_CHECKS = [
    (r"[เแโใไ]\s+[ก-ฮ]", "สระนำหน้าไม่ควรเว้น", ""), (rf"[ก-ฮ]\s+[{P.TONES}]", "สระ/วรรณยุกต์ติดกับพยัญชนะ", ""),
    (r"[ก-ฮ]\s{2,}[ก-ฮ]", "ลดช่องว่างซ้ำ", ""), (r"\b(?:SD|S D)\s*[- ]?\s*WAN\b", "SD-WAN", "i"),
    (r"\bI\s*T\s*[/|\\]?\s*N\s*[O0]\s*C\b", "IT/NOC", "i"),
]


def spell_findings(c: Column, per_check: int | None = None) -> Column:
    """ARRAY<STRUCT<kind, found, suggest>>: distinct hits of each check, the first ``per_check`` if a number is given."""
    def tagged(found, kind, suggest):
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("found"), F.lit(suggest).alias("suggest")))

    def hits(kind, checks):
        some = (lambda a: a) if per_check is None else (lambda a: F.slice(a, 1, per_check))
        return [tagged(F.array_distinct(some(P.find_all(c, p, f))), kind, s) for p, s, f in checks]

    return F.array_distinct(F.concat(*hits("suspicious", WRONG_CHECKS), *hits("spacing", SPACING_CHECKS)))


def spell_report(docs: DataFrame, text_col: str = "raw_text", keys=("doc_id",), words=None) -> DataFrame:
    """Known-good words with counts, and findings with suggestions, in long form."""
    text = F.col(text_col)
    low = F.lower(text)
    good = F.filter(F.array(*[
        F.struct(F.lit("correct").alias("kind"), F.lit(w).alias("found"), F.lit("").alias("suggest"),
                 occurrences(F.col("_low"), w.lower()).alias("n")) for w in (words or fixed.correct_words())
    ]), lambda x: x["n"] > 0)
    found = F.transform(spell_findings(text), lambda x: F.struct(
        x["kind"].alias("kind"), x["found"].alias("found"), x["suggest"].alias("suggest"), F.lit(1).alias("n")))
    return docs.withColumn("_low", low).select(*keys, F.inline(F.concat(good, found)))


def suspicious_rows(docs: DataFrame, check_set: str = "review", text_col: str = "raw_text", keys=("doc_id",)) -> DataFrame:
    return docs.select(*keys, F.inline(Q.suspicious_tokens(F.col(text_col), check_set)))


def sample_summary(samples: DataFrame, keys=("engine",)) -> DataFrame:
    """Sample count, last layout and rounded mean quality; missing scores are ignored."""
    quality = F.nullif(F.col("quality_score"), F.lit(0.0))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.max_by("layout_type", F.struct("created_at", "id")).alias("last_layout"),
        F.floor(F.avg(quality) + F.lit(0.5)).alias("avg_quality"))


def benchmark_summary(runs: DataFrame, keys=("engine",)) -> DataFrame:
    one = lambda c: (F.floor(F.avg(c) * 10 + F.lit(0.5)) / 10).alias(c)
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), one("quality_score"), one("cer"), one("wer"))


def review_queue(conflicts: DataFrame, issues: DataFrame, n: int | None = None, keys=("doc_id",), reviews: DataFrame | None = None) -> DataFrame:
    """Open conflicts, must-check items and those of the ``reviews`` of government documents, distinct; the first ``n`` conflicts per document if a number is given."""
    from pyspark.sql import Window

    is_open = F.col("conflict") & ~F.col("resolved")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(is_open, 0).otherwise(1), "line_no"))
    some = conflicts if n is None else conflicts.withColumn("_rn", rank).where(F.col("_rn") <= n)
    entry = F.struct(F.lit("conflict").alias("kind"), F.col("selected").alias("item"), F.array_join("candidates", " | ").alias("reason"))
    # Not a filter: one on the vote's result would move below the vote and repeat it there. Nor an explode of a plain column, which brings such a filter.
    open_ = some.select(*keys, F.inline(F.filter(F.array(entry), lambda _: is_open)))
    out = open_.unionByName(issues.select(*keys, "kind", "item", "reason"))
    if reviews is not None:
        items = F.transform("review", lambda r: F.struct(r["type"].alias("kind"), r["text"].alias("item"), r["reason"].alias("reason")))
        out = out.unionByName(reviews.select(*keys, F.inline(items)))
    return out.distinct()


def record_answers(corrections: DataFrame, answers: DataFrame) -> DataFrame:
    """Append new human answers as user corrections; a known pair is not added again."""
    new = answers.where((F.trim("wrong") != "") & (F.trim("correct") != "") & (F.trim("wrong") != F.trim("correct")))
    new = new.select(F.trim("wrong").alias("wrong"), F.trim("correct").alias("correct"), F.lit("user").alias("source"),
                     "created_at", F.lit(0).alias("used")).dropDuplicates(["wrong", "correct"])
    fresh = new.join(corrections.select("wrong", "correct").distinct(), ["wrong", "correct"], "left_anti")
    return corrections.select("wrong", "correct", "source", "created_at", "used").unionByName(
        fresh.select("wrong", "correct", "source", "created_at", "used"))


