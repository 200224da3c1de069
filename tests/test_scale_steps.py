"""Steps rewritten to run once a row give what the plain definition gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import classify as K, distance as DI, extract as E, scores as Q, text as P
from glyphmill.operators import readings as V, rollups as A
from glyphmill.patterns import BOUNDARY, java, lean

TEXTS = [
    "", "plain words only", "IP 10.0.0.1 and v1.2.3, INC-2026-001, a@b.org x_1,234.50 บาท 12345,678 THB", "GATEWAY dns Intel ภาษี ticket วันที่ 1/2/2024",
    "(/api/v1 /a/b C:\\x\\y 00:1A:2B:3C:4D:55 AB-12345 50% 1,234", "เ ก ่า ่่ ฿12,500.00 ก่ ข้อความ ภาษาไทย \ufffd|{}<>", "ping 10.0.0.1 ipconfig/renew\nใบเสร็จ total: 1 000.00",
]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lean_patterns_match_the_same(spark):
    patterns = [*E.ENTITIES, *E.PROTECTED, *[(n, p, f) for n, p, f in K.OTHER_TYPES + K.GOVERNMENT_TYPES], ("n", Q.NETWORK_TERMS, "i"), ("d", Q.DOC_TERMS, "i"), ("u", Q.UI_TERMS, "i"),
                ("c", Q.CAPTURE_TERMS, "i"), ("x", Q.SUSPICIOUS_IP, ""), ("s", r"\b[a-zA-Z]{1,2}\b", ""), ("k", E.COMMAND, "i")]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    same = [F.expr("true")] + [F.regexp_extract_all("t", F.lit(java(p, f)), F.lit(0)).eqNullSafe(F.regexp_extract_all("t", F.lit(lean(java(p, f))), F.lit(0))) for _, p, f in patterns]
    assert all(all(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(same)]).collect())
    plain = "|".join("(?i:" + java(p) + ")" if "i" in f else "(?:" + java(p) + ")" for _, p, f in E.PROTECTED)
    found = df.select(F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("a"), E.protected_spans(F.col("t")).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and sum(len(r.a) for r in found) > 10
    assert BOUNDARY not in lean(java(r"\b\d+\b"))


def test_counts_of_classes(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    for pattern in (Q.WEIRD, Q.MARK_SIGNS, "[A-Za-z0-9]", f"[ก-ฮ{P.TONES}]", Q.STRANGE_MARKS):
        rows = df.select("t", P.count(F.col("t"), pattern).alias("n")).collect()
        assert [r.n for r in rows] == [None if r.t is None else len(re.findall(pattern, r.t)) for r in rows]


def test_symbols_and_known_words(spark):
    rows = spark.createDataFrame([(t, t.replace("/", "").replace(".", "", 1)) for t in TEXTS], "a string, b string").select("a", "b", Q.symbol_preservation(F.col("a"), F.col("b")).alias("s"), Q.symbol_score(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        total, kept = sum(r.a.count(s) for s in Q.SYMBOLS), sum(min(r.a.count(s), r.b.count(s)) for s in Q.SYMBOLS)
        assert r.s.raw_total == total and r.s.kept == kept and r.n == r.s.score == (int(kept / total * 100 + 0.5) if total else 100)


def test_line_distances():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abก ") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abก ") for _ in range(rng.randint(0, 12)))
        d, size = lev(a, b), max(len(a), len(b))
        assert DI.text_distance(a, b) == d
        assert DI.alike(a, b, 0.5) == (a == b or bool(a and b) and 1 - d / size > 0.5)
    long = "lorem ipsum " * 400
    assert DI.text_distance(long, long.replace("i", "3x")) == 2 * 400


def test_lines_side_by_side_keep_their_places(spark):
    c = spark.createDataFrame([(1, "b", 70, "x\ny"), (1, "a", 80, "u"), (2, "a", None, ""), (2, "b", 1, None)], "doc_id long, engine_id string, confidence int, text string")
    got = [(r.doc_id, r.line_no, [(x.engine, x.text, x.confidence) for x in r.r]) for r in V.align_candidates(c).orderBy("doc_id", "line_no").collect()]
    assert got == [(1, 1, [("a", "u", 80), ("b", "x", 70)]), (1, 2, [("a", "", 80), ("b", "y", 70)])]


@pytest.mark.parametrize("dictionary", [None, ["clean lines", "other"]])
def test_cluster_vote_by_plain_likeness(spark, dictionary):
    texts = ["clean line", "c1ean line", "clean  line", "something else", ""]
    c = spark.createDataFrame([(1, f"e{i}", 60 + i, t) for i, t in enumerate(texts)], "doc_id long, engine_id string, confidence int, text string")
    words = dictionary and spark.createDataFrame([(w,) for w in dictionary], "word string")
    row = V.cluster_vote(V.align_candidates(c, squeeze=True), words).first()
    assert row.conflict and row.votes == 3 and row.selected == ("clean lines" if dictionary else "clean line")
    assert row.candidates == ["clean line", "c1ean line", "clean line", "something else"]


def test_spell_report_counts_and_findings(spark):
    docs = spark.createDataFrame([(1, "ข้อความ ขอ อกษร ข้อความ"), (2, "none"), (3, None)], "doc_id long, raw_text string")
    rows = {(r.doc_id, r.kind, r.found, r.suggest, r.n) for r in A.spell_report(docs, words=["ข้อความ", "absent"]).collect()}
    assert (1, "correct", "ข้อความ", "", 2) in rows and (1, "suspicious", "อกษร", "อักษร", 1) in rows and {r[0] for r in rows} == {1}


def test_sections_and_protected_text(spark):
    df = spark.createDataFrame([(1, "Report\n1. Check\nping\nStep 2 renew\nrun"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.s for r in df.select("id", E.sections(F.col("t")).alias("s")).collect()}
    assert [(s.number, s.heading, s.body) for s in got[1]] == [("1", E.DEFAULT_HEADING, ["Report"]), ("1", "Check", ["ping"]), ("2", "Step 2 renew", ["run"])]
    assert got[2] == [] and got[3] == []
    done = spark.createDataFrame([("see http://a.b/c and 10.0.0.1 now",)], "t string").select(E.clean_protected(F.col("t"), F.upper).alias("t")).first().t
    assert done == "SEE http://a.b/c AND 10.0.0.1 NOW"


def test_fields_that_are_no_number(spark, tmp_path):
    """An e-mail that reads like a ticket or a receipt has no number in its system or total."""
    from glyphmill.plans import catalog_data as CD

    mails = spark.createDataFrame([("emails", 1, "Ticket router please"), ("receipts", 2, "receipt\n1 000")], "kind string, doc_id long, raw_text string")
    try:
        kept, CD._mix = CD._mix, lambda s, d: mails
        rows = {r.kind: r.amount for r in CD.extract_fields(spark, "").collect()}
    finally:
        CD._mix = kept
    assert rows == {"emails": 0.0, "receipts": 0.0}


def test_worst_words_of_arrays_are_those_of_rows(spark):
    rows = [(1, "e", p, w, c) for p, (w, c) in enumerate([("a", 50), ("b|", 90), ("c", 50), ("d", 95), ("", 10), ("e", None)], 1)] + [(2, "e", 1, "x", 60), (1, "f", 1, "y", 99)]
    flat = spark.createDataFrame(rows, "doc_id long, engine_id string, pos int, word string, confidence int")
    nested = flat.groupBy("doc_id", "engine_id").agg(F.collect_list(F.struct("pos", "word", "confidence")).alias("words"))
    got = [sorted((r.doc_id, r.engine_id, r.pos, r.word, r.confidence, r["rank"]) for r in V.low_confidence_words(df, 2).collect()) for df in (flat, nested, nested.unionByName(nested))]
    assert got[0] == got[1] == [(1, "e", 1, "a", 50, 1), (1, "e", 3, "c", 50, 2), (2, "e", 1, "x", 60, 1)] and len(got[2]) == 4
