import random

import pytest
from pyspark.sql import functions as F

from glyphmill import fixed
from glyphmill.functions import classify as K, extract as E, predicates as R, scores as Q, text as P
from glyphmill.operators import clean as C, fields as FD, lines as L, matching as M, rules as U
from glyphmill.patterns import java

SAMPLE = "URL: https://a.example.com/help.html\nEmail: x@example.org\nIP: 10.240.36.254\nTicket: INC-2026-001\nAmount: ฿12,500.00\nAPI: /api/ocr/image"


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_boundary_is_ascii():
    assert java(r"\bab").count("A-Za-z0-9_") == 4
    assert java("a$").endswith(r"\z")


def test_columns(spark):
    c = F.col("t")
    r = one(spark, "a\tb  c\n\n\n\nd$1$2 ", P.ws_normalize(c).alias("w"), P.list_view(c, "checklist").alias("k"))
    assert r.w == "a b c\n\nd" and r.k.startswith("- [ ] a")
    r = one(spark, "x ๑๒", P.fold_thai_digits(c).alias("d"), P.sub_first(c, "(x|y)", "<$1>").alias("f"))
    assert r.d == "x 12" and r.f == "<x> ๑๒"
    assert one(spark, "ab ab", P.sub_first(F.col("t"), "(a)b", "[$1]").alias("f")).f == "[a] ab"
    r = one(spark, "a​b ● c\n|||---\nend", P.strip_strange(c).alias("s")).s
    assert r.text == "ab c\n\nend" or r.text == "ab c\nend"
    assert r.removed["zero_width"] == 1 and r.removed["bullet"] == 1 and r.removed["junk_line"] == 1


def test_guard(spark):
    rows = spark.createDataFrame([("ab", "abcdef", True), ("12", "ab", True), ("SD WAN", "SD-WAN", False), ("", "abcdef", False), ("abcd", "x" * 13, True)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", F.expr(U._guard("a", "b"))).collect())


def test_rule_runner(spark):
    df = spark.createDataFrame([("SD WAN noc 1Pv4",)], "t string")
    row = U.apply_rules(df, fixed.rules("dictionary"), "t", "o").first()
    assert row.o == "SD-WAN NOC IPv4" and len(row.fixes) == 3


@pytest.mark.parametrize("level", ["raw", "safe", "normal"])
def test_entities_survive(spark, level):
    row = C.clean_text(spark.createDataFrame([(SAMPLE,)], "raw_text string"), level=level).first()
    for token in ("https://a.example.com/help.html", "x@example.org", "10.240.36.254", "INC-2026-001", "12,500.00", "/api/ocr/image"):
        assert token in row.cleaned_text


def test_demo_invoice(spark):
    raw = "ใบกาํ กับภาษี\nบริษท ตัวอย่าง จากัด\nจานวนเงิน 12,500.00 บาท\nโทรศัพท 02-123-4567"
    row = C.clean_text(spark.createDataFrame([(raw,)], "raw_text string"), level="normal").first()
    assert row.cleaned_text == "ใบกำกับภาษี\nบริษัท ตัวอย่าง จำกัด\nจำนวนเงิน 12,500.00 บาท\nโทรศัพท์ 02-123-4567"


def test_scores(spark):
    c = F.col("t")
    r = one(spark, "a/b:c", Q.symbol_score(c, c).alias("same"), Q.symbol_score(c, F.lit("abc")).alias("none"), Q.similarity(c, c).alias("sim"))
    assert (r.same, r.none, r.sim) == (100, 0, 1.0)
    r = one(spark, "the red fox", Q.word_distance(c, F.lit("the fox ran")).alias("d"))
    assert r.d == 2
    assert one(spark, "aab", Q.overlap_similarity(c, F.lit("abc")).alias("s")).s == pytest.approx(2 / 3)


def test_long_word_distance_matches_brute_force(spark):
    rnd = random.Random(3)
    a = [f"w{rnd.randrange(150)}" for _ in range(140)]
    b = [w for w in a if rnd.random() > 0.1]
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    assert one(spark, " ".join(a), Q.word_distance(F.col("t"), F.lit(" ".join(b))).alias("d")).d == prev[-1]


def test_labels_and_fields(spark):
    c = F.col("t")
    assert one(spark, "บันทึกข้อความ", K.document_type(c).alias("k")).k == "government_memo"
    assert one(spark, "these memories", K.document_type(c).alias("k")).k == "internal_memo"  # matches inside longer words
    r = one(spark, "Receipt No: R-5", E.receipt_fields(c)["number"].alias("n"))
    assert r.n == "No"  # the number pattern takes the word after the label
    rows = {(x.type, x.value) for x in FD.entity_rows(spark.createDataFrame([(1, SAMPLE)], "doc_id int, raw_text string")).collect()}
    assert ("ip", "10.240.36.254") in rows and ("ticket", "INC-2026-001") in rows


def test_garbled_tokens(spark):
    r = one(spark, "good ๐0ก๐0 text ipconfig", R.scrub_garbled(F.col("t")).alias("s"))
    assert r.s == "good text ipconfig"


def test_pre_header(spark):
    df = spark.createDataFrame([(1, "= % |\nกค 1/2\nบันทึกข้อความ\nเรื่อง x")], "doc_id int, raw_text string")
    assert [r.fate for r in L.pre_header_lines(df).orderBy("line_no").collect()] == ["noise", "review-code", "body", "body"]


def test_fuzzy_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 11))) for _ in range(120)})
    entries = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 11))) for _ in range(40)})

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    want = {(w, d) for w in words for d in entries if w == d or 1 - lev(w, d) / max(len(w), len(d)) > 0.72}
    got = M.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(d,) for d in entries], "word string"))
    assert {(r.w, r.d) for r in got.collect()} == want
