"""The entropy kind of the secret scan: brute force of its rule, names that are no secrets, urls, and its precision on the corpus."""

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from glyphmill.llm import secret_scan as S, shared  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

NAMES = ["INTERNATIONALIZATION", "UNCONSTITUTIONALLY", "CHARACTERIZATIONS", "GESCHWINDIGKEITEN", "EISENBAHNSTRECKE2024", "getUserByIdAndName2", "PySparkDataFrame2024Report", "HTML5CanvasRenderingContext2D",
         "org/apache/spark/sql/DataFrame3", "wikipedia/File/Example1234.png", "ERSCHSCHBERBERTZ"]


def reads_like_a_name(part):
    pairs = [part[k:k + 2] for k in range(len(part) - 1) if re.fullmatch("[A-Za-z]{2}", part[k:k + 2])]
    prose = sum(p.lower() in S.PAIRS for p in pairs)
    return prose * S.PROSE - (len(pairs) - prose) * S.OTHER - len(re.findall("[0-9]+", part)) * S.NUMBER >= S.NAME


def reaches(run, window, bits):
    for k in range(len(run) - window + 1):
        some = run[k:k + window]
        name = next(n for n, pattern, _ in S.CLASSES if re.search(pattern, some))
        if round(brute.entropy(some), 9) >= bits[name]:
            return True
    return False


def entropy_spans(text):
    out = []
    for m in re.finditer(S.CANDIDATE, text):
        run, parts = m[0], re.split("[-_/+=]+", m[0])
        if any(re.search(p, run) for p in S.ALLOW) or all(len(p) <= S.BRIEF or re.search(f"^{S._PART}$", p) or reads_like_a_name(p) for p in parts):
            continue
        if re.search(S.URL_PATH, text[max(0, m.start() - S.LONGEST_URL):m.start()]):
            continue
        if len(run) < S.WINDOW:
            hit = reaches(run, S.SHORT, S.SHORT_BITS)
        else:
            hit = reaches(run, S.WINDOW, {n: b for n, _, b in S.CLASSES}) or any(reaches(p, S.SHORT, S.SHORT_BITS) for p in parts if S.SHORT <= len(p) < S.WINDOW)
        if hit and not any(s[0] < m.end() and m.start() < s[2] for s in brute.fixed_spans(text)):
            out.append((m.start(), m.end()))
    return out


def test_spans_equal_brute_force(spark):
    rng = random.Random(8)
    alphabets = ["0123456789", "ABCDEF0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "aAbB12", "0123456789ABCDEFGHIJ"]
    part = lambda: rng.choice(NAMES) if rng.random() < 0.3 else "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(3, 40))) if rng.random() < 0.5 else "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randint(3, 40)))
    lead = ["", "see ", "https://host.example/a/", "https://host.example/a?key=", "x://" + "y" * 3000 + "/", "é "]
    texts = [rng.choice(lead) + rng.choice(["", "-", "/", "_", "="]).join(part() for _ in range(rng.randint(1, 3))) + rng.choice(["", " end", "."]) for _ in range(400)] + [f"see {n} here" for n in NAMES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["entropy"]] for r in S.scan(df).collect()}
    want = {i: entropy_spans(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) > 60
    assert not any(want[i] for i in range(400, len(texts)))


def test_urls(spark):
    key = "Zq8Lw2Nx7Rv4Tb6Yk3Pd9Hs5"
    texts = [f"https://a.example/{key}/b", f"https://a.example/p?k={key}", f"https://a.example/x {key}", f"a/b/{key}"]
    got = [len(r["entropy"]) for r in S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [0, 1, 1, 1]


def test_spans_of_the_corpus_are_no_words(spark):
    """No span of the corpus is made of letters alone; all hold digits and letters mixed."""
    found = S.scan(shared.table(spark, "/root/testdata/sf0.1", "documents")).select(F.explode("entropy").alias("s"), "text")
    spans = [r["x"] for r in found.select(F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("x")).collect()]
    assert all(re.search("[0-9]", x) and re.search("[A-Za-z]", x) for x in spans), spans
