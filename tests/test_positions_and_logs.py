"""Chained groups, ordered exports, page selection and the run log against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import matching as M, pages as PG, rollups as A
from glyphmill.plans import jobs as G
from glyphmill.sources import exports as X, staging


@pytest.mark.parametrize("step,descending", [(4096, False), (5, True), (1, False)])
def test_chained_groups(spark, step, descending):
    rng = random.Random(3)
    rows = [(k % 3 if k % 9 else None, rng.randrange(-60, 60)) for k in range(150)] + [(7, 5)]
    got = {(r["k"], r["v"]): r["no"] for r in M.chained_groups(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", 3, "no", descending, step).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        no, last = 0, None
        for v in sorted({v for kk, v in rows if kk == k}, reverse=descending):
            no += last is None or abs(v - last) >= 3
            want[k, v], last = no, v
    assert got == want


def test_columns_of_items(spark):
    items = spark.createDataFrame([(1, x, 0.0, k, "w") for k, x in enumerate([10.0, 12.4, 45.0, 200.0, 230.0, 600.0])] + [(2, 5.0, 0.0, 9, "w")], "doc_id int, x double, y double, item_id int, s string")
    assert {(r["item_id"], r["column_no"]) for r in M.item_columns(items, gap=40).collect()} == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (9, 1)}
    assert {tuple(r) for r in M.item_spread(items).collect()} == {(1, 590.0, 3), (2, 0.0, 1)}


def test_ordered_files(spark, tmp_path):
    pages = [(d, p, f"doc {d} page {p}\nline") for d in range(9) for p in range(1, 4)]
    random.Random(1).shuffle(pages)
    df = spark.createDataFrame([(*r, "ocr", 80, "en", "plain") for r in pages], "doc_id int, page_no int, cleaned_text string, method string, confidence int, language string, layout string")
    X.export_markdown_files(df, str(tmp_path / "md"), parts=4)
    lines = [r["line"] for r in X.read_ordered(spark, str(tmp_path / "md")).orderBy("line_no").collect()]
    assert [t for t in lines if t.startswith(("# ", "doc "))] == [t for d in range(9) for t in ("# Pages", *[f"doc {d} page {p}" for p in range(1, 4)])]
    assert len(list((tmp_path / "md").glob("part-*.txt"))) > 1
    numbered = [r["line_no"] for r in X.read_ordered(spark, str(tmp_path / "md")).collect()]
    assert sorted(numbered) == list(range(len(lines)))


def test_document_blocks(spark):
    pages = spark.createDataFrame([(1, 2, "two", "raw", False), (1, 1, "", " raw ", False), (1, 3, "", "", False), (1, 4, "x", "", True)], "doc_id int, page_no int, cleaned_text string, raw_text string, skipped_blank boolean")
    got = {r["page_no"]: r["value"].split("\n")[1:] for r in PG.document_blocks(pages).collect()}
    assert {p: (v[0], v[2]) for p, v in got.items()} == {1: ("หน้า 1", "raw"), 2: ("หน้า 2", "two"), 3: ("หน้า 3", "ไม่พบข้อความในหน้านี้")}


def test_run_log(spark, tmp_path):
    root = str(tmp_path / "log")
    texts = spark.createDataFrame([(k, f"f{k}", "the cat sat on 10.0.0.1", "the cat s4t on 10.0.0.1", "tne c4t", 90 + k) for k in range(3)], "item_id int, name string, truth string, raw string, enhanced string, quality_score int")
    first = G.log_benchmark(texts, root, "a", "2024-01-01", keep=4)
    assert first.count() == 3 and {r["cer"] for r in first.collect()} == {4.3}
    both = G.log_benchmark(texts, root, "a", "2024-01-02", keep=4)
    assert sorted((str(r["created_at"])[:10], r["id"]) for r in both.collect()) == [("2024-01-01", "2"), ("2024-01-02", "0"), ("2024-01-02", "1"), ("2024-01-02", "2")]
    G.log_benchmark(texts.limit(1), root, "b", "2024-01-03", keep=4)
    summary = {r["engine"]: (r["runs"], r["quality_score"], r["cer"]) for r in A.benchmark_summary(staging.read_version(spark, root)).collect()}
    assert summary["a"] == (4, 91.3, 4.3) and summary["b"][0] == 1
