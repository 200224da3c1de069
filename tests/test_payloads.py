"""Engine payloads of odd shapes: each gives its lines or a rejected row."""

import json

from glyphmill.sources import tables as T

OLD = [[[0, 1], [2, 3]], ["old", 0.5]]
CASES = {
    1: ({"res": {"rec_texts": ["a", " ", "c"], "rec_scores": [0.5, 1, 97.456]}}, [(1, 1, "a", 50.0), (1, 3, "c", 97.46)], []),
    2: ([{"texts": ["x"], "scores": [1], "page_number": 4}, {"rec_texts": [], "texts": ["y", 5]}], [(4, 1, "x", 100.0), (1, 1, "y", 0.0), (1, 2, "5", 0.0)], []),
    3: ([[OLD, [None, ["two", None]]], [[[], ["  ", 3]], [None, ["four", "88"]]]], [(1, 1, "old", 50.0), (1, 2, "two", 0.0), (1, 4, "four", 88.0)], []),
    4: ({"texts": ["good", "bad", "none", "also"], "scores": [0.25, "n/a", None, "0.5"]}, [(1, 1, "good", 25.0), (1, 4, "also", 50.0)], [(2, "score is no number", "bad"), (3, "score is no number", "none")]),
    5: ("{broken", [], [(None, "not json", "{broken")]),
    6: (None, [], [(None, "no payload", None)]),
    7: ({"other": 1}, [], [(None, "no text", '{"other": 1}')]),
    8: (json.dumps({"texts": ["quoted"], "scores": [2]}), [(1, 1, "quoted", 2.0)], []),
    9: ([], [], [(None, "no text", "[]")]),
    10: ([[[[[[[[[[[[1]]]]]]]]]]]], [], [(None, "nested too deep", "[[[[[[[[[[[[1]]]]]]]]]]]]")]),
    11: ([[None, ["x", "n/a"]], OLD, 7, None, "text"], [(1, 2, "old", 50.0)], [(1, "score is no number", "x")]),
    12: ({"res": [{"res": {"texts": ["deep"], "lang": "tha+eng"}}]}, [(1, 1, "deep", 0.0)], []),
}


def test_payload_shapes(spark):
    rows = [(k, p if p is None or k == 5 else json.dumps(p), "extra") for k, (p, _, _) in CASES.items()]
    df = spark.createDataFrame(rows, "doc_id int, payload string, line_no string")
    lines = {}
    for r in T.ingest_engine_json(df).orderBy("doc_id").collect():
        lines.setdefault(r["doc_id"], []).append((r["page_no"], r["line_no"], r["text"], r["confidence"]))
    rejected = {}
    for r in T.rejected_payloads(df).collect():
        rejected.setdefault(r["doc_id"], []).append((r["line_no"], r["reason"], r["value"]))
    for k, (_, want, bad) in CASES.items():
        assert (k, sorted(lines.get(k, []))) == (k, sorted(want))
        assert (k, sorted(rejected.get(k, []), key=str)) == (k, sorted(bad, key=str))
    boxes = T.ingest_engine_json(df.where("doc_id in (2, 3)")).where("text in ('old', 'x')").collect()
    assert {r["text"]: r["bounding_box"] for r in boxes} == {"old": [[0.0, 1.0], [2.0, 3.0]], "x": []}
    assert T.ingest_engine_json(df.limit(0)).count() == 0 and T.rejected_payloads(df.limit(0)).count() == 0
