"""The strict review of whole documents against the same decisions made line by line in plain Python."""

import re

from conftest import SMALL
from glyphmill.operators import lines as L
from glyphmill.sources import fixtures as S


def review(lines):
    """``lines`` of (line, clean, noise, score) in order: kept texts and the number removed."""
    removed = [line for line, clean, _, _ in lines if clean != line]
    filled = [(clean, noise, score) for _, clean, noise, score in lines if clean]
    if not filled:
        return [], len(lines)
    removed += [clean for clean, noise, _ in filled if noise]
    kept = [clean for clean, noise, _ in filled if not noise]
    if not kept:
        best = [c for c, _, _ in sorted(filled, key=lambda r: -r[2])[:5]]
        return best, len([c for c, _, _ in filled if c not in best]) + len(removed)
    seen, out = set(), []
    for clean in kept:
        key = re.sub(r"\s", "", clean.lower())
        if key not in seen:
            seen.add(key)
            out.append(clean)
    return out, len(set(removed))


def test_strict_review(spark):
    odd = [(-1, "= = = =\n~ ^ _\n| | |"), (-2, "Good line here\ngood  LINE here\nGood line here"), (-3, ""), (-4, "\n".join(f"~~{c}{c} 0O0O || {k}" for k, c in enumerate("abcdefgh"))), (-5, "วันที่ 1 มกราคม\n|||| 000 000\nวันที่ 1 มกราคม"), (-6, None)]
    docs = spark.createDataFrame(odd, "doc_id long, raw_text string").unionByName(S.documents(spark, SMALL).select("doc_id", "raw_text")).unionByName(S.rendered(spark, SMALL, "memos").where("doc_id % 7 = 0").selectExpr("doc_id + 1000000 as doc_id", "raw_text"))
    by_doc = {}
    for r in sorted(L.strict_line_table(docs).collect(), key=lambda r: (r["doc_id"], r["line_no"])):
        by_doc.setdefault(r["doc_id"], []).append((r["line"], r["clean"], r["noise"], r["score"]))
    want = {i: review(lines) for i, lines in by_doc.items()}
    got = {r["doc_id"]: ([x["clean"] for x in r["kept"]], r["removed"]) for r in L.strict_review(docs).collect()}
    assert got == want
    assert any(not any(not n for _, _, n, _ in v) for v in by_doc.values()) and any(n for _, n in want.values())
