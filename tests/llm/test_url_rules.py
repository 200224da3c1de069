"""Url rules from a table, and links with entities and in comments."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

from glyphmill.llm import url_filter as U  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def best(rules, host, path):
    fits = [(len(h) + len(p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits and host else (None, None)


def test_table_of_rules(spark):
    rng = random.Random(2)
    label, part = lambda: rng.choice("ab") + rng.choice(["", "x"]), lambda: "/" + rng.choice(["", "p", "pq", "p/q"])
    rules = [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randint(1, 3))), rng.choice(["", part()])) for _ in range(60)]
    urls = [(k, f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}{part()}{rng.choice(['', '?z', '/r'])}", None) for k in range(300)] + [(900, None, None), (901, "nope", "")]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string")
    table = spark.createDataFrame([*rules, (None, "a", "/"), ("block", None, "/")], "action string, host string, path string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, rules=table).collect()}
    hosts = {r["page_id"]: (r["host"], r["path"]) for r in U.judge(pages, rules=()).collect()}
    for k, (host, path) in hosts.items():
        action, rule = best(rules, host, path)
        assert got[k][0] == rule and (action is None or got[k][1] == action)


def test_a_million_rules(spark):
    ids = spark.range(1_000_000)
    table = ids.select(F.lit("block").alias("action"), F.concat(F.lit("host"), "id", F.lit(".example")).alias("host"), F.when(F.col("id") % 2 == 0, "/a/").otherwise("/").alias("path"))
    pages = spark.createDataFrame([(1, "http://www.host10.example/a/b", ""), (2, "http://host10.example/b", ""), (3, "http://host11.example/b", ""), (4, "http://host1.example.org/", ""),
                                   (5, "http://c.io/", '<link rel=canonical href="http://x.host99999.example/q">')], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, rules=table).collect()}
    assert got == {1: ("host10.example/a/", "block"), 2: (None, "allow"), 3: ("host11.example/", "block"), 4: (None, "allow"), 5: (None, "block")}
    many = [("block", f"h{k}.example", "/") for k in range(U.MOST_RULES + 1)]
    assert U.judge(spark.createDataFrame([(1, "http://h7.example/", "")], "page_id long, url string, html string"), rules=many).first()["verdict"] == "block"


def test_entities_and_comments(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://a.io/", link("http://z.io/p?x=1&amp;y=2")), (2, "http://z.io/p?x=1&y=2", link("http://bad.net/")), (3, "http://b.io/", f"<!-- {link('http://bad.net/')} -->"), (4, "http://c.io/", f"<!-- never closed {link('http://bad.net/')}"),
            (5, "http://d.io/", f"<!-- a --> {link('http:&#x2F;&#47;bad.net/')} <!-- b -->"), (6, "http://e.io/", '<meta http-equiv="refresh" content="0; url=&quot;http://bad.net/&quot;">')]
    got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}
