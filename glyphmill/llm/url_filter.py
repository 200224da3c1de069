"""URL decisions with redirect equivalence, with built-in functions only.

Explicit rules judge a url by host and path, the longest that fits. Urls that lead to one another (a redirect by ``meta refresh``, a
canonical link, or the same url but for scheme, ``www.``, tracking parameters, fragment and a closing slash) form a component; a block
decision reaches every alias without a rule of its own, unless the component also holds an explicit allow, which goes first. Both ends of
every link are judged, whether they are pages or not. What no rule reaches is allowed.

Scale: a short list of rules is an expression, so judging needs no join. A table of rules of any size is met by equal keys: the suffixes of
each different host, then the beginnings of its paths of the lengths that the rules of such a suffix have. Decisions of link ends are aggregated per url, then with those of the pages
per component, before they are joined back. Links are staged with the decisions of their ends, so pages are parsed once. The components
work on one edge for each distinct link, over 64-bit names of normal urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import components, stage

# Fixed rules of the registered query: action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 200


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(action, rule)`` of the longest rule that fits, null if none does; at most 200 rules."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for one expression")
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def judged_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, action, rule)`` of the different ``urls(host, path)`` that a rule of ``rules(action, host, path)`` fits.

    The longest rule wins; of equally long ones that with the longer host, then a block. Rules with a null are left out.
    """
    rules = rules.select("action", F.col("host").alias("h"), F.col("path").alias("p")).where("action is not null and h is not null and p is not null").distinct()
    lengths = rules.groupBy("h").agg(F.collect_set(F.length("p")).alias("lengths"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    found = urls.select("host", "path").where("host <> ''").distinct().withColumn("suffix", F.explode(suffixes)).join(lengths, F.col("suffix") == F.col("h")).drop("h")
    found = found.select("host", "path", "suffix", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path")).withColumn("begin", F.substring("path", F.lit(1), F.col("n")))
    found = found.join(rules, (F.col("suffix") == F.col("h")) & (F.col("begin") == F.col("p")))
    best = F.max(F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.col("action"), F.concat("h", "p").alias("rule"))).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.action", "best.rule")


def _judge_by(df: DataFrame, host: Column, path: Column, rules, out: str) -> DataFrame:
    """``df`` with ``out``, the rule of its urls, from a list or a table of rules."""
    if not isinstance(rules, DataFrame):
        return df.withColumn(out, rule_of(host, path, rules))
    df = df.withColumns({"judged_host": host, "judged_path": path})
    urls = df.select(F.col("judged_host").alias("host"), F.col("judged_path").alias("path"))
    known = judged_by_table(urls, rules).select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.struct("action", "rule").alias(out))
    return df.join(known, (F.col("judged_host") == F.col("rule_host")) & (F.col("judged_path") == F.col("rule_path")), "left").drop("judged_host", "judged_path", "rule_host", "rule_path")


def normal(url: Column) -> Column:
    """The url without scheme, ``www.``, fragment, tracking parameters and closing slash; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    wanted = F.array_join(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)")), "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(wanted != "", F.concat(F.lit("?"), wanted)).otherwise("")))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/")
    # A dot segment at the end leaves its slash.
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


# Entities that occur in links; the last gives the sign that begins all of them.
ENTITIES = (("&(?:quot|#34|#[xX]22);", '"'), ("&(?:apos|#39|#[xX]27);", "'"), ("&(?:lt|#60|#[xX]3[cC]);", "<"), ("&(?:gt|#62|#[xX]3[eE]);", ">"), ("&(?:sol|#47|#[xX]2[fF]);", "/"), ("&(?:colon|#58|#[xX]3[aA]);", ":"), ("&(?:amp|#38|#[xX]26);", "&"))


def _decoded(link: Column) -> Column:
    out = link
    for pattern, sign in ENTITIES:
        out = F.regexp_replace(out, pattern, sign)
    return F.when(link.contains("&"), out).otherwise(link)


def link_targets(html: Column, url: Column) -> Column:
    """Absolute urls of canonical links and meta refreshes of a page, outside comments, their entities decoded.

    What has no scheme is completed from the page's own url: ``//host`` and ``/path``, ``?query``, and relative paths from the page's
    folder on, with ``.`` and ``..``. Targets of other schemes without ``//`` (``mailto:``) name no host and are left out; ``<base>`` isn't read.
    """
    html = F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(html)
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)<(?:link\b[^>]*\brel\s*=\s*["']?canonical\b|meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>|<link\b[^>]*\bhref\s*=[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), F.lit(0))
    raw = F.transform(tags, lambda t: _decoded(F.regexp_extract(t, r"""(?i)(?:\bhref\s*=|;\s*url\s*=)\s*["']?([^"'\s>]+)""", 1)))
    scheme = F.coalesce(F.nullif(F.regexp_extract(url, r"^([^:/?#]*)://", 1), F.lit("")), F.lit("http"))
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"^.*/", 0), F.lit("")), F.lit("/"))

    def absolute(r):
        path, rest = F.regexp_extract(r, r"^[^?#]*", 0), F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
        whole = F.when(path == "", F.concat(site, path_of(url), rest)).when(r.startswith("/"), F.concat(site, _without_dots(path), rest)).otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest))
        return F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), r).when(r.startswith("//"), F.concat(scheme, F.lit(":"), r)).when((r != "") & (host_of(url) != "") & ~r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), whole)

    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(F.transform(raw, absolute), lambda u: u.isNotNull()))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row; ``redirects(src_url, dst_url)`` adds redirects known from elsewhere.

    ``rules`` are a list of (action, host, path), or a table with these columns for more than a few.

    Ends of redirects and links that are no pages are judged too, and their decisions reach the pages they are aliases of.
    A null url, or one without ``://``, has an empty host and path and is no alias of anything; a null html has no links. Repeated rows and
    null ids are judged like others. Extra columns are not carried.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    rows = _judge_by(rows, F.col("host"), F.col("path"), rules, "own").withColumn("node", F.xxhash64(normal(url)))
    rows = rows.withColumn("node", F.when(normal(url).isNotNull(), F.col("node"))).drop("url")
    linked = pages.select(F.col(url_col).alias("from"), F.col(html_col).alias("page")).select(F.col("from").alias("url"), F.explode(link_targets(F.col("page"), F.col("from"))).alias("to"))
    if redirects is not None:
        linked = linked.unionByName(redirects.select(F.col("src_url").alias("url"), F.col("dst_url").alias("to")))
    for c in ("url", "to"):
        linked = _judge_by(linked, host_of(F.col(c)), path_of(F.col(c)), rules, f"{c}_rule")
    links = linked.select(*[normal(F.col(c)).alias(f"{c}_name") for c in ("url", "to")], *[F.col(f"{c}_rule.action").alias(f"{c}_own") for c in ("url", "to")])
    links = stage(links.select(F.xxhash64("url_name").alias("src"), F.xxhash64("to_name").alias("dst"), "url_own", "to_own").where("url_name is not null and to_name is not null").distinct(), "links")
    joined = components(links)
    rows = rows.join(joined, F.col("node") == F.col("id"), "left").withColumn("component", F.coalesce("component_id", "node")).drop("id", "component_id", "node")
    ends = links.select(F.col("src").alias("end"), F.col("url_own").alias("action")).unionByName(links.select(F.col("dst").alias("end"), F.col("to_own").alias("action")))
    ends = ends.where("action is not null").groupBy("end").agg(F.bool_or(F.col("action") == "allow").alias("allowed")).join(joined, F.col("end") == F.col("id"), "left")
    decisions = rows.where("own is not null and component is not null").select("component", (F.col("own.action") == "allow").alias("allowed"))
    decisions = decisions.unionByName(ends.select(F.coalesce("component_id", "end").alias("component"), "allowed"))
    decided = decisions.groupBy("component").agg(F.bool_or("allowed").alias("allowed")).withColumnRenamed("component", "c")
    rows = rows.join(decided, F.col("component") == F.col("c"), "left")
    reached = F.when(~F.col("allowed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", reached).alias("verdict"))
