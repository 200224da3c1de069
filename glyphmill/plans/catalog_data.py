"""Registered queries: labels, fields, scores, matching, roll-ups, ranking, jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import fixed
from ..functions import classify as K, extract as E, scores as Q, text as P
from ..operators import fields as FD, lines as L, matching as M, pages as PG, readings as V, rollups as A, rules as U
from ..sources import exports as X, fixtures as S, tables as T
from ..sources.staging import scratch
from ..streaming import streams as ST
from ..streaming.streams import stream_quality as quality_windows
from . import jobs as G
from .catalog_text import run_pattern, sql_rule
from .registry import bare, every, get, hit, line_rows, lines, lit, num, query, rep, squeeze, tally, trim, with_, words

D = S.documents
DOCS = with_()
CAND = with_(more=f"cand as ({S.CANDIDATES_SQL})")


# --- labels --------------------------------------------------------------------------------


def _type_sql(c):
    gov = " ".join(f"when {hit(c, p, f)} then {lit(n)}" for n, p, f in K.GOVERNMENT_TYPES)
    rest = " ".join(f"when {hit(f'lower({c})', p, f)} then {lit(n)}" for n, p, f in K.OTHER_TYPES)
    return f"case {gov} {rest} when {hit(c, K.TABLE_TYPE)} then 'table' else 'general' end"


MIX = "mix as (select * from (" + " union all ".join(f"select '{n}' as kind, doc_id, raw_text from {n}" for n in ("docs", "receipts", "tickets", "emails", "tables", "memos")) + "))"


def _mix(spark, d):
    parts = [S.rendered(spark, d, n).select(F.lit(n).alias("kind"), "doc_id", "raw_text") for n in ("docs", "receipts", "tickets", "emails", "tables", "memos")]
    return reduce(lambda a, b: a.unionAll(b), parts)


MIXED = with_("receipts", "tickets", "emails", "tables", "memos", more=MIX)


@query("document_type", MIXED + f"select kind, {_type_sql('raw_text')} as document_type, count(*) as n from mix group by all")
def document_type(spark, d):
    return _mix(spark, d).groupBy("kind", K.document_type(F.col("raw_text")).alias("document_type")).agg(F.count("*").alias("n"))


@query("detect_language", MIXED + f"select kind, case when t and e then 'ไทย + อังกฤษ' when t then 'ไทย' when e then 'อังกฤษ' else 'ไม่ชัดเจน' end as language, count(*) as n from (select kind, {hit('raw_text', '[ก-ฮ' + P.TONES + ']')} as t, {hit('raw_text', '[A-Za-z]')} as e from mix) group by all")
def detect_language(spark, d):
    return _mix(spark, d).groupBy("kind", K.detect_language(F.col("raw_text")).alias("language")).agg(F.count("*").alias("n"))


def _n_lines(pattern, flags="", c="l"):
    return f"len(list_filter({c}, lambda x: {hit('x', pattern, flags)}))"


_TAB = r"\t|\s{3,}|[,|].+[,|]"
_KV = r"[:：]\s*\S+"
_PNO = r"^(page|หน้า)\s*\d+|\d+\s*/\s*\d+$"


@query("page_layout", MIXED + f"""select kind, doc_id, case when {_n_lines(_TAB)} >= greatest(2, len(l) * 0.25) then 'table'
    when {_n_lines(_KV)} >= 3 then 'form/key-value' when len(l) > 4 and length(l[1]) < 90 and length(l[-1]) < 90 and {_n_lines(_PNO, 'i')} > 0 then 'header/footer/page-number'
    when len(l) > 8 then 'paragraphs' else 'plain' end as layout from (select kind, doc_id, {lines('raw_text')} as l from mix)""")
def page_layout(spark, d):
    return _mix(spark, d).select("kind", "doc_id", K.page_layout(F.col("raw_text")).alias("layout"))


_TL = f"({hit('x', chr(92) + 't|' + chr(92) + '|')} or len(regexp_split_to_array(x, '\\s{{2,}}')) >= 3)"


@query("layout_blocks", MIXED + f"""select kind, doc_id, len(l) as n_lines, len(list_filter(l, lambda x: {_TL})) >= 2 as has_table, {_n_lines(K.KEY_VALUE_LINE)} >= 2 as has_kv,
    array_to_string(list_slice(l, 1, 5), '|') as header, array_to_string(list_slice(l, greatest(1, len(l) - 4), len(l)), '|') as footer from (select kind, doc_id, {lines('raw_text')} as l from mix)""")
def layout_blocks(spark, d):
    b = _mix(spark, d).select("kind", "doc_id", K.layout_blocks(F.col("raw_text")).alias("b"))
    return b.select("kind", "doc_id", "b.n_lines", "b.has_table", "b.has_kv", F.array_join("b.header", "|").alias("header"), F.array_join("b.footer", "|").alias("footer"))


_ACC = " ".join(f"when {hit('raw_text', p, f)}{chr(32) + 'and contains(raw_text, ' + lit('@') + ')' if n == 'email' else ''} then {lit(n)}" for n, p, f in K.ACCURACY_LAYOUTS)


@query("accuracy_layout", MIXED + f"select kind, doc_id, case {_ACC} when len(list_filter(string_split(raw_text, chr(10)), lambda x: len(regexp_split_to_array(x, '\\s{{2,}}|\\t|\\|')) >= 3)) >= 2 then 'table' else 'plain' end as layout from mix")
def accuracy_layout(spark, d):
    return _mix(spark, d).select("kind", "doc_id", K.accuracy_layout(F.col("raw_text")).alias("layout"))


@query("accuracy_reformat")
def accuracy_reformat(spark, d):
    return _mix(spark, d).select("kind", "doc_id", K.accuracy_reformat(F.col("raw_text")).alias("text"))


_BY = {}
for _p, _w in fixed.pairs("profiles"):
    _BY.setdefault(_p, []).append(f"cast(contains(lower(raw_text), {lit(_w.lower())}) as int)")
_SC = ", ".join(f"{' + '.join(v)} as s_{k}" for k, v in _BY.items())
_TOP = "greatest(" + ", ".join(f"s_{k}" for k in _BY) + ")"
_PF = " ".join(f"when {_TOP} > 0 and s_{k} = {_TOP} then '{k}'" for k in _BY)


@query("document_profile", MIXED + f"select kind, doc_id, case {_PF} else 'general' end as profile, {_TOP} as score from (select kind, doc_id, {_SC} from mix)")
def document_profile(spark, d):
    return _mix(spark, d).select("kind", "doc_id", K.document_profile(F.col("raw_text")).alias("p")).select("kind", "doc_id", "p.profile", "p.score")


_FN = " ".join(f"when {hit('lower(url)', p)} then '{n}'" for n, p in K.FILENAME_HINTS)


@query("filename_hint", f"select page_id, case {_FN} else 'general' end as hint from pages")
def filename_hint(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", K.filename_hint(F.col("url")).alias("hint"))


METRICS = ("width", "height", "avg", "contrast", "blur", "dark_ratio", "light_ratio", "border_dark", "skew")
_CANVAS = "100 - (case when least(width, height) < 700 then 16 else 0 end + case when blur < 18 then 18 else 0 end + case when avg < 82 then 14 else 0 end + case when avg > 218 then 12 else 0 end + case when contrast < 38 then 14 else 0 end + case when dark_ratio > 0.55 then 10 else 0 end + case when light_ratio > 0.82 and contrast < 44 then 8 else 0 end)"


@query("quality_gate", with_("image_metrics") + f"select doc_id, greatest(35, least(99, s)) as score, case when s >= 82 then 'good' when s >= 64 then 'warn' else 'bad' end as level from (select doc_id, {_CANVAS} as s from image_metrics)")
def quality_gate(spark, d):
    m = {n: F.col(n) for n in METRICS}
    return S.rendered(spark, d, "image_metrics").select("doc_id", K.quality_gate(m).alias("q")).select("doc_id", "q.score", "q.level")


@query("route_preset")
def route_preset(spark, d):
    m = {n: F.col(n) for n in METRICS}
    both = S.rendered(spark, d, "image_metrics").join(S.rendered(spark, d, "tickets"), "doc_id")
    both = both.withColumn("_lv", K.quality_gate(m, "phase")["level"]).withColumn("_tab", K.layout_blocks(F.col("raw_text"))["has_table"])
    r = K.route_preset(F.col("_lv"), K.small_text(m), F.col("_tab"), F.col("raw_text"), F.col("dark_ratio"))
    return both.select("doc_id", r.alias("r")).select("doc_id", "r.engine", "r.preset", "r.reason")


@query("budget_year_check", with_("budget") + "select doc_id, (2560 + doc_id % 10) - cast(right(raw_text, 4) as int) > 2 as warning from budget")
def budget_year_check(spark, d):
    """The latest year of these memos is the document year or the budget year itself."""
    return S.rendered(spark, d, "budget").select("doc_id", K.budget_year_warning(F.col("raw_text")).alias("warning"))


@query("text_quality_gate")
def text_quality_gate(spark, d):
    rep_ = G.batch_report(S.rendered(spark, d, "thai_notes"))
    g = K.text_quality_gate(F.col("raw_text"), F.col("cleaned_text"), F.col("confidence"), F.col("n_fixes"), F.col("doc_id") % 3)
    return rep_.select("doc_id", g.alias("g")).select("doc_id", "g.level", F.array_join("g.reasons", ",").alias("reasons"))


# --- fields --------------------------------------------------------------------------------


def _entity_sql(src):
    return " union all ".join(f"select doc_id, '{k}' as type, unnest({every('raw_text', p, 'i' if k == 'amount' else f)}) as value from {src}" for k, p, f in E.ENTITIES)


@query("important_fields", with_("tickets", "emails", more=f"e as ({_entity_sql('docs')} union all {_entity_sql('tickets')} union all {_entity_sql('emails')})") + "select doc_id, type, value, count(*) as n from e group by all")
def important_fields(spark, d):
    parts = [FD.entity_rows(S.rendered(spark, d, n)) for n in ("docs", "tickets", "emails")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("doc_id", "type", "value").agg(F.count("*").alias("n"))


@query("validate_fields", with_("tickets", more=f"e as ({_entity_sql('tickets')})") + "select doc_id, type, value, 'invalid-ip-range' as issue from e where type = 'ip' and len(list_filter(string_split(value, '.'), lambda p: cast(p as int) > 255)) > 0")
def validate_fields(spark, d):
    return FD.field_issues(FD.entity_rows(S.rendered(spark, d, "tickets")))


@query("money_and_dates", with_("receipts") + f"""select doc_id, array_to_string(list_filter(list_transform({every('raw_text', r'\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b')}, lambda x: trim(x)), lambda x: x <> ''), '|') as dates,
    len(list_distinct(list_transform({every('raw_text', E.MONEY)}, lambda x: {squeeze('x')}))) as n_money from receipts""")
def money_and_dates(spark, d):
    c = F.col("raw_text")
    return S.rendered(spark, d, "receipts").select("doc_id", F.array_join(E.dates(c), "|").alias("dates"), F.size(E.money(c)).alias("n_money"))


@query("receipt_fields", """select o_orderkey as doc_id, 'STORE ' || c_name as store, 'R-' || cast(o_orderkey as varchar) as number, strftime(o_orderdate, '%d/%m/%Y') as date,
    cast(cast(o_totalprice as decimal(18,2)) as varchar) as total from orders join customer on o_custkey = c_custkey""")
def receipt_fields(spark, d):
    r = S.rendered(spark, d, "receipts").select("doc_id", E.receipt_fields(F.col("raw_text")).alias("r"))
    return r.select("doc_id", "r.store", "r.number", "r.date", "r.total")


@query("receipt_items", """select o_orderkey as doc_id, unnest(['STORE Customer#', 'Receipt: R-', 'Date: /' || strftime(o_orderdate, '%m') || '/', 'Blue ring']) as name,
    unnest([substr(c_name, 10), cast(o_orderkey as varchar), strftime(o_orderdate, '%d'), cast(o_orderkey % 4 + 1 as varchar) || ' x']) as qty,
    unnest([substr(c_name, 10), cast(o_orderkey as varchar), strftime(o_orderdate, '%Y'), cast(o_orderkey % 90 + 10 as varchar) || '.50']) as price from orders join customer on o_custkey = c_custkey""")
def receipt_items(spark, d):
    """Every line with a price, its name and quantity."""
    return S.rendered(spark, d, "receipts").select("doc_id", F.inline(E.receipt_items(F.col("raw_text")))).select("doc_id", "name", "qty", "price")


@query("invoice_fields", "select o_orderkey as doc_id, 'INV-' || cast(o_orderkey as varchar) as invoice_no, lpad(cast(o_custkey as varchar), 13, '0') as tax_id, cast(cast(o_totalprice as decimal(18,2)) as varchar) as total from orders")
def invoice_fields(spark, d):
    c = F.col("raw_text")
    r = S.rendered(spark, d, "invoices").select("doc_id", E.invoice_fields(c).alias("i"), E.receipt_fields(c)["total"].alias("total"))
    return r.select("doc_id", "i.invoice_no", "i.tax_id", "total")


@query("ticket_fields", with_("tickets") + """select event_id as doc_id, 'INC-' || cast(event_id as varchar) as ticket_no, 'core-' || cast(user_id % 5 as varchar) as system, 'link down on Gi0/' || cast(event_id % 24 as varchar) as issue,
    '10.' || cast(user_id % 256 as varchar) || '.' || cast(event_id % 300 as varchar) || '.7' as ip, 'VLAN ' || cast(event_id % 90 as varchar) as vlan, array_to_string(list_distinct(""" + every("raw_text", E.DEVICES, "i") + """), '|') as device, 'Gi0/' || cast(event_id % 24 as varchar) as interface,
    case when event_id % 3 = 0 then 'high' else 'low' end as severity, 'user' || cast(user_id as varchar) as requester, """ + get("raw_text", r"(\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b)") + """ as time from events join tickets on doc_id = event_id""")
def ticket_fields(spark, d):
    t = S.rendered(spark, d, "tickets").select("doc_id", E.ticket_fields(F.col("raw_text")).alias("t"))
    j = lambda n: F.array_join("t." + n, "|").alias(n)
    return t.select("doc_id", "t.ticket_no", "t.system", "t.issue", j("ip"), j("vlan"), j("device"), j("interface"), "t.severity", "t.requester", "t.time")


@query("email_fields", """select conv_id * 100 + turn as doc_id, 'user' || cast(conv_id as varchar) || '@mail.example.com' as sender, 'desk@example.org' as recipient, 'Case ' || cast(conv_id as varchar) || '-' || cast(turn as varchar) as subject,
    'https://example.org/t/' || cast(conv_id as varchar) as urls from conversations""")
def email_fields(spark, d):
    e = S.rendered(spark, d, "emails").select("doc_id", E.email_fields(F.col("raw_text")).alias("e"))
    return e.select("doc_id", F.col("e.from").alias("sender"), F.col("e.to").alias("recipient"), "e.subject", F.array_join("e.urls", "|").alias("urls"))


@query("table_fields", "select p_partkey as doc_id, 'name|brand|price' as headers, 2 as row_count, p_name || '|' || p_brand || '|' || cast(cast(p_retailprice as decimal(18,2)) as varchar) as first_row from part")
def table_fields(spark, d):
    t = S.rendered(spark, d, "tables").select("doc_id", E.table_fields(F.col("raw_text")).alias("t"))
    return t.select("doc_id", F.array_join("t.headers", "|").alias("headers"), "t.row_count", F.array_join(F.get("t.rows", F.lit(0)), "|").alias("first_row"))


@query("government_fields")
def government_fields(spark, d):
    return S.rendered(spark, d, "memos").select("doc_id", E.government_fields(F.col("raw_text")).alias("g")).selectExpr(
        "doc_id", "g.department", "g.document_no", "g.date", "g.subject", "g.to", "g.phone", "g.signer", "g.position", "g.found", "g.total")


@query("network_details", """select event_id as doc_id, 'Yes' as dhcp, '10.' || cast(user_id % 250 as varchar) || '.' || cast(event_id % 250 as varchar) || '.7' as ip, '255.255.0.0' as mask,
    '10.0.0.' || cast(event_id % 250 as varchar) as gateway, strftime(ts, '%d/%m/%Y') || ' 08:00:00' as obtained from events""")
def network_details(spark, d):
    n = S.rendered(spark, d, "network").select("doc_id", E.network_details(F.col("raw_text")).alias("n"))
    return n.select("doc_id", "n.dhcp", "n.ip", "n.mask", "n.gateway", "n.obtained")


@query("device_fields", """select event_id as doc_id, 'HP ' || cast(user_id as varchar) as brand, 'Linux' as os, case when event_id % 4 = 0 then '' else 'SN-' || cast(event_id + 10000 as varchar) end as serial,
    case when event_id % 3 = 0 then '' else '00:1A:2B:3C:4D:' || lpad(cast(event_id % 90 + 10 as varchar), 2, '0') end as mac from events""")
def device_fields(spark, d):
    return S.rendered(spark, d, "devices").select("doc_id", E.device_fields(F.col("raw_text")).alias("v")).select("doc_id", "v.brand", "v.os", "v.serial", "v.mac")


@query("rescue_text")
def rescue_text(spark, d):
    return S.rendered(spark, d, "devices").select("doc_id", E.rescue_text(F.col("raw_text")).alias("text"))


@query("sections", """select event_id as doc_id, 4 as n, '1|1|2|3' as numbers, 'ผลลัพธ์ OCR ที่จัดเรียงแล้ว|Check link|Step 2 renew|Close case:' as headings from events""")
def sections(spark, d):
    s = S.rendered(spark, d, "steps").select("doc_id", E.sections(F.col("raw_text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_join("s.number", "|").alias("numbers"), F.array_join("s.heading", "|").alias("headings"))


@query("commands_and_settings", with_("steps") + f"select doc_id, array_to_string({every('raw_text', E.COMMAND, 'i')}, '|') as commands, array_to_string({every('raw_text', E.QUOTED, '', 1)}, '|') as settings from steps")
def commands_and_settings(spark, d):
    c = F.col("raw_text")
    return S.rendered(spark, d, "steps").select("doc_id", F.array_join(E.commands(c), "|").alias("commands"), F.array_join(E.settings(c), "|").alias("settings"))


# What the fields of a kind must hold, from the tables that its texts are made of.
_FIELDS = """fl as (select 'receipts' as kind, count(distinct o_orderkey) as names, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders join customer on o_custkey = c_custkey
    union all select 'tickets', count(distinct event_id), cast(sum(user_id % 5) as double) from events union all select 'emails', count(distinct conv_id), cast(count(*) as double) from conversations
    union all select 'tables', count(distinct p_name), cast(2 * count(*) as double) from part)"""


@query("extract_fields", with_("receipts", "tickets", "emails", "tables", "memos", more=MIX + f", {_FIELDS}, ty as (select kind, {_type_sql('raw_text')} as document_type, count(*) as n from mix group by all)") + "select kind, document_type, n, coalesce(names, 0) as names, coalesce(amount, 0) as amount from ty left join fl using (kind)")
def extract_fields(spark, d):
    """Types of all documents, with the names and amounts found in the fields of the rendered ones."""
    out = FD.extract_fields(_mix(spark, d)).where(F.col("kind").isNotNull())
    own = F.col("kind").isin("receipts", "tickets", "emails", "tables")
    name = F.coalesce("receipt.number", "ticket.ticket_no", "email.from", F.get(F.get("table.rows", F.lit(0)), F.lit(0)))
    amount = F.coalesce(F.col("receipt.total").try_cast("decimal(18,2)"), F.regexp_extract("ticket.system", "([0-9]+)$", 1).try_cast("decimal(18,2)"), F.when(F.col("email.subject").isNotNull(), F.lit(1)).cast("decimal(18,2)"),
                        F.col("table.row_count").cast("decimal(18,2)"))
    found = out.groupBy("kind", "document_type").agg(F.count("*").alias("n"), F.countDistinct(F.when(own, name)).alias("names"), F.coalesce(F.sum(F.when(own, amount)), F.lit(0)).cast("double").alias("amount"))
    return found


@query("extract_fields_rows")
def extract_fields_rows(spark, d):
    """Every document with all of its fields."""
    out = FD.extract_fields(_mix(spark, d))
    return out.select("kind", "doc_id", "document_type", *[F.to_json(n).alias(n) for n in ("receipt", "invoice", "ticket", "email", "table", "government")])


@query("validate_document", with_("tickets") + "select doc_id, 3 as passed, 3 as total, 100 as score from tickets")
def validate_document(spark, d):
    return FD.validate_documents(S.rendered(spark, d, "tickets")).select("doc_id", "passed", "total", "score")


@query("validate_document_mixed")
def validate_document_mixed(spark, d):
    return FD.validate_documents(_mix(spark, d)).select("kind", "doc_id", "document_type", "passed", "total", "score")


# --- scores --------------------------------------------------------------------------------


def _symbols(raw, clean):
    raw_n = [tally(raw, s) for s in Q.SYMBOLS]
    kept = [f"least({r}, {tally(clean, s)})" for r, s in zip(raw_n, Q.SYMBOLS)]
    return " + ".join(raw_n), " + ".join(kept)


_RT, _KT = _symbols("raw", "clean")
_TWO = f"tw as (select doc_id, source, raw_text as raw, {trim(rep('raw_text', '[.%&] ', ' '))} as clean from docs)"
_SCORE = "case when rt > 0 then cast(floor(cast(kt as double) / rt * 100 + 0.5) as int) else 100 end"
_SYM = with_(more=f"{_TWO}, sm as (select doc_id, source, {_RT} as rt, {_KT} as kt from tw)")


@query("symbol_preservation", _SYM + f"select doc_id, rt as raw_total, kt as kept, {_SCORE} as score, {_SCORE} < 92 as review from sm")
def symbol_preservation(spark, d):
    df = D(spark, d).withColumn("clean", P.trim(P.sub(F.col("raw_text"), "[.%&] ", " ")))
    return df.select("doc_id", Q.symbol_preservation(F.col("raw_text"), F.col("clean")).alias("s")).select("doc_id", "s.raw_total", "s.kept", "s.score", "s.review")


_WSN = trim(rep(rep("replace(raw_text, '$1$2', '')", r"[ \t]+", " "), r"\n{3,}", "\n\n"))


@query("symbol_preservation_by_source", with_(more=f"tw as (select source, raw_text as raw, {rep(_WSN, '[●○◦▪▫◆◇□■]', '')} as clean from docs), sm as (select source, {_RT} as rt, {_KT} as kt from tw)") +
       f"select source, count(*) as n_docs, sum({_SCORE}) as score_sum, min({_SCORE}) as worst from sm group by source")
def symbol_preservation_by_source(spark, d):
    df = D(spark, d).withColumn("_c", P.ws_normalize(F.col("raw_text")))
    df = df.withColumn("_c", P.strip_strange(F.col("_c"))["text"])
    df = df.withColumn("score", Q.symbol_score(F.col("raw_text"), F.col("_c")))
    return df.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("score").alias("score_sum"), F.min("score").alias("worst"))


_TERMS = {"latin": "[A-Za-z]", "digits": "[0-9]", "weird": Q.WEIRD, "short_latin": r"\b[a-zA-Z]{1,2}\b", "suspicious_ip": Q.SUSPICIOUS_IP}
_TERMS_I = {"network": Q.NETWORK_TERMS, "doc": Q.DOC_TERMS, "ui": Q.UI_TERMS, "ui_control": Q.UI_CONTROL_TERMS, "capture": Q.CAPTURE_TERMS}


@query("ocr_text_score_terms", DOCS + "select doc_id, " + ", ".join([f"{num('raw_text', p)} as {n}" for n, p in _TERMS.items()] + [f"{num('raw_text', p, 'i')} as {n}" for n, p in _TERMS_I.items()]) + f", length({bare('raw_text')}) as size from docs")
def ocr_text_score_terms(spark, d):
    t = Q.text_score_terms(F.col("raw_text"))
    return D(spark, d).select("doc_id", *[t[n].alias(n) for n in (*_TERMS, *_TERMS_I, "size")])


@query("ocr_text_score")
def ocr_text_score(spark, d):
    c = F.col("raw_text")
    return _mix(spark, d).select("kind", "doc_id", F.round(Q.ocr_text_score(c, F.lit(80)), 3).alias("score"), Q.ocr_risk(c).alias("risk"), F.round(Q.thai_readability(c), 3).alias("readability"))


_CLEANED = f"cl as (select doc_id, raw_text as raw, {rep('raw_text', '[$#] ?', '')} as clean, doc_id % 40 as fixes, doc_id % 15 as susp from docs)"


@query("clean_confidence", with_(more=_CLEANED) + f"""select doc_id, case when length({bare('raw')}) = 0 then 0 else greatest(35, least(99, floor(100 - least(35, {num('raw', Q.STRANGE_MARKS)} * 3) - least(25.0, fixes * 0.8) - least(18.0, susp * 1.4)
    - case when length(clean) < length(raw) * 0.45 then 10 else 0 end + 0.5))) end as confidence from cl""")
def clean_confidence(spark, d):
    df = D(spark, d).withColumn("clean", P.sub(F.col("raw_text"), "[$#] ?", ""))
    return df.select("doc_id", Q.clean_confidence(F.col("raw_text"), F.col("clean"), F.col("doc_id") % 40, F.col("doc_id") % 15).alias("confidence"))


@query("line_word_confidence", with_(more=line_rows()) + f"""select doc_id, line_no, greatest(20, least(99, b - case when {hit('line', '[�ƟθϴƩΣÉÊÈË]')} then 24 else 0 end - case when {num('line', r'[|{}<>~`_^=+*' + chr(92) * 2 + '/]')} > greatest(4.0, length(line) * 0.18) then 16 else 0 end
    - case when length(line) < 3 then 10 else 0 end)) as confidence from (select *, 60 + (doc_id * 7) % 40 as b from ls)""")
def line_word_confidence(spark, d):
    rows = T.split_lines(D(spark, d)).withColumn("b", (60 + F.col("doc_id") * 7 % 40).cast("int"))
    return rows.select("doc_id", "line_no", Q.line_confidence(F.col("line"), F.col("b"), F.lit("ocr")).alias("confidence"))


@query("completeness", DOCS + f"select doc_id, greatest(0, least(100, least(60, len({words('raw_text')}) * 2) + least(25, len({lines('raw_text')}) * 3) - {num('raw_text', '[�{}<>~`_^=]+')} * 8 + 15)) as score from docs")
def completeness(spark, d):
    return D(spark, d).select("doc_id", Q.completeness(F.col("raw_text")).alias("score"))


@query("document_logic", "select event_id as doc_id, 100 as score from events")
def document_logic(spark, d):
    df = FD.with_fields(S.rendered(spark, d, "tickets"), "raw_text")
    return df.select("doc_id", E.document_logic(F.col("raw_text"), FD.field_columns(), F.lit(50.0)).alias("score"))


@query("line_scores", with_(more=line_rows()) + f"select doc_id, line_no, floor((length(line) + {num('line', '[ก-ฮ]')} * 2 + {num('line', '[A-Za-z0-9]')} * 0.8 - {num('line', '[�{}<>~`^|]')} * 8 - {num('line', run_pattern(5))} * 10) * 10 + 0.5) as score from ls")
def line_scores(spark, d):
    rows = T.split_lines(D(spark, d))
    return rows.select("doc_id", "line_no", F.floor(Q.accuracy_line_score(F.col("line")) * 10 + F.lit(0.5)).alias("score"))


# Two letters for one, or a letter lost: every letter concerned costs an edit at least, so the fewest edits are known without a search.
_MISREAD = "case when doc_id % 2 = 0 then replace(raw_text, 'o', '00') else replace(raw_text, 'e', '') end"
_LETTER = "case when doc_id % 2 = 0 then 'o' else 'e' end"
_NOTES = "case when doc_id < 0 then replace(raw_text, 'า', '') else raw_text end"
_BOTH = "src as (select -doc_id - 1 as doc_id, raw_text, 'า' as letter, 1 as cost from thai_notes union all select doc_id, raw_text, " + _LETTER + ", case when doc_id % 2 = 0 then 2 else 1 end from docs)"


def _rate(edits: str, size: str) -> str:
    return f"case when {size} > 0 then floor({edits} / {size} * 1000 + 0.5) / 10 end"


_N = "(length(raw_text) - length(replace(raw_text, letter, '')))"
_THAI = rep("raw_text", "[^\u0e00-\u0e7f]", "")


@query("error_rates", with_("thai_notes", more=_BOTH) + f"""select doc_id, {_rate(f'{_N} * cost', 'length(raw_text)')} as cer, {_rate(f"len(list_filter({words('raw_text')}, lambda w: contains(w, letter)))", f"len({words('raw_text')})")} as wer,
    {_rate(f"case when letter = 'า' then {_N} else 0 end", f'length({_THAI})')} as thai_cer from src""")
def error_rates(spark, d):
    """Error rates of whole texts against a misread copy."""
    notes = S.rendered(spark, d, "thai_notes").select((-F.col("doc_id") - 1).alias("doc_id"), "raw_text").withColumn("hyp", F.replace("raw_text", F.lit("า"), F.lit("")))
    both = notes.unionByName(D(spark, d).select("doc_id", "raw_text", F.expr(_MISREAD).alias("hyp")))
    return M.error_rates(both, ref="raw_text")


@query("word_error_rate", with_() + f"""select doc_id, {_rate(f"len(list_filter({words('raw_text')}, lambda w: contains(w, 'o')))", f"len({words('raw_text')})")} as wer, {_rate('0', f'length({_THAI})')} as thai_cer from docs""")
def word_error_rate(spark, d):
    return M.error_rates(D(spark, d).withColumn("hyp", F.replace("raw_text", F.lit("o"), F.lit("0"))), ref="raw_text").select("doc_id", "wer", "thai_cer")


@query("align_lines", with_(more=f"al as (select doc_id, {lines('raw_text')} as l from docs)") +
       "select doc_id, len(l) as lines, greatest(len(l) - 1, 0) as paired, least(len(l), 1) as lost, 0 as added, coalesce(length(l[case when len(l) > 0 then doc_id % len(l) + 1 end]), 0) as char_errors from al")
def align_lines(spark, d):
    """Every document against a copy that lost one line: nothing else is shifted."""
    df = D(spark, d).withColumn("l", P.lines_of(F.col("raw_text"))).withColumn("at", F.when(F.size("l") > 0, F.col("doc_id") % F.size("l")))
    rest = F.filter("l", lambda x, i: i != F.col("at"))
    return M.line_report(df.withColumn("hyp", F.array_join(rest, "\n")), ref="raw_text")


_IPS = every("raw_text", Q.TOKEN_CLASSES["ip"][0])


@query("token_accuracy", with_("tickets", more=f"tk as (select doc_id, {_IPS} as e, replace(raw_text, '7 VLAN', '1 VLAN') as h from tickets)") + "select doc_id, case when len(e) > 0 then floor(len(list_filter(e, lambda t: contains(h, t))) / len(e) * 1000 + 0.5) / 10 end as ip from tk")
def token_accuracy(spark, d):
    t = S.rendered(spark, d, "tickets").withColumn("h", F.replace("raw_text", F.lit("7 VLAN"), F.lit("1 VLAN")))
    return t.select("doc_id", Q.token_accuracy(F.col("raw_text"), F.col("h"), *Q.TOKEN_CLASSES["ip"]).alias("ip"))


_CHK = " union all ".join(f"select doc_id, {lit(n)} as name, {num('raw_text', p)} as count from src" for n, p in ((n, p.replace("(?=", "(?:")) for n, p in Q.CHECKS["review"]))


@query("suspicious_tokens", with_("thai_notes", more="src as (select doc_id, raw_text from thai_notes union all select -doc_id - 1, raw_text from docs)") + f"select * from ({_CHK}) where count > 0")
def suspicious_tokens(spark, d):
    both = S.rendered(spark, d, "thai_notes").select("doc_id", "raw_text").unionAll(D(spark, d).select((-F.col("doc_id") - 1).alias("doc_id"), "raw_text"))
    return A.suspicious_rows(both).select("doc_id", "name", "count")


@query("spell_report")
def spell_report(spark, d):
    return A.spell_report(S.rendered(spark, d, "thai_notes"))


# 'e' read as '3x': two edits each, and of the letters only these are not shared.
_E = "(length(a) - length(replace(a, 'e', '')))"


@query("similarity", with_(more=line_rows() + f", ps as (select doc_id, line_no, lower({squeeze('line')}) as a from ls)") + f"select doc_id, line_no, floor((1 - 2e0 * {_E} / (length(a) + {_E})) * 10000 + 0.5) as s from ps where a <> ''")
def similarity(spark, d):
    df = T.split_lines(D(spark, d)).select("doc_id", "line_no", F.lower(P.squeeze(F.col("line"))).alias("a")).where(F.col("a") != "")
    return df.select("doc_id", "line_no", F.floor(Q.similarity(F.col("a"), F.replace("a", F.lit("e"), F.lit("3x"))) * 10000 + F.lit(0.5)).alias("s"))


@query("overlap_similarity", with_(more=line_rows() + f", ps as (select doc_id, line_no, lower({bare('line')}) as a from ls)") + f"select doc_id, line_no, case when a = '' then 0e0 else round((length(a) - {_E}) / cast(length(a) + {_E} as double), 6) end as s from ps")
def overlap_similarity(spark, d):
    df = T.split_lines(D(spark, d)).select("doc_id", "line_no", F.lower("line").alias("a"))
    return df.select("doc_id", "line_no", F.round(Q.overlap_similarity(F.col("a"), F.replace("a", F.lit("e"), F.lit("3x"))), 6).alias("s"))


@query("page_accuracy_report")
def page_accuracy_report(spark, d):
    pages = S.doc_pages(spark, d).selectExpr("doc_id", "page_no", "'ocr' as method", "ocr_confidence as confidence", "page_text as raw_text", "ocr_text as cleaned_text")
    return PG.page_accuracy_report(pages).select("doc_id", "page_no", "source_kind", "fields", "field_issues", "suspicious", "symbol_score", "review_required")


@query("final_confidence", with_("image_metrics") + "select doc_id, floor(greatest(0, least(100, avg / 3 * 0.35e0 + contrast * 0.20e0 + blur * 0.25e0 + contrast * 0.10e0 + blur * 0.10e0 - least(18e0, (doc_id % 30) * 0.8e0) - (doc_id % 3) * 4 + case when doc_id % 5 = 0 then 4 else 0 end)) * 10 + 0.5) / 10 as confidence from image_metrics")
def final_confidence(spark, d):
    i = F.col("doc_id")
    c = Q.final_confidence(F.col("avg") / 3, F.col("contrast"), F.col("blur"), F.col("blur"), F.col("contrast"), i % 30, i % 3, i % 5 == 0)
    return S.rendered(spark, d, "image_metrics").select("doc_id", c.alias("confidence"))


# --- matching ------------------------------------------------------------------------------

_KEY = f"replace({bare('lower(x)')}, '|', '')"
CLINES = f"cl as (select doc_id, engine_id, confidence, unnest(l) as x, generate_subscripts(l, 1) as line_no from (select doc_id, engine_id, confidence, {lines('text')} as l from cand))"
CL = with_(more=f"cand as ({S.CANDIDATES_SQL}), {CLINES}")


@query("align_candidates", CL + "select doc_id, line_no, " + ", ".join(f"coalesce(max(x) filter (engine_id = 'ocr-{k}'), '') as ocr_{k}" for k in range(1, 6)) + " from cl group by doc_id, line_no")
def align_candidates(spark, d):
    a = V.align_candidates(S.candidates(spark, d))
    return a.select("doc_id", "line_no", *[F.get("r", F.lit(k - 1))["text"].alias(f"ocr_{k}") for k in range(1, 6)])


@query("majority_line", CL + f""", ky as (select *, {_KEY} as k from cl), vt as (select *, count(*) over (partition by doc_id, line_no, k) as n from ky),
    mj as (select doc_id, line_no, min_by(x, engine_id) as decision, max(n) as votes from vt where n >= 3 and k <> '' group by doc_id, line_no)
    select doc_id, line_no, decision, 'Majority vote ' || cast(votes as varchar) || '/5' as reason, least(99, 86 + votes * 2) as confidence from mj""")
def majority_line(spark, d):
    """Lines with a majority; the scored fallback is covered by ``majority_line_all``."""
    out = V.majority_line(V.align_candidates(S.candidates(spark, d)))
    return out.where(F.col("reason").startswith("Majority")).select("doc_id", "line_no", "decision", "reason", "confidence")


@query("majority_line_all")
def majority_line_all(spark, d):
    return V.majority_line(V.align_candidates(S.candidates(spark, d))).select("doc_id", "line_no", "decision", "reason", "confidence")


PAIRS = f"""lf as (select doc_id as pair_id, unnest(l) as line, generate_subscripts(l, 1) as line_no from (select doc_id, {lines('raw_text')} as l from docs)),
    rg as (select doc_id as pair_id, unnest(l) as line, generate_subscripts(l, 1) as line_no from (select doc_id, {lines(rep('raw_text', 'the ', 'tne '))} as l from docs))"""


@query("diff_lines", with_(more=PAIRS + """, ol as (select pair_id, 'left' as side, line_no, line from lf anti join rg using (pair_id, line)), orr as (select pair_id, 'right' as side, line_no, line from rg anti join lf using (pair_id, line)),
    u as (select *, row_number() over (partition by pair_id, side order by line_no) as rn from (select * from ol union all select * from orr))""") + "select pair_id, side, line_no, line from u")
def diff_lines(spark, d):
    def side(text):
        rows = T.split_lines(D(spark, d).withColumn("raw_text", text))
        return rows.select(F.col("doc_id").alias("pair_id"), F.lit(1).alias("page_no"), "line_no", "line")

    left, right = side(F.col("raw_text")), side(F.replace("raw_text", F.lit("the "), F.lit("tne ")))
    return M.diff_lines(left, right).select("pair_id", "side", "line_no", "line")


_EW = f"ew as (select doc_id, engine_id, status, list_distinct(list_transform({words('text')}, lambda w: lower(w))) as w from cand)"


@query("engine_agreement", with_(more=f"cand as ({S.CANDIDATES_SQL}), {_EW}") + """select a.doc_id, a.engine_id, case when len(a.w) = 0 or count(b.w) = 0 then 0 else cast((200 * sum(len(list_intersect(a.w, b.w))) + len(a.w) * count(b.w)) // (2 * len(a.w) * count(b.w)) as bigint) end as agreement
    from ew a left join ew b on a.doc_id = b.doc_id and a.engine_id <> b.engine_id and b.status = 'success' group by a.doc_id, a.engine_id, a.w""")
def engine_agreement(spark, d):
    return V.engine_agreement(S.candidates(spark, d))


_PW = "pw as (select distinct lower(w) as d from (select unnest(string_split(p_name, ' ')) as w from part)), ww as (select distinct replace(replace(d, 'i', '1'), 'ge', 'g') as w from pw union select distinct p_type from part union select d from pw)"


@query("dictionary_match", f"with {_PW}, w2 as (select distinct lower(w) as word from ww) select word, coalesce(max(case when word = d then 100 when contains(d, word) or contains(word, d) then 65 else 0 end), 0) as score, max(case when word = d then 1.0 else 1 - cast(levenshtein(word, d) as double) / greatest(length(word), length(d)) end) filter (1 - cast(levenshtein(word, d) as double) / greatest(length(word), length(d)) > 0.72) as similarity from w2, pw group by word")
def dictionary_match(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    names = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    bent = names.select(F.replace(F.replace("word", F.lit("i"), F.lit("1")), F.lit("ge"), F.lit("g")).alias("word"))
    seen = bent.unionAll(part.select(F.col("p_type").alias("word"))).unionAll(names)
    return M.dictionary_match(seen, names).select("word", "score", "similarity")


@query("learn_corrections")
def learn_corrections(spark, d):
    """Corrections not yet in the table of saved ones."""
    return M.learn_corrections(S.rendered(spark, d, "edits"), known=saved_corrections(spark, d))


@query("neighbour_vote")
def neighbour_vote(spark, d):
    return V.neighbour_vote(S.candidates(spark, d).withColumn("score", F.col("confidence")))


_DICTIONARY = U.dictionary_rules()


@query("rule_hits", DOCS + "select * from (" + " union all ".join(f"select doc_id, {i} as rule_no, {num('raw_text', sql_rule(r)[0], r.flags)} as hits from docs" for i, r in enumerate(_DICTIONARY)) + ") where hits > 0")
def rule_hits(spark, d):
    return U.rule_hits(D(spark, d), "raw_text", _DICTIONARY)


@query("assemble_rows", with_(more=f"w as (select doc_id, unnest(w) as s, generate_subscripts(w, 1) - 1 as pos from (select doc_id, {words('raw_text')} as w from docs))") + "select doc_id, pos // 6 + 1 as row_no, string_agg(s, ' ' order by pos) as line from w group by all")
def assemble_rows(spark, d):
    return M.assemble_rows(S.text_items(spark, d))


@query("diff_words")
def diff_words(spark, d):
    out = V.diff_words(V.majority_line(V.align_candidates(S.candidates(spark, d))))
    return out.select("doc_id", "line_no", "engine", "matched", F.array_join("differing", " ").alias("differing"))


# --- roll-ups ------------------------------------------------------------------------------


@query("fix_summary")
def fix_summary(spark, d):
    done = U.apply_rules(S.rendered(spark, d, "thai_notes"), fixed.rules("exact") + fixed.rules("wrong_words"), "raw_text")
    return A.fix_summary(done.withColumn("fixes", U.typed_fixes(F.col("fixes"))))


@query("entity_report", with_("tickets", more=f"e as ({_entity_sql('docs')} union all {_entity_sql('tickets')})") + "select type, count(*) as n from e group by type")
def entity_report(spark, d):
    return FD.entity_report(FD.entity_rows(S.rendered(spark, d, "docs")).unionAll(FD.entity_rows(S.rendered(spark, d, "tickets"))))


@query("confidence_rollup", with_(more=line_rows() + ", en as (select doc_id, (line_no - 1) // 20 + 1 as page_no, 30 + (line_no * 13 + doc_id * 7) % 70 as c from ls), pg as (select doc_id, page_no, floor(avg(c) * 100 + 0.5) / 100 as pc from en group by all)") +
       "select doc_id, floor(avg(pc) * 100 + 0.5) / 100 as confidence, count(*) as pages from pg group by doc_id")
def confidence_rollup(spark, d):
    return V.confidence_rollup(S.engine_lines(spark, d))


@query("engine_rollup", CAND + f""", ww as (select doc_id, engine_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, engine_id, {words('text')} as w from cand))
    select doc_id, engine_id, cast(floor(avg(40 + (pos * 7 + doc_id * 3) % 60) + 0.5) as int) as confidence, count(*) as words from ww group by all""")
def engine_rollup(spark, d):
    return V.engine_rollup(S.engine_words(spark, d))


@query("issue_counts", CL + f", ky as (select doc_id, line_no, count(distinct nullif({_KEY}, '')) as nk from cl group by all), ln as (select doc_id, sum(cast(nk > 1 as int)) as mismatches, count(*) as n_lines from ky group by doc_id) select doc_id, coalesce(mismatches, 0) as mismatches, coalesce(n_lines, 0) as n_lines, failed from (select doc_id, count(*) filter (status = 'failed') as failed from cand group by doc_id) left join ln using (doc_id)")
def issue_counts(spark, d):
    c = S.candidates(spark, d)
    return V.issue_counts(V.align_candidates(c), c).select("doc_id", "mismatches", "n_lines", "failed")


@query("sample_summary", with_("samples") + "select engine, count(*) as samples, arg_max(layout_type, (created_at, id)) as last_layout, floor(avg(nullif(quality_score, 0)) + 0.5) as avg_quality from samples group by engine")
def sample_summary(spark, d):
    return A.sample_summary(S.rendered(spark, d, "samples"))


# Every known word and every word of the part names.
_WORDS = "vw as (select unnest([" + ", ".join(lit(w) for w in fixed.correct_words()) + "]) as word union select unnest(string_split(p_name, ' ')) from part)"


@query("vocabulary_counts", with_(more=_WORDS) + "select word, cast(sum((length(t) - length(replace(t, lower(word), ''))) / length(word)) as bigint) as n from vw, (select lower(raw_text) as t from docs) where word <> '' group by word having n > 0")
def vocabulary_counts(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word"))
    return A.vocabulary_counts(D(spark, d), spark.createDataFrame([(w,) for w in fixed.correct_words()], "word string").union(names))


@query("benchmark_summary", with_("samples") + "select engine, count(*) as runs, floor(avg(quality_score) * 10 + 0.5) / 10 as quality_score, floor(avg(id % 30) * 10 + 0.5) / 10 as cer, floor(avg(id % 50) * 10 + 0.5) / 10 as wer from samples group by engine")
def benchmark_summary(spark, d):
    return A.benchmark_summary(S.rendered(spark, d, "samples").withColumn("cer", F.col("id") % 30).withColumn("wer", F.col("id") % 50))


# --- ranking -------------------------------------------------------------------------------


@query("rank_engines")
def rank_engines(spark, d):
    """Readings with a second attempt, which two of three have not improved."""
    retried = S.candidates(spark, d).withColumns({"retry_before": F.lit(55), "retry_after": F.expr("case when doc_id % 3 = 0 then 60 when doc_id % 3 = 1 then 50 end")})
    ranked = V.rank_engines(V.score_readings(retried))
    return ranked.select("doc_id", "engine_id", "agreement", F.round("logic", 3).alias("logic"), "completeness", "rank_score", "rank", "is_best")


@query("top_candidates", CAND + f"select doc_id, engine_id, rank from (select doc_id, engine_id, row_number() over (partition by doc_id order by confidence desc, engine_id) as rank from cand where {trim('text')} <> '') where rank <= 4")
def top_candidates(spark, d):
    return V.top_candidates(S.candidates(spark, d), score="confidence").select("doc_id", "engine_id", "rank")


def known_words(spark, d):
    """A dictionary table: the fixed words and those of the part names."""
    names = spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word"))
    return spark.createDataFrame([(w,) for _, w in fixed.pairs("dictionary")], "word string").union(names)


def saved_corrections(spark, d):
    """Corrections as users would save them: each frequent word with an o, misread."""
    words = T.split_words(D(spark, d)).where(F.col("word").contains("o") & (F.length("word") >= 4)).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    return words.select(F.expr("xxhash64(word) & 4611686018427387903").alias("rule"), F.replace("word", F.lit("o"), F.lit("0")).alias("wrong"), F.col("word").alias("correct"))


@query("cluster_vote")
def cluster_vote(spark, d):
    out = V.cluster_vote(V.align_candidates(S.candidates(spark, d), squeeze=True), known_words(spark, d))
    return out.select("doc_id", "line_no", "conflict", "selected", F.round("confidence", 3).alias("confidence"), "votes", "resolved")


@query("low_confidence_top_n", CAND + f""", ww as (select doc_id, engine_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, engine_id, {words('text')} as w from cand)), cf as (select *, 40 + (pos * 7 + doc_id * 3) % 60 as confidence from ww)
    select doc_id, engine_id, pos, word, confidence, rank from (select *, row_number() over (partition by doc_id, engine_id order by confidence, pos) as rank from cf where confidence < 70 or {hit('word', '[�|{}<>~`_^]')}) where rank <= 12""")
def low_confidence_top_n(spark, d):
    return V.low_confidence_words(S.engine_word_lists(spark, d)).select("doc_id", "engine_id", "pos", "word", "confidence", "rank")


@query("low_confidence_line_words", with_(more=line_rows() + f", en as (select *, 30 + (line_no * 13 + doc_id * 7) % 70 as c from ls), ww as (select doc_id, line_no, unnest(w) as word, generate_subscripts(w, 1) as p from (select doc_id, line_no, {words('line')} as w from en where c < 70))") +
       "select doc_id, line_no, word, rank from (select *, row_number() over (partition by doc_id order by line_no, p) as rank from ww)")
def low_confidence_line_words(spark, d):
    return V.low_confidence_line_words(S.engine_lines(spark, d)).select("doc_id", "line_no", "word", "rank")


@query("dedupe_keep_first", with_(more=line_rows()) + f"select doc_id, min(line_no) as line_no, arg_min(line, line_no) as line from ls group by doc_id, lower({bare('line')})")
def dedupe_keep_first(spark, d):
    return L.dedupe_keep_first(T.split_lines(D(spark, d)))


@query("head_tail_lines", DOCS + f"select doc_id, array_to_string(list_slice(l, 1, 5), '|') as head, array_to_string(list_slice(l, greatest(1, len(l) - 4), len(l)), '|') as tail from (select doc_id, {lines('raw_text')} as l from docs)")
def head_tail_lines(spark, d):
    head, tail = L.head_tail_lines(F.col("raw_text"))
    return D(spark, d).select("doc_id", F.array_join(head, "|").alias("head"), F.array_join(tail, "|").alias("tail"))


@query("review_queue")
def review_queue(spark, d):
    voted = V.cluster_vote(V.align_candidates(S.candidates(spark, d), squeeze=True))
    issues = FD.field_issues(FD.entity_rows(S.rendered(spark, d, "tickets"))).select("doc_id", F.lit("field").alias("kind"), F.col("value").alias("item"), F.col("issue").alias("reason"))
    memos = G.government_review(S.rendered(spark, d, "memos")).select((-F.col("doc_id") - 1).alias("doc_id"), "review")
    return A.review_queue(voted, issues, reviews=memos)


# --- retention and jobs --------------------------------------------------------------------


@query("expire_results", with_("samples") + "select id, created_at from samples where created_at > (select max(created_at) from samples) - interval 600 minutes")
def expire_results(spark, d):
    s = S.rendered(spark, d, "samples").select("id", "created_at")
    return X.expire_results(s, "created_at", 600, s.agg(F.max("created_at")).scalar())


@query("stream_quality", with_("samples") + "select time_bucket(interval '1 hour', created_at) as window_start, engine, count(*) as samples, cast((20 * sum(cast(cast(nullif(quality_score, 0) as decimal(18,2)) * 100 as bigint)) + count(nullif(quality_score, 0))) // (2 * count(nullif(quality_score, 0))) as bigint) as avg_quality from samples group by all")
def stream_quality(spark, d):
    out = quality_windows(S.rendered(spark, d, "samples"))
    thousandths = F.expr("if(scored > 0, (20 * cents + scored) div (2 * scored), null)")
    return out.select("window_start", "engine", "samples", thousandths.alias("avg_quality"))


# Samples arrive in four deliveries by time; every fiftieth comes last of all.
_ARRIVALS = """m as (select min(epoch_us(created_at)) as lo, max(epoch_us(created_at)) + 1 as hi, max(epoch_us(created_at)) filter (id % 50 <> 0) as ontime from samples),
    ar as (select s.*, epoch_us(created_at) as us, case when id % 50 = 0 then 4 else (epoch_us(created_at) - lo) * 4 // (hi - lo) end as part, ontime, hi - 1 as newest from samples s, m)"""


def _arrivals(spark, d):
    rows = S.rendered(spark, d, "samples").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = rows.withColumn("us", F.unix_micros("created_at"))
    ends = rows.agg(F.min("us").alias("lo"), (F.max("us") + 1).alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn("part", F.expr("cast(case when id % 50 = 0 then 4 else (us - lo) * 4 div (hi - lo) end as int)")).drop("lo", "hi", "us")


@query("quality_stream", with_("samples", more=_ARRIVALS + """, ev as (select *, time_bucket(interval '1 hour', created_at) as w, id % 50 = 0 and epoch_us(time_bucket(interval '1 hour', created_at)) + 3600000000 <= ontime - 600000000 as late,
    cast(cast(nullif(quality_score, 0) as decimal(18,2)) * 100 as bigint) as c from ar)""") + """select w as window_start, engine, count(*) filter (not late) as samples, sum(c) filter (not late) as cents, count(*) filter (late) as late from ev
    where epoch_us(w) + 3600000000 <= newest - 600000000 group by w, engine having count(*) filter (not late) > 0""")
def quality_stream(spark, d):
    """A real stream over ordered deliveries with a watermark: closed windows, and the rows that came too late for them."""
    rows, folder = _arrivals(spark, d), scratch(spark, "quality")
    ST.replay(rows, "part", 5, f"{folder}/in", lambda stream, i: ST.quality_stream(stream, f"{folder}/out", f"{folder}/state"))
    closed = spark.read.parquet(f"{folder}/out")
    return ST.late_rows(rows, closed).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "engine", "samples", "cents", "late")


@query("retention_stream", with_("samples", more=_ARRIVALS + ", al as (select distinct engine || '/' || layout_type as owner, id, us from ar where us // 1000 + 7200 * 60000 > (newest - 600000000) // 1000)") +
       "select owner, cast(row_number() over (partition by owner order by us desc, id desc) as int) as rank, id, make_timestamp(us) as created_at from al qualify row_number() over (partition by owner order by us desc, id desc) <= 7")
def retention_stream(spark, d):
    """The newest seven rows of each owner as the state of a stream; every third row is delivered twice, and rows end after five days."""
    rows, folder = _arrivals(spark, d), scratch(spark, "retention")
    again = rows.where("id % 3 = 0 and part < 4").withColumn("part", F.col("part") + 1)
    rows = rows.unionByName(again).withColumn("owner", F.concat("engine", F.lit("/"), "layout_type")).select("owner", "id", "created_at", "part")
    ST.replay(rows, "part", 5, f"{folder}/in", lambda stream, i: ST.retention_stream(stream, f"{folder}/out", f"{folder}/state", i, 7, 7200))
    return ST.newest_state(spark, f"{folder}/out").select("owner", "rank", "id", F.timestamp_micros("at").cast("timestamp_ntz").alias("created_at"))


@query("clean_stream", with_() + f"select doc_id, case when {trim('raw_text')} = '' then 0 else 1 end as results, case when {trim('raw_text')} = '' then 1 else 0 end as rejected, 0 as missing_fixes from docs")
def clean_stream(spark, d):
    """Cleaning as a stream with three sinks over two deliveries; counts of each document's rows in them."""
    docs, folder = D(spark, d).withColumn("part", F.expr("cast(pmod(doc_id, 2) as int)")), scratch(spark, "clean")
    ST.replay(docs, "part", 2, f"{folder}/in", lambda stream, i: ST.clean_to_sinks(stream, folder, f"{folder}/state"))
    done, fixes, rejected = (ST.read_sink(spark, folder, n) for n in ("results", "fixes", "rejected"))
    tally = done.select("doc_id", "n_fixes", F.lit(1).alias("results"), F.lit(0).alias("rejected")).unionByName(rejected.select("doc_id", F.lit(0).alias("n_fixes"), F.lit(0).alias("results"), F.lit(1).alias("rejected")))
    tally = tally.groupBy("doc_id").agg(F.sum("results").alias("results"), F.sum("rejected").alias("rejected"), F.sum("n_fixes").alias("wanted"))
    found = fixes.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n"))
    return tally.join(found, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "results", "rejected", (F.col("wanted") - F.coalesce("n", F.lit(0))).alias("missing_fixes"))


@query("choose_page_source")
def choose_page_source(spark, d):
    return PG.choose_page_source(S.doc_pages(spark, d)).select("doc_id", "page_no", "method", "confidence", "raw_text")


@query("government_review")
def government_review(spark, d):
    out = G.government_review(S.rendered(spark, d, "memos"))
    return out.select("doc_id", "document_type", "clean_text", "confidence", "found", F.size("corrections").alias("n_corrections"), F.size("review").alias("n_review"), "year_warning")


@query("consensus")
def consensus(spark, d):
    return G.consensus(S.candidates(spark, d))


@query("ensemble")
def ensemble(spark, d):
    return G.ensemble(S.candidates(spark, d), dictionary=known_words(spark, d), corrections=saved_corrections(spark, d)).select("doc_id", "document_type", "final_confidence", "vote_confidence", "conflicts", "resolved", "warnings", "final_text")


# Words on a grid of six columns, 80 apart, on pages of 20 lines: the spread of a document is that of its first line.
@query("position_columns", with_(more=f"it as (select doc_id, (generate_subscripts(w, 1) - 1) % 6 as c from (select doc_id, {words('raw_text')} as w from docs))") + "select doc_id, cast(max(c) * 80 as double) as x_spread, count(distinct c) as columns from it group by doc_id")
def position_columns(spark, d):
    """Columns of positioned items by the gaps between their beginnings."""
    return M.item_spread(S.text_items(spark, d))


@query("columns_layout", with_(more=f"""it as (select doc_id, {lines('raw_text')} as l, len({words('raw_text')}) as n from docs)""") + f"""select doc_id, case when {_n_lines(_TAB)} >= greatest(2, len(l) * 0.25) then 'table' when {_n_lines(_KV)} >= 3 then 'form/key-value'
    when n >= 6 and len(l) > 8 then 'columns' when len(l) > 4 and length(l[1]) < 90 and length(l[-1]) < 90 and {_n_lines(_PNO, 'i')} > 0 then 'header/footer/page-number' when len(l) > 8 then 'paragraphs' else 'plain' end as layout from it""")
def columns_layout(spark, d):
    """The layout of whole documents whose words have positions."""
    df = D(spark, d).join(M.item_spread(S.text_items(spark, d)), "doc_id", "left")
    return df.select("doc_id", K.page_layout(F.col("raw_text"), F.col("x_spread")).alias("layout"))


@query("paged_documents")
def paged_documents(spark, d):
    """Pages 1 to 3 and 5, the engine's text against the text layer on each, with positions on every page."""
    pages = S.doc_pages(spark, d)
    items = T.split_words(pages, "page_text", ("doc_id", "page_no")).selectExpr("doc_id", "page_no", "cast(((pos - 1) % 6) * 80 as double) as x")
    done = G.paged_documents(pages, "auto-all", spec="1-3,5", items=items)
    return done.select("doc_id", "page_no", "method", "confidence", "language", "layout", "columns", "char_count", "symbol_score", "review_required", "cleaned_text")


@query("run_log", "with it as (select item_id, cast(item_id as varchar) as id from benchmark), lg as (select 'first' as engine, id, 1 as run from it union all select 'second', id, 2 from it union all select 'first', id, 3 from it where item_id % 2 = 0), "
       "kp as (select * from lg qualify row_number() over (partition by engine order by run desc, id desc) <= 25) select engine, count(*) as runs, min(id) as least_id, max(id) as largest_id, max(run) as last_run from kp group by engine")
def run_log(spark, d):
    """Three runs appended to the log, which keeps 25 of each engine, and its summary."""
    items, root = spark.read.parquet(f"{d}/benchmark.parquet"), scratch(spark, "runs")
    texts = items.select("item_id", F.concat(F.lit("image "), "item_id").alias("name"), F.col("text").alias("truth"), F.replace("text", F.lit("o"), F.lit("0")).alias("raw"),
                         F.replace("text", F.lit("th"), F.lit("tn")).alias("enhanced"), (F.col("item_id") % 100).alias("quality_score"))
    for run, (engine, part) in enumerate([("first", texts), ("second", texts), ("first", texts.where("item_id % 2 = 0"))], 1):
        log = G.log_benchmark(part, root, engine, f"2024-01-01 00:00:0{run}", 25)
    seen = log.groupBy(F.col("engine").alias("_e")).agg(F.min("id").alias("least_id"), F.max("id").alias("largest_id"), F.max(F.second("created_at")).alias("last_run"))
    return A.benchmark_summary(log).join(seen, F.col("engine") == F.col("_e")).select("engine", "runs", "least_id", "largest_id", "last_run")


@query("benchmark_runs")
def benchmark_runs(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    df = items.select("item_id", F.col("text").alias("truth"), F.replace("text", F.lit("o"), F.lit("0")).alias("raw"), F.replace("text", F.lit("th"), F.lit("tn")).alias("enhanced"))
    return G.benchmark_runs(df).select("item_id", "raw_score", "final_score", "symbol_accuracy", "cer", "wer")


@query("accuracy_upgrade")
def accuracy_upgrade(spark, d):
    cleaned = D(spark, d).select("doc_id", F.col("raw_text").alias("cleaned_text"))
    return G.accuracy_upgrade(S.candidates(spark, d).withColumn("score", F.col("confidence")), cleaned).select("doc_id", "voted", "layout", "upgraded_text")


@query("batch_report")
def batch_report(spark, d):
    return G.batch_report(D(spark, d)).select("doc_id", "source", "cleaned_text", "n_fixes", "suspicious", "confidence", "level")
