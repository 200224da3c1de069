"""Registered queries: sources, exports, normalisation, views and line filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import predicates as R, text as P
from ..functions.extract import PROTECTED, clean_protected
from ..operators import clean as C, fields as FD, lexicon as LX, lines as L, rules as U
from ..sources import exports as X, fixtures as S, tables as T
from ..sources.staging import scratch
from .registry import bare, get, hit, line_rows, lines, lit, num, query, rep, squeeze, tally, trim, with_, words

D = S.documents
DOCS = with_()


def _lines(spark, d, name=None):
    return T.split_lines(S.rendered(spark, d, name) if name else D(spark, d))


# --- sources and exports -------------------------------------------------------------------


@query("load_documents", DOCS + "select doc_id, raw_text, lang, source, length(raw_text) as n from docs")
def load_documents(spark, d):
    return D(spark, d).withColumn("n", F.length("raw_text"))


# Payload shapes by document: parallel arrays, older key names, old lines, a result under res, a list of two results, old lines in two
# pages, one bad score, and every fiftieth no JSON at all.
_RAW = "((line_no * 7 + doc_id) % 100)"
_PAYLOAD_LINES = f"""pl as (select *, max(line_no) over (partition by doc_id) as m, doc_id % 7 as k, {_RAW} / (case when doc_id % 2 = 0 then 100e0 else 1e0 end) as s from ls where doc_id % 50 <> 0),
    kl as (select *, k = 4 and line_no > (m + 1) // 2 as second from pl where not (k = 6 and line_no = 1))"""


@query("ingest_engine_json", with_(more=line_rows() + ", " + _PAYLOAD_LINES) + f"""select doc_id, case when second then 2 else 1 end as page_no, line_no - case when second then (m + 1) // 2 else 0 end as line_no, line as text,
    floor((case when s <= 1 then s * 100 else s end) * 100 + 0.5) / 100 as confidence, case when k in (2, 5) then 'th' else 'en' end as language,
    case when contains(line, ':') and length(line) <= 90 then 'key_value' when {tally('line', '|')} >= 2 then 'table_row' else 'text' end as block_type from kl""")
def ingest_engine_json(spark, d):
    return T.ingest_engine_json(_payloads(spark, d)).select("doc_id", "page_no", "line_no", "text", "confidence", "language", "block_type")


@query("rejected_payloads", with_(more=line_rows()) + f"""select doc_id, cast(null as int) as line_no, 'not json' as reason from docs where doc_id % 50 = 0 union all
    select doc_id, null, 'no text' from (select doc_id, len({lines('raw_text')}) as n from docs) where doc_id % 50 <> 0 and n = 0 union all select doc_id, line_no, 'score is no number' from ls where doc_id % 50 <> 0 and doc_id % 7 = 6 and line_no = 1""")
def rejected_payloads(spark, d):
    return T.rejected_payloads(_payloads(spark, d)).select("doc_id", "line_no", "reason")


def _payloads(spark, d):
    docs = D(spark, d).withColumn("l", P.lines_of(F.col("raw_text"))).withColumn("k", F.col("doc_id") % 7)
    raw = lambda i: (i + 1) * 7 + F.col("doc_id")
    docs = docs.withColumn("s", F.transform("l", lambda x, i: F.when(F.col("doc_id") % 2 == 0, raw(i) % 100 / 100.0).otherwise((raw(i) % 100).cast("double"))))
    half = F.ceil(F.size("l") / 2).cast("int")
    part = lambda c, n: F.slice(c, 1, half) if n == 1 else F.slice(c, half + 1, F.size(c))
    result = lambda texts, scores, **more: F.struct(F.lit("EN").alias("lang"), texts, scores, *[v.alias(n) for n, v in more.items()])
    modern = result(F.col("l").alias("rec_texts"), F.col("s").alias("rec_scores"))
    older = result(F.col("l").alias("texts"), F.col("s").alias("scores"))
    bad = result(F.col("l").alias("texts"), F.transform("s", lambda x, i: F.when(i == 0, "n/a").otherwise(x.cast("string"))).alias("scores"))
    pages = F.array(*[result(part("l", n).alias("rec_texts"), part("s", n).alias("rec_scores"), page_number=F.lit(n)) for n in (1, 2)])
    old = F.transform(F.arrays_zip(F.col("l").alias("t"), F.col("s").alias("s")), lambda z: F.concat(
        F.lit("[[[0.0,1.0],[2.0,3.0]],["), F.regexp_extract(F.to_json(F.struct(z["t"].alias("a"))), r"^\{\"a\":(.*)\}$", 1), F.lit(","), z["s"].cast("string"), F.lit("]]")))
    listed = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    shapes = [F.to_json(modern), F.to_json(older), listed(old), F.to_json(F.struct(modern.alias("res"))), F.to_json(pages), F.concat(F.lit("["), listed(part(old, 1)), F.lit(","), listed(part(old, 2)), F.lit("]")), F.to_json(bad)]
    payload = F.when(F.col("doc_id") % 50 == 0, "{no json")
    for k, shape in enumerate(shapes):
        payload = payload.when(F.col("k") == k, shape)
    return docs.select("doc_id", payload.alias("payload"))


@query("split_lines", with_(more=line_rows()) + "select doc_id, line_no, line from ls")
def split_lines(spark, d):
    return _lines(spark, d)


@query("split_words", DOCS + f"select doc_id, count(*) as n, count(distinct lower(word)) as n_distinct, sum(length(word) * pos) as checksum from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, {words('raw_text')} as w from docs)) group by doc_id")
def split_words(spark, d):
    w = T.split_words(D(spark, d))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct(F.lower("word")).alias("n_distinct"),
                                   F.sum(F.length("word") * F.col("pos")).alias("checksum"))


@query("export_lines_csv", DOCS + "select source as file, 'portrait' as orientation, unnest(s) as text, generate_subscripts(s, 1) as line from (select source, string_split(raw_text, chr(10)) as s from docs)")
def export_lines_csv(spark, d):
    path = scratch(spark, "csv")
    X.export_lines_csv(D(spark, d), path, text_col="raw_text")
    back = spark.read.schema("file string, orientation string, line int, text string").csv(path, header=True, quote='"', escape='"')
    return back.select("file", "orientation", "line", F.coalesce("text", F.lit("")).alias("text"))


@query("export_json", DOCS + "select doc_id, source, raw_text, len(string_split(raw_text, chr(10))) as n_lines from docs")
def export_json(spark, d):
    path = scratch(spark, "json")
    docs = D(spark, d).select("doc_id", "source", "raw_text", F.transform(F.split("raw_text", "\n"), lambda x, i: F.struct(
        (i + 1).alias("line"), x.alias("text"))).alias("lines"))
    X.export_json(docs, path)
    schema = "doc_id long, source string, raw_text string, lines array<struct<line:int,text:string>>"
    return spark.read.schema(schema).json(path).select("doc_id", "source", "raw_text", F.size("lines").alias("n_lines"))


def _numbered(cells: str, order: str) -> str:
    """SQL of all lines of ordered cells, numbered from 0."""
    return f"ex as (select unnest(string_split({cells}, chr(10))) as line, generate_subscripts(string_split({cells}, chr(10)), 1) as k, {order} from cells) select row_number() over (order by {order}, k) - 1 as line_no, line from ex"


@query("export_text_files", with_(more="cells as (select doc_id, '[file ' || cast(doc_id as varchar) || ': ' || source || ']' || chr(10) || raw_text || chr(10) as v from docs), " + _numbered("v", "doc_id")))
def export_text_files(spark, d):
    """Text blocks as ordered part files, read back line by line."""
    path = scratch(spark, "text")
    X.export_text_files(D(spark, d), path, parts=7, text_col="raw_text")
    return X.read_ordered(spark, path)


@query("export_text", DOCS + "select doc_id, '[file ' || cast(doc_id as varchar) || ': ' || source || ']' || chr(10) || raw_text as value from docs")
def export_text(spark, d):
    return X.text_blocks(D(spark, d), text_col="raw_text")


PAGES = f"""pg_a as (select doc_id, source, {lines('raw_text')} as l from docs),
    pg_b as (select doc_id, source, l, unnest(generate_series(1, greatest(1, cast(ceil(len(l) / 20.0) as bigint)))) as page_no from pg_a),
    pages_t as (select doc_id, source, page_no, array_to_string(list_slice(l, (page_no - 1) * 20 + 1, page_no * 20), chr(10)) as text from pg_b)"""


@query("export_page_rows", with_(more=PAGES) + """select source as file, page_no as page, 'ocr' as method, 60 + (doc_id * 7 + page_no * 13) % 40 as confidence,
    'en' as language, 'plain' as layout, text, line from (select *, unnest(string_split(text, chr(10))) as ln, generate_subscripts(string_split(text, chr(10)), 1) as line from pages_t) p(doc_id, source, page_no, whole, text, line) where trim(text) <> ''""")
def export_page_rows(spark, d):
    return X.page_rows(S.doc_pages(spark, d).selectExpr(
        "source", "page_no", "'ocr' as method", "ocr_confidence as confidence", "'en' as language", "'plain' as layout", "page_text as cleaned_text"))


@query("export_markdown_files", with_(more=PAGES + """, cells as (select doc_id, -1 as page_no, '# Pages' || chr(10) as v from (select distinct doc_id from pages_t) union all select doc_id, page_no, '## หน้า ' || cast(page_no as varchar) || chr(10) || chr(10) || '- Method: ocr' || chr(10) || '- Confidence: '
    || cast(60 + (doc_id * 7 + page_no * 13) % 40 as varchar) || '%' || chr(10) || '- Language: en' || chr(10) || '- Layout: -' || chr(10) || chr(10) || replace(text, 'o', '0') || chr(10) as v from pages_t), """ + _numbered("v", "doc_id, page_no")))
def export_markdown_files(spark, d):
    """Markdown pages as ordered part files, read back line by line."""
    path = scratch(spark, "markdown")
    X.export_markdown_files(S.doc_pages(spark, d).selectExpr("doc_id", "page_no", "'ocr' as method", "ocr_confidence as confidence", "'en' as language", "'' as layout", "ocr_text as cleaned_text"), path, parts=7)
    return X.read_ordered(spark, path)


@query("export_markdown", with_(more=PAGES) + """select doc_id, '# Pages' || chr(10) || chr(10) || string_agg('## หน้า ' || cast(page_no as varchar) || chr(10) || chr(10) || '- Method: ocr' || chr(10) || '- Confidence: '
    || cast(60 + (doc_id * 7 + page_no * 13) % 40 as varchar) || '%' || chr(10) || '- Language: en' || chr(10) || '- Layout: -' || chr(10) || chr(10) || replace(text, 'o', '0'), chr(10) || chr(10) order by page_no) as markdown
    from pages_t group by doc_id""")
def export_markdown(spark, d):
    return X.export_markdown(S.doc_pages(spark, d).selectExpr("doc_id", "page_no", "'ocr' as method", "ocr_confidence as confidence", "'en' as language",
                                                              "'' as layout", "ocr_text as cleaned_text"))


@query("append_log_keep_last_n", with_("samples") + """select engine, id, created_at from (select *, row_number() over (partition by engine order by created_at desc, id desc) as rn from samples) where rn <= 150""")
def append_log_keep_last_n(spark, d):
    s = S.rendered(spark, d, "samples")
    log, new = s.where(F.col("layout_type") != "error"), s.where(F.col("layout_type") == "error")
    return X.append_keep_last_n(log, new, ["engine"], "created_at", 150, "id").select("engine", "id", "created_at")


# --- projections ---------------------------------------------------------------------------

WSN = trim(rep(rep("replace(raw_text, '$1$2', '')", r"[ \t]+", " "), r"\n{3,}", "\n\n"))


@query("ws_normalize", DOCS + f"select doc_id, {WSN} as text from docs")
def ws_normalize(spark, d):
    return D(spark, d).select("doc_id", P.ws_normalize(F.col("raw_text")).alias("text"))


THAI_FOLD = "nfc_normalize(raw_text)"
for _r in fixed.rules("thai_spacing"):
    if "(?=" not in _r.pattern:
        THAI_FOLD = rep(THAI_FOLD, _r.pattern, _r.replacement.replace("$1", "\\1").replace("$2", "\\2"))
    else:
        THAI_FOLD = f"replace({THAI_FOLD}, 'ํา', 'า')"


@query("thai_normalize", with_("thai_notes") + f"select doc_id, {trim(THAI_FOLD)} as text from thai_notes union all select -doc_id - 1, {trim(THAI_FOLD)} from docs")
def thai_normalize(spark, d):
    notes = S.rendered(spark, d, "thai_notes").select("doc_id", "raw_text")
    both = notes.unionAll(D(spark, d).select((-F.col("doc_id") - 1).alias("doc_id"), "raw_text"))
    return both.withColumn("text", P.nfc(F.col("raw_text"))).select("doc_id", P.reattach(F.col("text")).alias("text"))


_GLYPHS = "[" + "".join(c for _, c in P.STRANGE).replace("️", "") + "️]"
_PLAIN = f"translate({rep('raw_text', _GLYPHS, '')}, '“”«»‘’', '\"\"\"\"''''')"
_RULED = rep(_PLAIN, P.BOX, " ")
_LINED = rep(_RULED, r"(^|\n)\s*[\[\]{}|/\\_=+\-–—.,'\"]{3,}\s*(\n|$)", "\\1\\2")


@query("strip_strange", with_("noisy") + f"""select doc_id, {rep(_LINED, '[ ' + chr(92) + 't]{2,}', ' ')} as text, {num('raw_text', '[' + P.STRANGE[1][1] + ']')} as zero_width,
    {num('raw_text', '[' + P.STRANGE[2][1] + ']')} as bullets, {num(_PLAIN, P.BOX)} as box_lines, {num(_LINED, '[ ' + chr(92) + 't]{2,}')} as space_runs from noisy""")
def strip_strange(spark, d):
    done = S.rendered(spark, d, "noisy").select("doc_id", P.strip_strange(F.col("raw_text")).alias("s"))
    n = lambda k: F.coalesce(F.col("s.removed")[k], F.lit(0)).alias
    return done.select("doc_id", "s.text", n("zero_width")("zero_width"), n("bullet")("bullets"), n("box_line")("box_lines"), n("space_run")("space_runs"))


@query("collapse_repeats")
def collapse_repeats(spark, d):
    return S.rendered(spark, d, "thai_notes").select("doc_id", P.collapse_repeats(
        F.col("raw_text"), lambda c: U.join_spaced_words(c, fixed.words("join"))).alias("text"))


@query("fold_thai_digits", with_("thai_notes") + "select doc_id, translate(raw_text, '๐๑๒๓๔๕๖๗๘๙', '0123456789') as text from thai_notes")
def fold_thai_digits(spark, d):
    return S.rendered(spark, d, "thai_notes").select("doc_id", P.fold_thai_digits(F.col("raw_text")).alias("text"))


def _folded(expr, name):
    for r in fixed.rules(name):
        expr = rep(expr, r.pattern, r.replacement.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3").replace("$4", "\\4"), r.flags)
    return expr


@query("repair_vowel_order", with_("thai_notes") + f"select doc_id, {_folded('raw_text', 'vowel_order')} as text from thai_notes")
def repair_vowel_order(spark, d):
    return S.rendered(spark, d, "thai_notes").select("doc_id", P.repair_vowel_order(F.col("raw_text")).alias("text"))


def _domains(expr, upto=None):
    """The lookahead-free domain rules; text after a word boundary is the same in both."""
    for r in fixed.rules("email_domains"):
        pattern = r.pattern.replace("(?=\\b|>)", "\\b")
        expr = rep(expr, pattern, r.replacement.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3"), r.flags)
    return _folded(expr, "vowel_order")


@query("repair_email_domain", with_("emails") + f"select doc_id, array_to_string({lines(_domains('raw_text'))}, chr(10)) as text from emails")
def repair_email_domain(spark, d):
    return S.rendered(spark, d, "emails").select("doc_id", P.repair_email_domain(F.col("raw_text")).alias("text"))


@query("normalize_network", with_("network") + f"select doc_id, {trim(_folded('raw_text', 'network'))} as text from network")
def normalize_network(spark, d):
    return S.rendered(spark, d, "network").select("doc_id", P.normalize_network(F.col("raw_text")).alias("text"))


@query("normalize_ip_like")
def normalize_ip_like(spark, d):
    return S.rendered(spark, d, "network").select("doc_id", P.normalize_ip_like(F.col("raw_text")).alias("text"))


DICTIONARY = U.dictionary_rules()


def sql_rule(r):
    """Pattern and replacement for the check engine, which has no lookahead: the letter behind is taken and put back."""
    pattern, put = r.pattern, r.replacement.replace("$1", "\\1")
    return (pattern.replace("(?!ิ)", "([^ิ]|$)"), put + "\\1") if "(?!ิ)" in pattern else (pattern, put)


def _fold_rules(expr):
    for r in DICTIONARY:
        expr = rep(expr, *sql_rule(r), r.flags)
    return expr


@query("apply_rules", DOCS + f"select doc_id, {_fold_rules('raw_text')} as text from docs")
def apply_rules(spark, d):
    return U.apply_rules(D(spark, d), DICTIONARY, "raw_text", "text").select("doc_id", "text")


@query("apply_rules_logged")
def apply_rules_logged(spark, d):
    notes = S.rendered(spark, d, "thai_notes")
    done = U.apply_rules(notes, fixed.rules("exact") + fixed.rules("dictionary") + fixed.rules("wrong_words"), "raw_text", "text")
    return done.select("doc_id", "text", F.size("fixes").alias("n_fixes"), F.to_json(U.typed_fixes(F.col("fixes"))).alias("fixes"))


# A rule for each customer; a receipt names one of them.
_CUSTOMERS = "cu as (select c_custkey as rule, 'STORE ' || c_name as wrong, 'SHOP ' || cast(c_custkey as varchar) as correct from customer)"


def _customer_rules(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet")
    return customers.select(F.col("c_custkey").alias("rule"), F.concat(F.lit("STORE "), "c_name").alias("wrong"), F.concat(F.lit("SHOP "), F.col("c_custkey").cast("string")).alias("correct"))


@query("apply_rule_table", with_("receipts", more=_CUSTOMERS) + "select doc_id, replace(raw_text, wrong, correct) as text, 1 as n_used from receipts join orders on doc_id = o_orderkey join cu on o_custkey = rule")
def apply_rule_table(spark, d):
    """Corrections that come as a table, over every receipt."""
    done = LX.apply_table(S.rendered(spark, d, "receipts"), _customer_rules(spark, d), "raw_text")
    return done.select("doc_id", "text", F.size("used").alias("n_used"))


@query("count_rule_use", with_(more=_CUSTOMERS) + "select rule, wrong, correct, count(o_orderkey) as used from cu left join orders on o_custkey = rule group by all")
def count_rule_use(spark, d):
    """The table of corrections with its uses."""
    rules = _customer_rules(spark, d)
    return LX.count_used(rules, LX.apply_table(S.rendered(spark, d, "receipts"), rules, "raw_text"))


JOIN = fixed.words("join")


def _join_sql(expr):
    for r in U.join_rules(JOIN):
        expr = rep(expr, r.pattern, r.replacement)
    return expr


@query("join_spaced_words", DOCS + f"select doc_id, {_join_sql('raw_text')} as text from docs")
def join_spaced_words(spark, d):
    return D(spark, d).select("doc_id", U.join_spaced_words(F.col("raw_text"), JOIN).alias("text"))


_SAFE = list(PROTECTED)
# The check engine can't look behind: the sign before a path is taken with it, which tells nothing apart in tickets.
_ALT = "|".join(f"(?{'i' if 'i' in f else '-i'}:{p})" for _, p, f in _SAFE).replace(r"""(?<![^\s(\[\"'])/""", r"""(?:^|[\s(\["'])/""")


@query("clean_protected", with_("tickets") + f"select doc_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: upper(a[i]) || coalesce(b[i], '')), '') as text, len(b) as n_spans from (select doc_id, regexp_split_to_array(raw_text, {lit(_ALT)}) as a, regexp_extract_all(raw_text, {lit(_ALT)}) as b from tickets)")
def clean_protected_(spark, d):
    """Upper-case everything but the protected spans of a ticket."""
    return S.rendered(spark, d, "tickets").select("doc_id", clean_protected(F.col("raw_text"), F.upper, _SAFE).alias("text"), F.size(
        F.regexp_extract_all("raw_text", F.lit(FD.E.alternation(_SAFE)), F.lit(0))).alias("n_spans"))


@query("clean_text_safe")
def clean_text_safe(spark, d):
    return C.clean_text(D(spark, d)).select("doc_id", "cleaned_text", F.size("fixes").alias("n_fixes"))


@query("clean_text_raw", DOCS + f"select doc_id, {WSN} as cleaned_text from docs")
def clean_text_raw(spark, d):
    return C.clean_text(D(spark, d), level="raw").select("doc_id", "cleaned_text")


@query("clean_text_strict")
def clean_text_strict(spark, d):
    return C.clean_text(S.rendered(spark, d, "thai_notes"), level="strict").select("doc_id", "cleaned_text", F.size("fixes").alias("n_fixes"))


@query("polish_government")
def polish_government(spark, d):
    return S.rendered(spark, d, "memos").select("doc_id", P.polish_government(F.col("raw_text")).alias("text"))


_LABEL = rep("line", rf"^({P.LABELS})\s+[:：]?\s*", "\\1: ", "i")
_LABEL = trim(rep(rep(_LABEL, r"\s*[:：]\s*", ": "), r"\s{2,}", " "))
_LABEL = rep(_LABEL, r"^Ticket No\.?:", "Ticket No.:", "i")


@query("normalize_labels", with_("tickets", more=line_rows("tickets")) + f"select doc_id, line_no, {_LABEL} as label from ls")
def normalize_labels(spark, d):
    return _lines(spark, d, "tickets").select("doc_id", "line_no", P.normalize_label(F.col("line")).alias("label"))


@query("to_key_value", with_("tickets", more=line_rows("tickets") + f", lb as (select doc_id, line_no, {_LABEL} as b from ls)") +
       f"select doc_id, line_no, case when contains(b, ':') then {trim(get('b', '^([^:]*):'))} end as key, case when contains(b, ':') then {trim(rep('b', '^[^:]*:', ''))} else b end as value from lb")
def to_key_value(spark, d):
    return L.to_key_value(_lines(spark, d, "tickets")).select("doc_id", "line_no", "key", "value")


_LBX = _LABEL.replace("line", "x")
_HEAD = rf"^({P.LABELS})\s*:"
_RANK = "case " + " ".join(f"when starts_with(lower(x), {lit(h.lower())}) then {i}" for i, h in enumerate(P.HEADER_ORDER)) + " else 99 end"


@query("to_email_view", with_("emails", more=f"lb as (select doc_id, list_transform({lines('raw_text')}, lambda x: {_LBX}) as l from emails), ex as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from lb)") +
       f"""select doc_id, {trim("coalesce(string_agg(x, chr(10) order by r, i) filter (h), '') || chr(10) || chr(10) || coalesce(string_agg(regexp_replace(x, '^[-•]\\s*', '- '), chr(10) order by i) filter (not h), '')")} as view from (select doc_id, x, i, {hit('x', _HEAD, 'i')} as h, {_RANK} as r from ex) group by doc_id""")
def to_email_view(spark, d):
    return S.rendered(spark, d, "emails").select("doc_id", L.email_view(F.col("raw_text")).alias("view"))


_TFIELD = rf"^({P.TICKET_LABELS})\s*:"


@query("to_ticket_view", with_("tickets", more=f"lb as (select doc_id, list_transform({lines('raw_text')}, lambda x: {_LBX}) as l from tickets), ex as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as i from lb)") +
       f"""select doc_id, {trim("coalesce('Ticket Info' || chr(10) || string_agg('- ' || x, chr(10) order by i) filter (h), '') || coalesce(chr(10) || chr(10) || 'Details' || chr(10) || string_agg('- ' || regexp_replace(x, '^[-•]\\s*', ''), chr(10) order by i) filter (not h), '')")} as view from (select doc_id, x, i, {hit('x', _TFIELD, 'i')} as h from ex) group by doc_id""")
def to_ticket_view(spark, d):
    return S.rendered(spark, d, "tickets").select("doc_id", L.ticket_view(F.col("raw_text")).alias("view"))


_CELLS = f"array_to_string(list_filter(list_transform(regexp_split_to_array(x, '\\s{{2,}}|\\t|,'), lambda y: {trim('y')}), lambda y: y <> ''), ' | ')"


@query("to_list_views", DOCS + f"""select doc_id, array_to_string({lines('raw_text')}, chr(10) || chr(10)) as document,
    array_to_string(list_transform({lines('raw_text')}, lambda x: '- ' || regexp_replace(x, '^[-•*]\\s*', '')), chr(10)) as bullets,
    array_to_string(list_transform({lines('raw_text')}, lambda x: '- [ ] ' || regexp_replace(x, '^[-•*]\\s*', '')), chr(10)) as checklist,
    array_to_string(list_transform({lines('raw_text')}, lambda x: '| ' || {_CELLS} || ' |'), chr(10)) as "table" from docs""")
def to_list_views(spark, d):
    return D(spark, d).select("doc_id", *[P.list_view(F.col("raw_text"), s).alias(s) for s in ("document", "bullets", "checklist", "table")])


@query("compact_blocks", with_(more=line_rows() + f""", fl as (select *, case when {hit('line', '^(' + P.BLOCK_LABELS + ')' + chr(92) + 's*:', 'i')} then 2 when length(line) < 42 then 1 else 0 end as kind from ls),
    st as (select *, case when kind > 0 or line_no = 1 or lag(kind) over (partition by doc_id order by line_no) = 2 then 1 else 0 end as starts from fl),
    bl as (select *, sum(starts) over (partition by doc_id order by line_no) as block from st),
    tx as (select doc_id, block, case when max(kind) = 2 then max({_LABEL}) else string_agg(line, ' ' order by line_no) end as t from bl group by doc_id, block)""") +
       "select doc_id, string_agg(t, chr(10) order by block) as text, count(*) as n_blocks from tx group by doc_id")
def compact_blocks(spark, d):
    out = D(spark, d).select("doc_id", L.compact_blocks(F.col("raw_text")).alias("text")).where(F.col("text") != "")
    return out.withColumn("n_blocks", F.size(F.split("text", "\n")))


@query("capture_list_layout")
def capture_list_layout(spark, d):
    return S.rendered(spark, d, "steps").select("doc_id", L.capture_list_layout(F.col("raw_text")).alias("text"))


@query("summary_lines", DOCS + f"select doc_id, array_to_string(list_transform(list_slice(list_filter({lines('raw_text')}, lambda x: length(x) > 8), 1, 12), lambda x: '- ' || x), chr(10)) as summary from docs")
def summary_lines(spark, d):
    return D(spark, d).select("doc_id", P.summary_lines(F.col("raw_text")).alias("summary"))


# --- filters -------------------------------------------------------------------------------


@query("text_usability", DOCS + f"select doc_id, {num('raw_text', '[A-Za-z0-9ก-ฮ]')} >= 12 as usable, {num('raw_text', '[A-Za-z0-9ก-ฮ]')} < 4 as blank_app, {num('raw_text', '[A-Za-z0-9ก-๙]')} < 3 as blank_service from docs")
def text_usability(spark, d):
    c = F.col("raw_text")
    return D(spark, d).select("doc_id", R.usable(c).alias("usable"), R.blank(c).alias("blank_app"), R.blank(c, 3, True).alias("blank_service"))


def run_pattern(n: int) -> str:
    """Backreference-free pattern of n equal characters in a row (letters and ASCII signs)."""
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789ßäçèéêíñóöüÄÇÈÉÊÍÑÓÖÜ"
    return "|".join(f"{c}{{{n},}}" for c in chars) + "".join(f"|\\{c}{{{n},}}" for c in "!#$%&()*+,-./:;=?@[]_{}|<>\"")


def runs(expr: str, n: int) -> str:
    return hit(expr, run_pattern(n))


_MARKS = r"[;:=\-_=~`!|Il0oO.\[\]{}()<>/\\]"
GARBAGE = (f"((length({bare('line')}) > 18 and ({runs(bare('line'), 11)} or {hit(bare('line'), '(กร|รร){8,}')})) or "
           + hit("line", rf"^{_MARKS}(?:\s*{_MARKS}){{3}}(?:{_MARKS}|\s)*$", "i") + " or "
           + hit("line", r"PERE|F——|oo\s*PERE|ซ่\s*Be|IRATE\s*--|=\s*=\s*=\s*F", "i") + ")")


@query("drop_garbage_lines", with_(more=line_rows()) + f"select doc_id, line_no, line, not {GARBAGE} as kept from ls")
def drop_garbage_lines(spark, d):
    return L.garbage_lines(_lines(spark, d))


_UI = rep(bare("line"), "[\"'“”‘’]", "")
UI = (f"({_UI} <> '' and ((length({_UI}) <= 24 and {hit(_UI, '(?:utv|vut|' + chr(92) + '[=|=11|=๑๑)', 'i')}) or {hit(_UI, '^(?:เม่|เม|แม่){2,}$', 'i')} or "
      f"{hit(_UI, '^=*[๐-๙0-9oOwW]{1,4}=*$', 'i')} or (length({_UI}) <= 12 and {hit(_UI, '^=[๐-๙0-9oOwW]+$', 'i')}) or "
      f"(length({_UI}) <= 18 and {hit(_UI, '^[vVdDutเอ' + chr(92) + '[' + chr(92) + ']=' + chr(92) + '-_,.01๑๒]+$')})))")


@query("drop_ui_garbage", with_(more=line_rows()) + f"select doc_id, line_no, not {UI} as kept from ls")
def drop_ui_garbage(spark, d):
    return L.ui_lines(_lines(spark, d)).select("doc_id", "line_no", "kept")


_SQ, _CB = squeeze("line"), bare("line")
BROKEN = (f"{num(_CB, r'[=©%|{}<>~`_^' + chr(92) * 2 + ']')} * 2 + case when {num(_CB, '[0๐oO]')} > 3 then 4 else 0 end + case when {num(_CB, '[A-Za-z]')} > {num(_CB, '[ก-ฮ]')} and {num(_CB, '[0-9๐-๙]')} > 2 "
          f"and not {hit(_SQ, R.KNOWN_GOOD, 'i')} then 4 else 0 end + case when {num(_CB, '[A-Za-zก-ฮ]')} < 4 and length({_CB}) > 6 then 3 else 0 end")


@query("drop_broken_lines", with_(more=line_rows() + f", sc as (select doc_id, line_no, line, {BROKEN} as score from ls)") +
       f"select doc_id, line_no, score, not (not {hit(_SQ, R.KNOWN_GOOD, 'i')} and (score >= 5 or {hit(_SQ, '^(a|al|ap|eof|n)' + chr(92) + 'b', 'i')} or {hit(_SQ, '^[-=©' + chr(92) + 's.0๐oOซ%]+$')})) as kept from sc")
def drop_broken_lines(spark, d):
    return L.broken_lines(_lines(spark, d)).select("doc_id", "line_no", "score", "kept")


@query("strict_noise_filter")
def strict_noise_filter(spark, d):
    return L.strict_noise_filter(D(spark, d)).select("doc_id", "line_no", "clean")


@query("strict_removed")
def strict_removed(spark, d):
    """How many lines of each document the strict review removed or changed."""
    return L.strict_review(D(spark, d)).select("doc_id", F.size("kept").alias("kept"), "removed")


_W = R.WEIRD_MARKS


def _any(expr, terms):
    return "(" + " or ".join(f"contains(lower({expr}), {lit(t.lower())})" for t in terms) + ")"


@query("strict_line_score", with_(more=line_rows() + f""", st as (select doc_id, line_no, {_SQ} as t, {_CB} as c from ls),
    ct as (select *, length(c) as n, {num('c', '[A-Za-zก-๙]')} as letters, {num('c', '[0-9๐-๙]')} as digits, {num('c', _W)} as weird, {num('c', '[0๐oO]')} as zeros,
    {_any('t', fixed.words('trusted'))} as trusted, {_any('t', fixed.words('commands'))} as command, {hit('t', R.HEADING, 'i')} as heading from st)""") +
       f"""select doc_id, line_no, floor(1000 * (least(35.0, n * 0.7) + letters * 1.3 + case when trusted then 42 else 0 end + case when command then 34 else 0 end + case when heading then 48 else 0 end
    + case when digits > 0 and letters > 0 then 6 else 0 end - weird * 13 - case when weird / n > 0.08 then 38 else 0 end - case when zeros / n > 0.30 and not command then 30 else 0 end
    - case when n < 4 then 22 else 0 end - case when letters / n < 0.42 and not command and not heading then 36 else 0 end - case when {runs('t', 5)} then 34 else 0 end
    - case when {hit('t', '^[0๐oO' + chr(92) + 's.,:;' + chr(92) + '-/]+$')} then 70 else 0 end) + 0.5) as score from ct""")
def strict_line_score(spark, d):
    rows = _lines(spark, d)
    stats = R.line_stats(F.col("line"))
    for n, v in stats.items():
        rows = rows.withColumn("s_" + n, v)
    score = R.strict_line_score({n: F.col("s_" + n) for n in stats})
    return rows.select("doc_id", "line_no", F.floor(score * 1000 + F.lit(0.5)).alias("score"))


@query("scrub_garbled_tokens", DOCS + f"select doc_id, {squeeze('raw_text')} as text from docs")
def scrub_garbled_tokens(spark, d):
    """Text without Thai letters holds no garbled token, so the check sees plain squeezing."""
    return D(spark, d).select("doc_id", R.scrub_garbled(F.col("raw_text")).alias("text"))


@query("scrub_garbled_thai")
def scrub_garbled_thai(spark, d):
    return S.rendered(spark, d, "memos").select("doc_id", R.scrub_garbled(F.col("raw_text")).alias("text"))


@query("drop_pre_header_noise", with_("memos", more=line_rows("memos")) + "select doc_id, line_no, line, case when line_no = 1 then 'noise' when line_no = 2 then 'review-code' else 'body' end as fate from ls")
def drop_pre_header_noise(spark, d):
    return L.pre_header_lines(S.rendered(spark, d, "memos"))


def _moji(variant):
    hits = " + ".join(f"cast({hit('raw_text', p.replace(chr(92) + 'v', chr(92) + 'x0B'), f)} as int)" for p, f in R.MOJIBAKE[variant])
    thai, clue = num("raw_text", "[ก-ฮ]{3,}"), hit("raw_text", R.ENCODING_CLUE, "i")
    if variant == "document":
        return f"({hits}) >= 3 and ({thai} < 8 or {clue})"
    noise = num("raw_text", "[A-Za-z~'`:]{2,}")
    return f"({hits}) >= 3 and ({thai} < 12 or {noise} > {thai} * 2 or {clue})"


@query("mojibake_flag", with_("devices") + f"select doc_id, {_moji('document')} as document, {_moji('engine')} as engine, case when {_moji('engine')} then 18 else 90 end as confidence from devices")
def mojibake_flag(spark, d):
    c = F.col("raw_text")
    df = S.rendered(spark, d, "devices").select("doc_id", R.mojibake(c).alias("document"), R.mojibake(c, "engine").alias("engine"))
    return df.withColumn("confidence", F.when(F.col("engine"), 18).otherwise(90))


@query("min_line_confidence", with_(more=line_rows() + ", en as (select *, 30 + (line_no * 13 + doc_id * 7) % 70 as conf from ls), kp as (select doc_id, count(*) as n, string_agg(line, chr(10) order by line_no) as t from en where conf >= 45 group by doc_id)") +
       f"select doc_id, coalesce(n, 0) as n_kept, case when coalesce(n, 0) >= 2 then t else {trim('raw_text')} end as text from docs left join kp using (doc_id)")
def min_line_confidence(spark, d):
    flat = D(spark, d).select("doc_id", F.col("raw_text").alias("text"))
    return L.min_line_confidence(S.engine_lines(spark, d), flat)


@query("page_range", with_(more=PAGES) + "select doc_id, page_no from pages_t where page_no between 1 and 2 or page_no = 4")
def page_range(spark, d):
    return T.page_range(S.doc_pages(spark, d), "1-2,4").select("doc_id", "page_no")


@query("page_numbers", """select l_orderkey, l_linenumber, l_quantity, case when l_linenumber % 3 = 0 then array_to_string(generate_series(1, 9), ',') when l_linenumber % 3 = 1
    then array_to_string(list_distinct_sorted, ',') else '' end as pages from (select l_orderkey, l_linenumber, l_quantity, list_filter(range(1, 10), lambda p: p between l_linenumber and l_linenumber + 2 or p = 1) as list_distinct_sorted from lineitem)""")
def page_numbers(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    spec = F.when(F.col("l_linenumber") % 3 == 0, "all").when(F.col("l_linenumber") % 3 == 1, F.concat(
        F.lit("1, "), F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_linenumber") + 2).cast("string"))).otherwise("12")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.array_join(T.page_numbers(spec, F.lit(9)), ",").alias("pages"))


@query("search_text", DOCS + f"select doc_id, {num('raw_text', 'tion.', 'i').replace('tion.', 'tion' + chr(92) + '.')} as hits from docs where contains(lower(raw_text), 'tion.')")
def search_text(spark, d):
    return L.search_text(D(spark, d), "tion.").select("doc_id", "hits")

