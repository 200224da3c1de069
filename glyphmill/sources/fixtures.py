"""Business texts and engine readings rendered from the given tables.

Every rendering is row by row over its source table, so it grows with the data
and adds no grouping. ``SQL`` holds the expressions in the dialect shared with
the check engine; ``{dmy:x}`` stands for a dd/mm/yyyy date.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import lines_of, words_of
from .tables import load_documents, spread, split_words, task_count

TABLES = ("documents", "benchmark", "pages", "conversations", "labels", "events", "orders", "customer", "part")
WIDE = ("documents", "pages", "conversations", "orders", "events")

NL = "chr(10)"
SQL = {
    "docs": "select doc_id, replace(replace(coalesce(text, ''), chr(160), ' '), chr(13), '') as raw_text, lang, source from documents",
    "receipts": f"""select o_orderkey as doc_id, concat('STORE ', c_name, {NL}, 'Receipt: R-', cast(o_orderkey as string), {NL},
        'Date: ', {{dmy:o_orderdate}}, {NL}, 'Blue ring ', cast(o_orderkey % 4 + 1 as string), ' x ', cast(o_orderkey % 90 + 10 as string), '.50', {NL},
        'Total: ', cast(cast(o_totalprice as decimal(18,2)) as string)) as raw_text
        from orders join customer on o_custkey = c_custkey""",
    "invoices": f"""select o_orderkey as doc_id, concat('ACME Supplies', {NL}, 'Invoice: INV-', cast(o_orderkey as string), {NL},
        'Tax ID: ', lpad(cast(o_custkey as string), 13, '0'), {NL}, 'Date: ', {{dmy:o_orderdate}}, {NL},
        'Red widget 2 x ', cast(o_orderkey % 70 + 5 as string), '.25', {NL}, 'Grand total: ', cast(cast(o_totalprice as decimal(18,2)) as string)) as raw_text
        from orders""",
    "tickets": f"""select event_id as doc_id, concat('Ticket No: INC-', cast(event_id as string), {NL}, 'System: core-', cast(user_id % 5 as string), {NL},
        'Issue: link down on Gi0/', cast(event_id % 24 as string), {NL}, 'Severity: ', case when event_id % 3 = 0 then 'high' else 'low' end, {NL},
        'switch 10.', cast(user_id % 256 as string), '.', cast(event_id % 300 as string), '.7 VLAN ', cast(event_id % 90 as string), {NL},
        'Requester: user', cast(user_id as string), {NL}, 'Reported ', {{dmy:ts}}, ' 10:35') as raw_text
        from events""",
    "emails": f"""select conv_id * 100 + turn as doc_id, concat('From: user', cast(conv_id as string), '@mail.example.com', {NL}, 'To: desk@example.org', {NL},
        'Subject: Case ', cast(conv_id as string), '-', cast(turn as string), {NL}, 'Please see https://example.org/t/', cast(conv_id as string), {NL}, text) as raw_text
        from conversations""",
    "tables": f"""select p_partkey as doc_id, concat('name | brand | price', {NL}, p_name, ' | ', p_brand, ' | ', cast(cast(p_retailprice as decimal(18,2)) as string), {NL},
        p_type, ' | size | ', cast(p_size as string)) as raw_text from part""",
    "memos": f"""select o_orderkey as doc_id, concat('= % |', {NL}, 'กค ', cast(o_orderkey as string), '/12', {NL}, 'บันทึกข้อความ', {NL},
        'ส่วนราชการ กองเทคโนโลยีสารสนเทศ', {NL}, 'ที่ กค ', cast(o_orderkey as string), '/', cast(o_custkey as string), {NL}, 'วันที่ ', {{dmy:o_orderdate}}, {NL},
        'เรอง ขอเพิม Mac Address', {NL}, 'เรียน ผู้อำนวยการ', {NL}, 'ปีงบประมาณ 25', cast(o_orderkey % 40 + 40 as string), ' วันที่ 1 มกราคม 2569', {NL},
        'เจ้าหน้าที ตรวาจ เอกสารที แนบ โทร 02-555-', cast(o_orderkey % 9000 + 1000 as string), {NL}, '(นาย ก', cast(o_custkey as string), ')', {NL}, 'นิติกร') as raw_text
        from orders""",
    "network": f"""select event_id as doc_id, concat('Network Connection Details', {NL}, 'Ethernet adapter ', cast(user_id as string), {NL}, 'DHCP Enabled Yes', {NL},
        'IPv4 Address: 10 ', cast(user_id % 250 as string), ' ', cast(event_id % 250 as string), ' 7', {NL}, 'Subnet Mask: 255 , 255 , 0 , 0', {NL},
        'Default Gateway 10.0.0.', cast(event_id % 250 as string), {NL}, 'Lease Obtained ', {{dmy:ts}}, ' 08:00:00') as raw_text from events""",
    "devices": f"""select event_id as doc_id, concat('ขอ IP Address', {NL}, 'Brand: HP ', cast(user_id as string), {NL}, 'OS: Linux', {NL}, 'Serial NO: ',
        case when event_id % 4 = 0 then 'bad serial' else concat('SN-', cast(event_id + 10000 as string)) end, {NL}, 'Mac Address: ',
        case when event_id % 3 = 0 then '00:1A' else concat('00:1A:2B:3C:4D:', lpad(cast(event_id % 90 + 10 as string), 2, '0')) end,
        case when event_id % 2 = 0 then concat({NL}, 'b~ m:i QJ C9l') else '' end) as raw_text from events""",
    "thai_notes": f"""select o_orderkey as doc_id, concat('เรื อง เป้ าหมาย งา น ที่ ', translate(cast(o_orderkey as string), '0123456789', '๐๑๒๓๔๕๖๗๘๙'), {NL},
        'จานวนเงิน ', cast(cast(o_totalprice as decimal(18,2)) as string), ' บาท  ขอมูล', {NL}, 'เ ครื่อ ง ่ก ใ็ด แ็ข กํา', {NL}, 'Ticket N0 ๑๒-๓', {NL},
        'noc@example , go . th') as raw_text from orders""",
    "steps": f"""select event_id as doc_id, concat('Report ', cast(event_id as string), {NL}, '1. Check link', {NL}, 'ping 10.0.0.', cast(user_id as string), {NL},
        'Step 2 renew', {NL}, 'ipconfig /renew and set "Obtain address automatically"', {NL}, '3) Close case:', {NL}, 'done') as raw_text from events""",
    "budget": """select o_orderkey as doc_id, concat('วันที่ 1 มกราคม ', cast(2560 + o_orderkey % 10 as string), chr(10), 'ปีงบประมาณ ',
        cast(2558 + o_custkey % 14 as string)) as raw_text from orders""",
    "noisy": """select doc_id, concat(replace(replace(replace(raw_text, '. ', '.​  '), ' of ', ' “of” '), ' de ', ' │━ de '), chr(10), '● end', chr(10), '|||---', chr(10), 'x') as raw_text,
        lang, source from docs""",
    "image_metrics": """select event_id as doc_id, cast(500 + event_id % 1500 as int) as width, cast(600 + user_id * 7 % 900 as int) as height,
        cast(event_id % 256 as double) as avg, cast(event_id % 90 as double) as contrast, cast(user_id % 50 as double) as blur,
        (event_id % 100) / 100.0 as dark_ratio, (user_id % 100) / 100.0 as light_ratio, (event_id % 40) / 100.0 as border_dark, cast(event_id % 12 as double) as skew from events""",
    "samples": """select event_id as id, ts as created_at, event_type as layout_type, case when event_id % 9 = 0 then 0.0 else value end as quality_score,
        concat('engine-', cast(user_id % 4 as string)) as engine from events""",
    "edits": "select doc_id, replace(raw_text, 'o', '0') as raw, raw_text as edited from docs",
}


def dialect(name: str, engine: str) -> str:
    """SQL text of one rendering for ``spark`` or ``duckdb``."""
    fmt = "date_format({0}, 'dd/MM/yyyy')" if engine == "spark" else "strftime({0}, '%d/%m/%Y')"
    return re.sub(r"\{dmy:(\w+)\}", lambda m: fmt.format(m.group(1)), SQL[name])


def register(spark: SparkSession, folder: str) -> None:
    """Temporary views of the base tables and the ingested documents."""
    for t in TABLES:
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        (spread(df) if t in WIDE else df).createOrReplaceTempView(t)
    spark.sql(SQL["docs"]).createOrReplaceTempView("docs")


def rendered(spark: SparkSession, folder: str, name: str) -> DataFrame:
    register(spark, folder)
    df = spark.sql(dialect(name, "spark"))
    # A join leaves as many partitions as its rows need, which are small beside the work on their texts.
    return df.repartition(task_count(spark.read.parquet(f"{folder}/orders.parquet"))) if " join " in SQL[name] else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_documents(spark, f"{folder}/documents.parquet", keep=("lang", "source"))


# Misreads of the five simulated engines, as in ``CANDIDATES_SQL``.
_READINGS = """
    case when k = 4 and doc_id % 11 = 0 then ''
         when k = 2 and doc_id % 3 <> 0 then replace(raw_text, 'o', '0')
         when k = 3 and doc_id % 3 <> 1 then replace(raw_text, 'l', '1')
         when k = 4 then replace(raw_text, 'th', 'tn')
         when k = 5 then replace(raw_text, ' ', '  ')
         else raw_text end"""
_READING_COLS = f"""doc_id, concat('ocr-', cast(k as string)) as engine_id, {_READINGS} as text,
    cast(60 + (doc_id * 7 + k * 13) % 40 as int) as confidence,
    case when k = 4 and doc_id % 11 = 0 then 'failed' else 'success' end as status"""
CANDIDATES_SQL = f"select {_READING_COLS} from (select doc_id, raw_text, unnest([1, 2, 3, 4, 5]) as k from docs)"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Five engine readings per document."""
    five = documents(spark, folder).select("doc_id", "raw_text", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("k"))
    return five.selectExpr(*[c for c in _split_cols(_READING_COLS)])


def _split_cols(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [c.strip() for c in [*out, cur]]


def engine_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines with a page number and an engine confidence."""
    rows = documents(spark, folder).select("doc_id", F.posexplode(lines_of(F.col("raw_text"))).alias("pos", "text"))
    return rows.selectExpr("doc_id", "cast(floor(pos / 20) + 1 as int) as page_no", "cast(pos + 1 as int) as line_no", "text",
                           "cast(30 + ((pos + 1) * 13 + doc_id * 7) % 70 as double) as confidence")


def engine_words(spark: SparkSession, folder: str) -> DataFrame:
    words = split_words(candidates(spark, folder), "text", ("doc_id", "engine_id"))
    return words.withColumn("confidence", F.expr("cast(40 + (pos * 7 + doc_id * 3) % 60 as int)"))


def engine_word_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``engine_words``, those of a reading as one array."""
    lists = candidates(spark, folder).select("doc_id", "engine_id", words_of(F.col("text")).alias("words"))
    return lists.withColumn("words", F.expr("transform(words, (w, i) -> named_struct('pos', i + 1, 'word', w, 'confidence', cast(40 + ((i + 1) * 7 + doc_id * 3) % 60 as int)))"))


def doc_pages(spark: SparkSession, folder: str, size: int = 20) -> DataFrame:
    """Pages of ``size`` lines; the text layer is missing on every third page."""
    docs = documents(spark, folder).select("doc_id", "source", lines_of(F.col("raw_text")).alias("l"))
    pages = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.size("l") / size).cast("int"))),
                        lambda p: F.array_join(F.slice("l", (p - 1) * size + 1, F.lit(size)), "\n"))
    rows = docs.select("doc_id", "source", F.posexplode(pages).alias("pos", "text"))
    return rows.selectExpr("doc_id", "source", "cast(pos + 1 as int) as page_no", "text as page_text", "case when (pos + 1) % 3 = 0 then '' else text end as layer_text",
                           "replace(text, 'o', '0') as ocr_text", "cast(60 + (doc_id * 7 + (pos + 1) * 13) % 40 as int) as ocr_confidence")


def text_items(spark: SparkSession, folder: str) -> DataFrame:
    """Document words on a grid of six columns with one unit of vertical jitter."""
    words = split_words(documents(spark, folder), "raw_text")
    return words.selectExpr("doc_id", "cast(pos as long) as item_id", "cast(((pos - 1) % 6) * 80 as double) as x",
                            "cast(1000000 - floor((pos - 1) / 6) * 12 + ((pos - 1) % 3 - 1) as double) as y", "word as s")
