"""Engine payloads of any shape, walked as variants inside the row.

A payload is a result, a list of results, or lists of lists of them. A result is an object with parallel arrays of texts, scores and boxes,
perhaps under ``res`` or as a string of JSON, or a line of the older kind, [box, [text, score]]. Each level of nesting is one
expression over the array of nodes; what can be opened is opened, the rest is carried on, so the order of the payload is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import trim

POINTS = "array<array<double>>"
LEVELS = 8
LINE = f"struct<page_no:int,lang:string,line_no:int,text:string,score:double,bad:boolean,box:{POINTS}>"
# Key names of texts, scores and boxes; the first that isn't empty holds.
TEXTS, SCORES, BOXES = ("rec_texts", "texts"), ("rec_scores", "scores"), ("rec_polys", "dt_polys", "boxes")


def _get(v: str, path: str, kind: str) -> str:
    return f"try_variant_get({v}, '{path}', '{kind}')"


def _is(v: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({v}) like '{kind}', false)"


def _old_line(v: str) -> str:
    """A pair whose second part is a pair that begins with a string."""
    return f"(coalesce(size({_get(v, '$[1]', 'array<variant>')}) >= 2, false) and {_is(_get(v, '$[1][0]', 'variant'), 'STRING')})"


def _list(v: str, names) -> str:
    some = [f"case when size({_get(v, '$.' + n, 'array<variant>')}) > 0 then {_get(v, '$.' + n, 'array<variant>')} end" for n in names]
    return f"coalesce({', '.join(some)}, cast(array() as array<variant>))"


def _open(v: str) -> str:
    """The nodes in a node: of a list those inside, of a result under ``res`` or in a string that one, else itself."""
    return (f"case when {_old_line(v)} then array({v}) when {_is(v, 'ARRAY%')} then {_get(v, '$', 'array<variant>')} when {_is(v, 'STRING')} then array(try_parse_json({_get(v, '$', 'string')})) "
            f"when {_is(_get(v, '$.res', 'variant'), 'OBJECT%')} or {_is(_get(v, '$.res', 'variant'), 'ARRAY%')} then array({_get(v, '$.res', 'variant')}) else array({v}) end")


_RESULT = f"""transform({_list('v', TEXTS)}, (t, i) -> named_struct('page_no', coalesce({_get('v', '$.page_number', 'int')}, 1), 'lang', {_get('v', '$.lang', 'string')}, 'line_no', i + 1, 'text', coalesce({_get('t', '$', 'string')}, ''),
    'score', if(get({_list('v', SCORES)}, i) is null, 0e0, {_get(f"get({_list('v', SCORES)}, i)", '$', 'double')}), 'bad', get({_list('v', SCORES)}, i) is not null and {_get(f"get({_list('v', SCORES)}, i)", '$', 'double')} is null,
    'box', {_get(f"get({_list('v', BOXES)}, i)", '$', POINTS)}))"""
# A missing, null, false or empty score of an old line counts as 0.
_OLD_SCORE = f"if({_is(_get('v', '$[1][1]', 'variant'), 'VOID')} or {_get('v', '$[1][1]', 'string')} in ('', 'false'), 0e0, {_get('v', '$[1][1]', 'double')})"
_OLD = f"named_struct('page_no', 1, 'lang', cast(null as string), 'line_no', i + 1, 'text', {_get('v', '$[1][0]', 'string')}, 'score', {_OLD_SCORE}, 'bad', {_OLD_SCORE} is null, 'box', {_get('v', '$[0]', POINTS)})"


def parsed_payloads(df: DataFrame, payload: str, keys) -> DataFrame:
    """``keys``, the payload, ``lines`` (blank ones too) and a ``reason`` where there are none."""
    nodes = df.select(*keys, payload, F.try_parse_json(payload).alias("_v")).withColumn("_n", F.expr("array(_v)"))
    for _ in range(LEVELS):
        nodes = nodes.withColumn("_n", F.expr(f"flatten(transform(_n, v -> {_open('v')}))"))
    parts = nodes.withColumns({"_old": F.expr(f"filter(_n, v -> {_old_line('v')})"), "_new": F.expr(f"filter(_n, v -> {_is('v', 'OBJECT%')})"),
                               "_deep": F.expr(f"exists(_n, v -> {_is('v', 'ARRAY%')} and not {_old_line('v')})")})
    lines = F.expr(f"concat(flatten(transform(_new, v -> {_RESULT})), transform(_old, (v, i) -> {_OLD}))").cast(f"array<{LINE}>")
    parts = parts.select(*keys, payload, "_v", "_deep", lines.alias("lines"))
    lines = F.transform("lines", lambda x: x.withField("text", trim(x["text"])))
    some = F.exists("lines", lambda x: trim(x["text"]) != "")
    reason = F.when(F.col(payload).isNull(), "no payload").when(F.col("_v").isNull(), "not json").when(F.coalesce("_deep", F.lit(False)), "nested too deep").when(~F.coalesce(some, F.lit(False)), "no text")
    return parts.select(*keys, payload, F.coalesce(lines, F.array().cast(f"array<{LINE}>")).alias("lines"), reason.alias("reason"))
