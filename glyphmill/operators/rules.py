"""Ordered rule tables: guarded replacement with a fix log, word joins, rule hits. All of it is column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..fixed import Rule
from ..functions.text import TONES, count, fold_set, has, let, sub, trim
from ..patterns import first_characters, java, quote, spaced

FIXES = "array<struct<from:string,to:string>>"
# Fixed values of the guard: a match of at most so many characters may grow by so many at most.
GROWTH = ((3, 1), (15, 8))
NUMBERS = r"^[๐-๙0-9.,:;\-_=+\s]+$"
LETTERS = "[ก-ฮA-Za-z]"
SPACES = r"\s"


def _lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _guard(found: str, put: str) -> str:
    """SQL of the guard: a change that grows a short match too far or turns digits into letters."""
    size = lambda c: f"length(regexp_replace({c}, {_lit(SPACES)}, ''))"
    grows = " or ".join(f"({size(found)} <= {n} and {size(put)} > {size(found)} + {most})" for n, most in GROWTH)
    letters = f"({put} rlike {_lit(LETTERS)} and trim({found}) rlike {_lit(NUMBERS)})"
    return f"({size(found)} > 0 and {size(put)} > 0 and ({grows} or {letters}))"


def _literal(rule: Rule) -> str:
    old, put = _lit(rule.pattern), _lit(rule.replacement)
    times = f"cast((length(s.text) - length(replace(s.text, {old}, ''))) / {len(rule.pattern)} as int)"
    done = f"named_struct('text', replace(s.text, {old}, {put}), 'fixes', concat(s.fixes, array_repeat(named_struct('from', {old}, 'to', {put}), {times})))"
    return f"if(contains(s.text, {old}) and not {_guard(old, put)}, {done}, s)"


def _pattern(rule: Rule) -> str:
    """Text between the matches, the matches and what is to replace them side by side; each match is judged by itself."""
    pattern = _lit(java(rule.pattern, rule.flags))
    every = lambda g: f"regexp_extract_all(s.text, {pattern}, {g})"
    if rule.first_only:
        every = lambda g: f"slice(regexp_extract_all(s.text, {pattern}, {g}), 1, 1)"
    cut = re.split(r"\$(\d+)", rule.replacement)
    groups = list(dict.fromkeys(cut[1::2]))
    put = "concat(" + ", ".join(f"p.`{groups.index(x) + 2}`" if k % 2 else _lit(x) for k, x in enumerate(cut)) + ")"
    columns = ", ".join([f"split(s.text, {pattern}, {2 if rule.first_only else -1})", *map(every, ["0", *groups])])
    parts = f"transform(arrays_zip({columns}), p -> named_struct('b', p.`0`, 'm', p.`1`, 'n', {put}))"
    # The last part has no match behind it.
    judged = f"transform({parts}, p -> named_struct('b', p.b, 'm', p.m, 'n', if(p.m is null, '', if({_guard('p.m', 'p.n')}, p.m, p.n))))"
    step = ("named_struct('text', concat(d.text, p.b, p.n), 'fixes', "
            "if(p.m is null or p.m = p.n, d.fixes, concat(d.fixes, array(named_struct('from', p.m, 'to', p.n)))))")
    test = _lit(java(rule.pattern, rule.flags, ""))
    return f"if(s.text rlike {test}, aggregate({judged}, named_struct('text', '', 'fixes', s.fixes), (d, p) -> {step}), s)"


# Rules that one look at the text is taken for.
BLOCK = 16


def _any_match(rules) -> str | None:
    """A pattern found in every text that holds a match of one of the rules; None where they can't stand in one pattern."""
    tests, heads = [], []
    for r in rules:
        pattern = quote(r.pattern) if r.is_literal else r.pattern
        if re.search(r"\\[1-9]|\(\?[a-z]*\)", pattern):
            return None
        test = java(pattern, "" if r.is_literal else r.flags, "")
        flags = re.match(r"\(\?([dim]+)\)", test)
        body = test[flags.end():] if flags else test
        tests.append(f"(?{flags.group(1) if flags else ''}:{body})")
        heads.append(first_characters(body))
    either = "|".join(dict.fromkeys(tests))
    return f"(?=(?i:[{''.join(dict.fromkeys(heads))}]))(?:{either})" if all(heads) else either


def apply_rules(df: DataFrame, rule_list, text_col: str, out_col: str | None = None, fixes_col: str = "fixes",
                only_if: Column | None = None) -> DataFrame:
    """Guarded rules in order over ``text_col``; every change is appended to ``fixes_col``.

    A block of rules costs one test where none of them matches. ``only_if`` leaves out rows that no rule can touch. A null text stays null.
    """
    rule_list = [r for r in rule_list if r.pattern]
    if not rule_list:
        return df if out_col in (None, text_col) else df.withColumn(out_col, F.col(text_col))
    log = F.col(fixes_col) if fixes_col in df.columns else F.array().cast(FIXES)

    def tree(lo: int, hi: int) -> str:
        """The rule with number ``i`` of those from ``lo`` up to ``hi``, found by halving."""
        if hi - lo == 1:
            return (_literal if rule_list[lo].is_literal else _pattern)(rule_list[lo])
        mid = (lo + hi) // 2
        return f"if(i < {mid}, {tree(lo, mid)}, {tree(mid, hi)})"

    def block(k: int) -> str:
        """The rules of a block, one after the other; none is tried where one look tells that the text holds no match of any."""
        lo, hi = k * BLOCK, min((k + 1) * BLOCK, len(rule_list))
        each = f"aggregate(sequence({lo}, {hi - 1}), s, (s, i) -> {tree(lo, hi)})"
        test = _any_match(rule_list[lo:hi])
        return each if test is None else f"if(s.text rlike {_lit(test)}, {each}, s)"

    def blocks(lo: int, hi: int) -> str:
        if hi - lo == 1:
            return block(lo)
        mid = (lo + hi) // 2
        return f"if(b < {mid}, {blocks(lo, mid)}, {blocks(mid, hi)})"

    df = df.withColumn("_go", F.col(text_col).isNotNull() & (F.lit(True) if only_if is None else only_if))
    df = df.withColumn("_begin", F.struct(F.col(text_col).alias("text"), log.alias("fixes")))
    # One fold over the blocks of rules, so the plan stays flat however many rules there are.
    last = (len(rule_list) - 1) // BLOCK
    numbers = f"if(_go, sequence(0, {last}), cast(array() as array<int>))"
    df = df.withColumn("_done", F.expr(f"aggregate({numbers}, _begin, (s, b) -> {blocks(0, last + 1)})"))
    return df.withColumn(fixes_col, F.col("_done.fixes")).withColumn(out_col or text_col, F.col("_done.text")).drop("_done", "_begin", "_go")


def typed_fixes(fixes: Column) -> Column:
    """Add the fix type to each logged change."""
    return F.transform(fixes, lambda f: F.struct(
        f["from"].alias("from"), f["to"].alias("to"), fix_type(f["from"], f["to"]).alias("type")))


# Labels of a fix in order, each with the patterns of which one must occur in the text before, or in both texts. The first
# pattern counts only where the text was removed.
FIX_LABELS = (
    ("ลบอักษรแปลก", "removed", r"[^\w\sก-ฮ" + TONES + r".,:;()/\-+%]"),
    ("ลบอักษรแปลก", "before", "[�ƟθϴƩΣÉÊÈË○●◦▪▫◆◇□■💀]"),
    ("แก้ช่องว่าง", "before", rf"\s{{2,}}|[เแโใไ]\s+[ก-ฮ]|[ก-ฮ]\s+[{TONES}]"),
    ("Dictionary หลายสาย", "both", "[A-Za-z]"),
)
OTHER_FIX = "แก้คำไทย"


def fix_type(before: Column, after: Column) -> Column:
    """Label of one fix: the first of the table that fits."""
    where = {"removed": F.when(after == "", before), "before": before, "both": F.concat(before, after)}
    return F.coalesce(*[F.when(has(where[side], pattern), F.lit(label)) for label, side, pattern in FIX_LABELS], F.lit(OTHER_FIX))


def is_ascii_rule(r: Rule) -> bool:
    return all(ord(ch) < 128 for ch in r.pattern + r.replacement)


def dictionary_rules(ascii_only: bool = False) -> list[Rule]:
    table = fixed.rules("dictionary")
    return [r for r in table if is_ascii_rule(r)] if ascii_only else list(table)


def join_rules(words, thai_only: bool = False) -> list[Rule]:
    """Spaced-letter rules, longest word first."""
    picked = [w for w in words if not thai_only or any("ก" <= ch <= "ฮ" for ch in w)]
    return [Rule(spaced(w), "g", w) for w in fixed.longest_first(picked)]


def join_spaced_words(c: Column, words) -> Column:
    """Rejoin dictionary words split by whitespace; native, letters never change."""
    def joined(out):
        for r in join_rules(words):
            out = sub(out, r.pattern, quote_replacement(r.replacement))
        return out

    # A word can only be split where whitespace follows one of its letters.
    letters = "".join(dict.fromkeys("".join(w[:-1] for w in words)))
    return let(c, lambda x: F.when(has(x, "[" + quote(letters) + r"]\s"), joined(x)).otherwise(x))


def quote_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def rule_hits(df: DataFrame, text_col: str, rule_list, keys=("doc_id",)) -> DataFrame:
    """Which rules fire on which documents, counted on the original text.

    Patterns are literals inside one expression, so there is no join and each
    pattern is compiled once per task.
    """
    hits = F.array(*[
        F.struct(F.lit(i).alias("rule_no"), (
            ((F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit(r.pattern), F.lit(""))))
             / len(r.pattern)).cast("int") if r.is_literal else count(F.col(text_col), r.pattern, r.flags)
        ).alias("hits"))
        for i, r in enumerate(rule_list)
    ])
    fired = F.filter(hits, lambda x: x["hits"] > 0)
    return df.select(*keys, F.inline(fired))


def correction_rules(rows) -> list[Rule]:
    """User corrections ``(wrong, correct)`` as literal rules in saved order."""
    return [Rule(w, "literal", r) for w, r in rows if w and r and w != r]


def apply_corrections(c: Column, rules: list[Rule]) -> Column:
    """User corrections are unguarded literal replacements."""
    for r in rules:
        c = F.replace(c, F.lit(r.pattern), F.lit(r.replacement))
    return c


def accuracy_spell(c: Column, learned: list[Rule] = ()) -> Column:
    """Literal accuracy pairs, vowel spacing and learned rules."""
    # Each of the pairs and of the two patterns holds a Thai character.
    thai = lambda x: sub(sub(fold_set(x, "accuracy"), r"([เแโใไ])\s+([ก-ฮ])", "$1$2"), rf"([ก-ฮ])\s+([{TONES}])", "$1$2")
    c = let(c, lambda x: F.when(has(x, "[\u0e00-\u0e7f]"), thai(x)).otherwise(x))
    c = sub(sub(c, r"Rule\s*-\s*based", "Rule-based", "i"), r"Text\s+Layer", "Text Layer", "i")
    return trim(apply_corrections(c, list(learned)))
