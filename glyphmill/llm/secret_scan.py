"""Secret scanning with built-in functions only.

Three fixed kinds are found by pattern. The ``entropy`` kind takes candidate runs of 16 token characters or more and slides a window of 24
over them (16 over runs under 24, and over parts of 16 to 23 between separators): one step adds a character's count and takes another's away, and the sum of c * log2(c) is adjusted by
table, so no window is counted anew. A candidate is reported if the Shannon entropy of a window reaches the threshold of that window's own
character class, unless the allow list suppresses it or a span of a fixed kind already covers part of it. Thresholds lie where about one of
1,000 random windows of the class falls short. Lower-case letters alone can't be told from a word by entropy: such windows have none.

The allow list has two tests of each part between separators. By shape: words, joined words, numbers, UUIDs. By letter pairs: prose is full of
a hundred pairs that make up a seventh of random letters, so each pair in or out of them, and each number inside the part, is evidence in
bits for or against a name such as ``HTML5CanvasRenderingContext2D``. A candidate is suppressed if every part passes one of the tests, and
in the path of a url.

Scale: each row is judged by itself, without a shuffle. Patterns run only behind a test whether they match at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
# A test that every match of the kind passes, cheaper than the pattern.
TESTS = {"access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "entropy": r"[A-Za-z0-9+/_=-]{16}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
WINDOW, SHORT = 24, 16
# Class, pattern of a whole window, least entropy in bits of a window of 24; separators count in each class. The first that fits counts.
CLASSES = (("words", r"^[a-z+/_=-]*$", 99.0), ("digits", r"^[0-9+/_=-]*$", 2.46), ("hexadecimal", r"^[0-9A-Fa-f+/_=-]*$", 2.86), ("upper", r"^[A-Z+/_=-]*$", 3.2), ("upper and digits", r"^[0-9A-Z+/_=-]*$", 3.36),
           ("lower and digits", r"^[0-9a-z+/_=-]*$", 3.44), ("letters", r"^[A-Za-z+/_=-]*$", 3.64), ("mixed", r"^", 3.7))
# The same for a window of 16.
SHORT_BITS = {"words": 99.0, "digits": 2.1, "hexadecimal": 2.46, "upper": 2.76, "upper and digits": 2.86, "lower and digits": 2.9, "letters": 3.12, "mixed": 3.19}
# A word is lower or upper case, or joined of capitalized parts of four letters or more; a number has under 16 digits. Quantifiers are possessive.
_PART = r"(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9]{1,15}+|[A-Z]{1,15}+|[A-Z]?[a-z]++(?:[A-Z][a-z]{3,}+)*+|[xX]{4,}+)(?=[-_/+=]|$)"
# Never secrets: UUIDs, words and numbers, alone or joined by separators, and keys whose end says that they are examples.
ALLOW = (r"^[-_/+=]*+(?:" + _PART + r"[-_/+=]*+)*+$", r"EXAMPLE(?:KEY)?$")

# Common letter pairs of English, German, French and Spanish prose.
PAIRS = ("ab ac ad ag ai al am an ap ar as at au av ba be bi bl bo br bu ca ce ch ci ck cl co cr ct cu da de di do du ea ec ed ee ef eg ei el em en ep er es et eu ev ex fe ff fi fo fr fu ga ge gh gi gr gu ha he hi ho ht "
         "ia ic id ie if ig il im in io ir is it iv ke la ld le li ll lo ly ma me mi mm mo mp na nc nd ne ng ni no ns nt ob oc of og ol om on op or os ou ov ow pa pe ph pl po pp pr qu ra rd re ri ro rs rt ry sa sc se sh si so sp ss st su "
         "ta te th ti to tr ts tt tu ty ub uc ue ui ul un up ur us ut va ve vi we wh wi wo").split()
# Bits for a pair of prose, against another pair and against each number in a part; the least sum of a name; parts this short are judged by the rest.
PROSE, OTHER, NUMBER, NAME, BRIEF = 1.5, 2.6, 3.0, 1.0, 3
_PROSE_PAIR = "(?i)(?=(?:" + "|".join(PAIRS) + "))"
URL_PATH = r"""://[^\s"'<>?#]*$"""
LONGEST_URL = 2048

SPAN = "array<struct<start:int,place:int,stop:int,kind:string>>"


def _walk(text: Column, pattern: str, keep, place: int, kind: str) -> Column:
    """Spans of the leftmost matches that ``keep(match)`` accepts; positions are code points."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state, part):
        start = state["at"] + F.length(part["before"])
        stop = start + F.coalesce(F.length(part["found"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), stop.alias("stop"), F.lit(kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(part["found"].isNotNull() & keep(part["found"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parts, begin, step, lambda s: s["spans"])


def fixed_spans(text: Column, kind: str) -> Column:
    place = [k[0] for k in KINDS].index(kind)
    _, pattern, group, least = KINDS[place]
    keep = (lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least) if group else (lambda m: F.length(m) >= least)
    return F.when(text.rlike(TESTS.get(kind, pattern)), _walk(text, pattern, keep, place, kind)).otherwise(F.array().cast(SPAN))


def _least(letters: dict, bits: dict) -> Column:
    """The threshold of a window's class from its numbers of digits, upper, lower and hexadecimal characters."""
    digits, upper, lower, hexadecimal = (letters[k] for k in ("digits", "upper", "lower", "hexadecimal"))
    of = lambda name: F.lit(bits[name])
    return (F.when((digits == 0) & (upper == 0), of("words")).when((upper == 0) & (lower == 0), of("digits")).when(hexadecimal == digits + upper + lower, of("hexadecimal"))
            .when((digits == 0) & (lower == 0), of("upper")).when(lower == 0, of("upper and digits")).when(upper == 0, of("lower and digits")).when(digits == 0, of("letters")).otherwise(of("mixed")))


def reaches(run: Column, window: int, bits: dict) -> Column:
    """Whether a window of characters of an ASCII string has the entropy in bits that its class needs."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    # Pairs of the character that enters and the one that leaves (-1: none yet).
    moves = F.arrays_zip(codes.alias("i"), F.concat(F.array_repeat(F.lit(-1), window), codes).alias("o"))
    kinds = {"digits": lambda c: c.between(48, 57), "upper": lambda c: c.between(65, 90), "lower": lambda c: c.between(97, 122), "hexadecimal": lambda c: c.between(48, 57) | c.between(65, 70) | c.between(97, 102)}
    begin = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), *[F.lit(0).alias(k) for k in kinds], F.lit(False).alias("found"))

    def step(s, move):
        enter, leave = move["i"], move["o"]
        count = lambda code: F.element_at(s["counts"], F.greatest(code, F.lit(0)) + 1)
        term = lambda c: F.element_at(terms, c + 1)
        out, same = count(leave), enter == leave
        came = count(enter)
        total = F.when(same, s["sum"]).otherwise(s["sum"] + term(came + 1) - term(came) + F.when(leave >= 0, term(out - 1) - term(out)).otherwise(F.lit(0.0)))
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + F.when(k == enter, 1).when(k == leave, -1).otherwise(0)))
        letters = {k: s[k] + f(enter).cast("int") - f(leave).cast("int") for k, f in kinds.items()}
        value = F.round(math.log2(window) - total / window, 9)
        found = s["found"] | ((s["n"] + 1 >= window) & (value >= _least(letters, bits)))
        return F.struct((s["n"] + 1).alias("n"), counts.alias("counts"), total.alias("sum"), *[c.alias(k) for k, c in letters.items()], found.alias("found"))

    # Moves behind the last character only take characters away.
    return F.aggregate(F.filter(moves, lambda m: m["i"].isNotNull()), begin, lambda s, m: F.when(s["found"], s).otherwise(step(s, m)), lambda s: s["found"])


def reads_like_a_name(part: Column) -> Column:
    """Whether the letter pairs of a part between separators are rather those of prose, in spite of the numbers in it."""
    prose, pairs = F.regexp_count(part, F.lit(_PROSE_PAIR)), F.regexp_count(part, F.lit("(?=[A-Za-z]{2})"))
    return prose * PROSE - (pairs - prose) * OTHER - F.regexp_count(part, F.lit("[0-9]+")) * NUMBER >= NAME


def entropy_spans(text: Column, allow=()) -> Column:
    """Spans of candidates with a window of high entropy that aren't on the allow list (patterns, letter pairs, and the strings in ``allow``)."""
    def keep(run):
        listed = F.lit(False)
        for pattern in ALLOW:
            listed = listed | run.rlike(pattern)
        if allow:
            listed = listed | run.isin(list(allow))
        named = F.forall(F.split(run, "[-_/+=]+"), lambda p: (F.length(p) <= BRIEF) | p.rlike("^" + _PART + "$") | reads_like_a_name(p))
        long = reaches(run, WINDOW, {name: bits for name, _, bits in CLASSES})
        parts = F.filter(F.split(run, "[-_/+=]+"), lambda p: F.length(p).between(SHORT, WINDOW - 1))
        within = F.exists(parts, lambda p: reaches(p, SHORT, SHORT_BITS))
        return F.when(listed | named, F.lit(False)).when(F.length(run) >= WINDOW, long | within).otherwise(reaches(run, SHORT, SHORT_BITS))

    spans = F.filter(_walk(text, CANDIDATE, keep, len(KINDS), "entropy"), lambda s: ~F.substring(
        text, F.greatest(F.lit(1), s["start"] + 1 - LONGEST_URL), F.least(s["start"], F.lit(LONGEST_URL))).rlike(URL_PATH))
    return F.when(text.rlike(TESTS["entropy"]), spans).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow=()) -> DataFrame:
    """``(doc_id, text, assign, access, hex, entropy)``: arrays of ``struct(start, place, stop, kind)``, starts in order, stops exclusive.

    A null text counts as empty and has no spans. Ids, nulls and repeated rows stay as they are; extra columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[fixed_spans(text, k[0]).alias(k[0]) for k in KINDS], entropy_spans(text, allow).alias("e"))
    base = F.concat("assign", "access", "hex")
    apart = F.filter("e", lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return found.select("doc_id", "text", "assign", "access", "hex", apart.alias("entropy"))


def named(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every character of ``spans`` replaced, one mask for each run of touching spans."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, span):
        fresh = span["start"] >= s["at"]
        gap = F.when(fresh, F.concat(F.substring(text, s["at"] + 1, span["start"] - s["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], span["stop"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    done = F.aggregate(F.array_sort(spans), begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
