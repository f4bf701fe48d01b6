"""Text functions: boundaries, positions, sentences, numbers, markdown and HTML."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatum import fixed

WHITESPACE = " \t\n\r\f\v ﻿   　"
_SPACE = r"[\s\x{A0}\x{FEFF}\x{2028}\x{2029}\x{202F}\x{3000}]"
_WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java_pattern(pattern: str, ignore_case: bool = False, multiline: bool = False,
                 dotall: bool = False) -> str:
    """Rewrite ``\\b`` to an ASCII word boundary and ``\\s`` to all white space.

    Java counts accented letters as word characters next to ``\\b``; the patterns in
    :mod:`probatum.fixed` are meant with ASCII words.
    """
    flags = ("iu" if ignore_case else "") + ("m" if multiline else "") + ("s" if dotall else "")
    body = pattern.replace(r"\b", BOUNDARY)
    body = re.sub(r"\\s", lambda _: _SPACE, body)
    # most characters are no digits, and that is cheaper to see than what stands before
    body = body.replace(r"(?<![\d.,])", r"(?=\d)(?<![\d.,])")
    return (f"(?{flags})" if flags else "") + body


def literal_pattern(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\/-])", r"\\\1", text)


def any_literal(terms, ignore_case: bool = True, bounded: bool = True) -> str:
    """One alternation for a word list, longest member first."""
    alternatives = "|".join(literal_pattern(t) for t in sorted(terms, key=len, reverse=True))
    edge = r"\b" if bounded else ""
    return java_pattern(f"{edge}({alternatives}){edge}", ignore_case)


def holds_literal(text: Column, literals) -> Column:
    """Cheap test for any of some texts, in their case."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals])


def holds_term(text: Column, terms) -> Column:
    """Cheap test for any of some terms in any case, without regard to word boundaries."""
    # the text is lower-cased once for all terms
    found = F.transform(F.array(F.lower(text)), lambda low: holds_literal(low, [t.lower() for t in terms]))
    return F.get(found, F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, _SPACE + "+", " "))


def replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def truncate(c: Column, n: int = 160) -> Column:
    flat = squeeze(c)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def around(text: Column, needle: Column, radius: int, fallback: int | None = None) -> Column:
    """The needle with ``radius`` characters either side; the head of the text if absent."""
    at = F.instr(text, needle)
    start = F.greatest(at - radius, F.lit(1))
    cut = F.substring(text, start, at + F.length(needle) + radius - start)
    return F.when(at > 0, cut).otherwise(text if fallback is None else F.substring(text, 1, fallback))


def excerpt(text: Column, marker: Column, radius: int = 60) -> Column:
    """As :func:`around`, found without regard to case and trimmed."""
    at = F.instr(F.lower(text), F.lower(marker))
    start = F.greatest(at - radius, F.lit(1))
    cut = F.substring(text, start, at + F.length(marker) + radius - start)
    return F.when(at > 0, strip(cut)).otherwise(F.substring(text, 1, 120))


# ------------------------------------------------------------------ positions
_MARK = "\u0001"


def match_positions(text: Column, pattern: str) -> Column:
    """All matches of a pattern as ``array<struct<start:int, hit:string>>`` (0-based).

    Spark reports matches but not where they are; the text between the matches gives
    the offsets.  Call it behind a filter that keeps only rows with a match.
    """
    # a marker instead of the matches: splitting at one character needs no regex
    gaps = F.split(F.regexp_replace(F.translate(text, _MARK, " "), pattern, _MARK), _MARK, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,hit:string>>").alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        found = F.array_append(acc["out"], F.struct(start.alias("start"), pair["hit"].alias("hit")))
        return F.struct((start + F.coalesce(F.length(pair["hit"]), F.lit(0))).alias("at"),
                        F.when(pair["hit"].isNull(), acc["out"]).otherwise(found).alias("out"))

    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def window_at(text: Column, start: Column, radius: int) -> Column:
    """Lower-cased characters from ``radius`` before to ``radius`` after a position."""
    begin = F.greatest(start - radius, F.lit(0))
    return F.lower(F.substring(text, begin + 1, start + radius - begin))


def sentence_at(text: Column, start: Column, pipes: bool = True) -> Column:
    """The sentence around a position; block ends and table bars end one too."""
    left = F.substring(text, F.lit(1), start)
    right = F.substr(text, start + 1)
    openers = [". ", "\n", "; "] + (["| "] if pipes else [])
    closers = [". ", "\n"] + ([" |"] if pipes else [])

    def shortest(parts):
        return F.least(*[F.struct(F.length(p).alias("n"), p.alias("part")) for p in parts])["part"]

    head = shortest([F.substring_index(left, d, -1) for d in openers])
    tail = shortest([F.substring_index(right, d, 1) for d in closers])
    return F.concat(head, F.substring(right, F.lit(1), F.length(tail) + 1))


# ------------------------------------------------------------------ numbers
def number_forms(value: int) -> list[str]:
    return [f"{value:,}", str(value)] if value >= 1000 else [str(value)]


def number_pattern(values) -> str:
    """A standalone number, plain or with thousands commas, from a known list.

    What stands before is looked at after the digits matched, which few places do.
    """
    forms = sorted({f for v in values for f in number_forms(v)}, key=len, reverse=True)
    alone = "|".join(rf"{f}(?<![\d.,].{{{len(f)}}})" for f in forms)
    return rf"(?=\d)(?:{alone})(?![\d]|[.,]\d)"


def holds_number(text: Column, number: Column) -> Column:
    """Does the text hold this number standing alone, with or without its commas?"""
    bare = F.replace(number, F.lit(","), F.lit(""))
    pattern = F.concat(F.lit(r"(?<![\d.,])("), number, F.lit("|"), bare, F.lit(r")(?![\d]|[.,]\d)"))
    return F.regexp_like(text, pattern)


def numbers(text: Column) -> Column:
    """All standalone numbers of a text, as written."""
    return F.regexp_extract_all(text, F.lit(java_pattern(fixed.NUMBER_EXPRESSION)), F.lit(0))


def ranges(text: Column) -> Column:
    """Written ranges as ``array<struct<low, high, key>>``; only rising ones count."""
    pattern = java_pattern(fixed.RANGE_EXPRESSION, ignore_case=True)
    lows = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    highs = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    pairs = F.transform(
        F.arrays_zip(lows.alias("low"), highs.alias("high")),
        lambda p: F.struct(p["low"].alias("low"), p["high"].alias("high"),
                           F.concat_ws("-", bare(p["low"]), bare(p["high"])).alias("key")))
    return F.filter(pairs, lambda p: bare(p["high"]).try_cast("double") > bare(p["low"]).try_cast("double"))


def is_range_endpoint(sentence: Column, figure: Column) -> Column:
    pattern = java_pattern(fixed.RANGE_EXPRESSION)
    return F.exists(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0)),
                    lambda r: F.contains(r, figure))


def derived_year(text: Column) -> Column:
    year = F.regexp_extract(text, java_pattern(fixed.YEAR_IN_TEXT), 1)
    return F.nullif(year, F.lit("")).try_cast("int")


# ------------------------------------------------------------------ markdown
def plain(md: Column) -> Column:
    """Markdown emphasis, code and links removed."""
    for pattern in (r"`([^`]*)`", r"\*\*([^*]*)\*\*", r"\*([^*]*)\*", r"\[([^\]]*)\]\([^)]*\)"):
        md = F.regexp_replace(md, pattern, "$1")
    return squeeze(md)


def to_prose(body: Column) -> Column:
    """Import lines and component tags removed, the children of components kept."""
    body = F.regexp_replace(body, r"(?m)^import .*$", "")
    body = F.regexp_replace(body, r"<[A-Z][A-Za-z0-9]*" + BOUNDARY + r"[\s\S]*?/>", "")
    body = F.regexp_replace(body, r"</?[A-Z][A-Za-z0-9]*" + BOUNDARY + r"[^>]*>", "")
    return strip(F.regexp_replace(body, r"\n{3,}", "\n\n"))


def frontmatter_parts(raw: Column) -> tuple[Column, Column]:
    """(frontmatter text or null, body) of a markdown document."""
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    has = F.regexp_like(raw, F.lit(pattern))
    return (F.when(has, F.regexp_extract(raw, pattern, 1)),
            F.when(has, F.regexp_extract(raw, pattern, 2)).otherwise(raw))


def frontmatter_map(front: Column) -> Column:
    """``key: value`` lines as a map; one pair of matching outer quotes is dropped."""
    lines = F.filter(F.split(F.coalesce(front, F.lit("")), r"\r?\n"),
                     lambda l: F.regexp_like(l, F.lit(r"^\w+:")))

    def entry(line):
        key = F.regexp_extract(line, r"^(\w+):", 1)
        value = strip(F.regexp_extract(line, r"^\w+:\s*(.*)$", 1))
        return F.struct(key.alias("key"),
                        F.regexp_replace(value, "^[\"'](.*)[\"']$", "$1").alias("value"))

    # the last line of a repeated key wins
    entries = F.transform(lines, entry)
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
                    lambda x: ~F.exists(F.slice(entries, x["i"] + 2, F.size(entries)),
                                        lambda later: later["key"] == x["e"]["key"]))
    return F.map_from_entries(F.transform(kept, lambda x: x["e"]))


def is_blockquote(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^\s*>"))


# ------------------------------------------------------------------ HTML
def strip_tags(html: Column) -> Column:
    """Readable text: block ends become newlines, other tags and entities spaces."""
    text = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", " ")
    text = F.regexp_replace(text, r"(?i)<style[\s\S]*?</style>", " ")
    text = F.regexp_replace(text, "(?i)" + fixed.BLOCK_END, "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"(?i)&[a-z]+;", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return F.regexp_replace(text, r"\n{2,}", "\n")


# ------------------------------------------------------------------ words of judgement
def discusses_terms(line: Column) -> Column:
    """The line talks about vocabulary, or says whose word a term is."""
    return (F.regexp_like(line, F.lit(java_pattern(fixed.EXPLANATORY, ignore_case=True)))
            | F.regexp_like(line, F.lit(java_pattern(fixed.ATTRIBUTED, ignore_case=True))))


def is_qualified(sentence: Column, pattern: str = fixed.QUALIFIED) -> Column:
    return F.regexp_like(sentence, F.lit(java_pattern(pattern, ignore_case=True)))


def is_marked(line: Column, start: Column, length: Column) -> Column:
    """Is a term quoted, emphasised, bracketed or inside an open quotation or code?"""
    ahead = F.substring(line, F.lit(1), start)
    before = rstrip(F.right(ahead, F.lit(3)))
    after = lstrip(F.substring(line, start + length + 1, F.lit(3)))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    quoted = like(before, r"[\"“”'‘’«»]$") & like(after, r"^[\"“”'‘’«»]")
    emphasised = like(before, r"[*_`]$") & like(after, r"^[*_`]")
    odd = lambda p: F.regexp_count(ahead, F.lit(p)) % 2 == 1
    return quoted | emphasised | like(before, r"\($") | odd(r"[\"“”«»]") | odd("`")


def is_marked_on_page(line: Column, start: Column, length: Column) -> Column:
    """The publishing variant: one-sided quotes within 40 characters, or inline code."""
    ahead = F.substring(line, F.lit(1), start)
    before = rstrip(F.right(ahead, F.lit(40)))
    after = lstrip(F.substring(line, start + length + 1, F.lit(40)))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    return (like(before, r"[\"“'‘*`]$") | like(after, r"^[\"”'’*`]")
            | (F.regexp_count(ahead, F.lit("`")) % 2 == 1))


def looks_withheld(text: Column) -> Column:
    # all start at a boundary with a letter: where none of these stands nothing else is tried
    starts = "".join(sorted({p.removeprefix(r"\b")[0] for p in fixed.WITHHELD_PATTERNS}))
    joined = "|".join(f"(?:{p.removeprefix(r'\b')})" for p in fixed.WITHHELD_PATTERNS)
    return F.regexp_like(text, F.lit(java_pattern(rf"(?=[{starts}])\b(?:{joined})", ignore_case=True)))


def names_falsifier(text: Column) -> Column:
    return F.regexp_like(text, F.lit(any_literal(fixed.FALSIFIER_MARKERS, bounded=False)))


def tokens_present(text: Column, tokens) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, t))


def hedges_lost(before: Column, after: Column) -> Column:
    """Hedges that stood beside a number before and no longer do."""
    def beside_number(hedge):
        h = literal_pattern(hedge)
        return java_pattern(rf"\b{h}\b[^.]{{0,40}}?\d|\d[^.]{{0,40}}?\b{h}\b", ignore_case=True)

    lost = [F.when(F.regexp_like(before, F.lit(beside_number(h)))
                   & ~F.regexp_like(after, F.lit(beside_number(h))), F.lit(h)) for h in fixed.HEDGES]
    return F.filter(F.array(*lost), lambda h: h.isNotNull())


def callout_kind(line: Column) -> Column:
    """The kind of a blockquote opened by a bold terminology or evidence label."""
    opener = strip(F.regexp_extract(line, r"^\s*>\s*\*\*([^*]*)\*\*", 1))
    kinds = F.create_map(*[F.lit(x) for pair in fixed.CALLOUT_OPENERS.items() for x in pair])
    return F.element_at(kinds, opener)


def heading(line: Column) -> tuple[Column, Column]:
    """(depth, text) of a second or third level heading, null elsewhere."""
    depth = F.nullif(F.length(F.regexp_extract(line, r"^(#{2,3})\s+(.*)$", 1)), F.lit(0))
    return depth, F.when(depth.isNotNull(), plain(F.regexp_extract(line, r"^(#{2,3})\s+(.*)$", 2)))
