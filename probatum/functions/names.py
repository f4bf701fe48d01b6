"""Name folding, alias splitting and slugs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions.text import _SPACE, java_pattern, replace_all, strip

QUOTES = "['‘’\"“”]"


def _decomposable() -> dict[str, str]:
    """Letters that Unicode decomposes to one base letter and combining accents."""
    table = {}
    for code in range(0x00C0, 0xFFF0):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(p for p in parts if not 0x0300 <= ord(p) <= 0x036F)
        if len(parts) > 1 and len(base) == 1:
            table[chr(code)] = base
    return table


DECOMPOSABLE = _decomposable()


def map_letters(c: Column, table: dict[str, str]) -> Column:
    """One ``translate`` for single letters, a ``replace`` for each longer expansion."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if v == ""]
    c = replace_all(c, [(k, v) for k, v in table.items() if len(v) > 1])
    return F.translate(c, "".join(one) + "".join(gone), "".join(one.values()))


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(map_letters(c, DECOMPOSABLE), "[\\u0300-\\u036f]", "")


def _mapped(c: Column, table: dict[str, str]) -> Column:
    """Letters of the table and accents; an ASCII text meets only what the table has of ASCII."""
    plain = {k: v for k, v in table.items() if k.isascii()}
    is_ascii = F.octet_length(c) == F.length(c)
    return F.when(is_ascii, map_letters(c, plain) if plain else c).otherwise(strip_accents(map_letters(c, table)))


def fold(c: Column) -> Column:
    """The search key: no accents, no transliteration marks, lower case."""
    return strip(F.lower(_mapped(F.coalesce(c, F.lit("")), fixed.SEARCH_FOLD)))


def has_arabic(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(fixed.ARABIC_RANGE)), F.lit(False))


def fold_arabic(c: Column) -> Column:
    c = map_letters(F.regexp_replace(c, fixed.ARABIC_MARKS, ""), fixed.ARABIC_LETTERS)
    return strip(F.regexp_replace(c, _SPACE + "+", " "))


def _fold_latin(c: Column) -> Column:
    c = F.lower(_mapped(c, fixed.MATCH_FOLD))
    return F.regexp_replace(replace_all(c, fixed.SPELLING), r"(.)\1+", "$1")


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(c: Column, separators: str) -> Column:
    return F.filter(F.split(c, separators), lambda t: t != "")


_ANY_SCRIPT = r"[^a-zA-Z0-9؀-ۿ]+"


def fold_tokens(c: Column) -> Column:
    """Sorted tokens of the match key, particles and single letters left out.

    A name made only of those keeps them: it is still a name.
    """
    def latin(every):
        kept = F.filter(every, lambda t: ~t.isin(fixed.PARTICLES) & (F.length(t) > 1))
        return _let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(every))

    def tokens(name):
        return F.when(has_arabic(name), _pieces(fold_arabic(name), _ANY_SCRIPT)).otherwise(
            _let(_pieces(_fold_latin(name), _ANY_SCRIPT), latin))

    return F.array_sort(_let(F.coalesce(c, F.lit("")), tokens))


def fold_key(c: Column) -> Column:
    """The match key: folded spelling with word order ignored."""
    return F.array_join(fold_tokens(c), " ")


def fold_ordered(c: Column) -> Column:
    """The match key in the written word order."""
    c = F.coalesce(c, F.lit(""))
    latin = F.filter(F.split(_fold_latin(c), "[^a-z0-9]+"),
                     lambda t: (t != "") & ~t.isin(fixed.PARTICLES))
    return F.when(has_arabic(c), fold_arabic(c)).otherwise(F.array_join(latin, " "))


# ------------------------------------------------------------------ slugs
def slugify(c: Column, transliterate: bool = True) -> Column:
    """A URL segment.  ``transliterate`` off folds accents only (the audit variant)."""
    c = F.coalesce(c, F.lit(""))
    base = fold(c) if transliterate else F.lower(strip_accents(c))
    base = F.regexp_replace(base, r"""[·/—–_,:;.'"()\[\]{}]""", "-")
    base = F.regexp_replace(base, r"[^a-z0-9؀-ۿ-]+", "-")
    base = F.regexp_replace(F.regexp_replace(base, "-+", "-"), "^-|-$", "")
    return F.when(base == "", F.lit("untitled")).otherwise(base)


def country_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def surname(name: Column) -> Column:
    """The last white-space token."""
    return F.element_at(F.split(name, _SPACE + "+"), -1)


def short_institution(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s*\(.*\)\s*$", ""))


# ------------------------------------------------------------------ aliases
def _split_outside_quotes(c: Column) -> Column:
    """Split on commas outside quotation marks; the marks themselves go."""
    spans = F.split(c, QUOTES, -1)
    marked = F.transform(spans, lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit(","), F.lit("\u0001")))
                         .otherwise(s))
    return F.filter(F.transform(F.split(F.array_join(marked, ""), "\u0001"), strip), lambda v: v != "")


def _variants(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "·"), strip), lambda v: v != "")


def split_aliases(field: Column) -> Column:
    """Spelling variants of an alias field, notes and tradition tags removed."""
    note = java_pattern(fixed.TRAILING_NOTE, ignore_case=True)
    tag = java_pattern(fixed.LEADING_TAG, ignore_case=True)

    def members(chunk):
        rest = F.regexp_replace(F.regexp_replace(chunk, note, ""), tag, "")
        return F.when(F.regexp_like(rest, F.lit(QUOTES)), _split_outside_quotes(rest)).otherwise(
            F.array(strip(rest)))

    every = F.flatten(F.transform(_variants(F.coalesce(field, F.lit(""))), members))
    return F.filter(every, lambda v: F.length(v) > 1)


def split_quoted(c: Column) -> Column:
    """Members of a quoted list; an unquoted text stays whole."""
    c = strip(F.coalesce(c, F.lit("")))
    members = _split_outside_quotes(c)
    quoted = F.when(F.size(members) > 0, members).otherwise(F.array(c))
    return (F.when(c == "", F.array().cast("array<string>"))
            .when(F.regexp_like(c, F.lit(QUOTES)), quoted).otherwise(F.array(c)))


def is_prose_note(c: Column) -> Column:
    return (F.regexp_like(c, F.lit(rf"\.{_SPACE}+[^\s]"))
            & (F.size(F.split(c, _SPACE + "+")) >= 6))


def parse_aliases(raw: Column) -> Column:
    """``array<struct<value, tradition, script, folded, isNote>>`` of an alias field."""
    tagged = java_pattern("^" + fixed.TRADITION_TAG + r"\s*:\s*(.+)$", ignore_case=True)

    def members(variant):
        has_tag = F.regexp_like(variant, F.lit(tagged))
        tradition = F.when(has_tag, F.regexp_replace(F.regexp_extract(variant, tagged, 1), r"\.$", ""))
        rest = F.when(has_tag, strip(F.regexp_extract(variant, tagged, 2))).otherwise(variant)
        return F.transform(split_quoted(rest), lambda v: F.struct(
            v.alias("value"),
            F.coalesce(tradition, F.when(has_arabic(v), F.lit("Ar"))).alias("tradition"),
            F.when(has_arabic(v), F.lit("arabic")).otherwise(F.lit("latin")).alias("script"),
            fold(v).alias("folded"),
            is_prose_note(v).alias("isNote")))

    return F.flatten(F.transform(_variants(F.coalesce(raw, F.lit(""))), members))
