"""Fragments of DuckDB SQL shared by the checks."""

from __future__ import annotations

from probatum import fixed
from workload.records import quoted

WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '[\\s\\x{{A0}}]+', ' ', 'g')")


def replaces(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    return x


def no_accents(x: str) -> str:
    """Accents off; Arabic letters keep their marks."""
    return f"replace(strip_accents(replace({x}, 'أ', '¤')), '¤', 'أ')"


def search_fold(x: str) -> str:
    return strip(f"lower({no_accents(replaces(x, fixed.SEARCH_FOLD.items()))})")


def match_fold(x: str) -> str:
    x = f"lower(strip_accents({replaces(x, fixed.MATCH_FOLD.items())}))"
    x = replaces(x, fixed.SPELLING)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789 ":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


def arabic(x: str) -> str:
    return f"regexp_matches({x}, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]')"


def arabic_fold(x: str) -> str:
    x = f"regexp_replace({x}, '[\\x{{064B}}-\\x{{0670}}\\x{{065F}}\\x{{06D6}}-\\x{{06ED}}\\x{{0640}}]', '', 'g')"
    return squeeze(replaces(x, fixed.ARABIC_LETTERS.items()))


PARTICLES = "[" + ", ".join(quoted(p) for p in fixed.PARTICLES) + "]"
ANY_TOKEN = "'[^a-zA-Z0-9\\x{0600}-\\x{06FF}]+'"


def fold_tokens(x: str, folded: str) -> str:
    """Tokens of the match key, where ``folded`` holds ``match_fold(x)``."""
    every = f"list_filter(regexp_split_to_array({folded}, {ANY_TOKEN}), lambda t: t <> '')"
    kept = f"list_filter({every}, lambda t: NOT list_contains({PARTICLES}, t) AND length(t) > 1)"
    return (f"list_sort(CASE WHEN {arabic(x)} THEN list_filter(regexp_split_to_array({arabic_fold(x)}, {ANY_TOKEN}), lambda t: t <> '') "
            f"WHEN len({kept}) > 0 THEN {kept} ELSE {every} END)")


def fold_ordered(x: str, folded: str) -> str:
    return (f"CASE WHEN {arabic(x)} THEN {arabic_fold(x)} ELSE array_to_string(list_filter("
            f"regexp_split_to_array({folded}, '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({PARTICLES}, t)), ' ') END")


def jaro_winkler(a: str, b: str) -> str:
    """Jaro-Winkler with half transpositions counted as halves, from lists of matched places."""
    reach = f"greatest(0, greatest(length({a}), length({b})) // 2 - 1)"
    places = (f"list_reduce(range(1, length({a}) + 1), lambda found, i: list_append(found, coalesce(list_min(list_filter("
              f"range(greatest(1, i - {reach}), least(length({b}), i + {reach}) + 1), "
              f"lambda j: substr({b}, j, 1) = substr({a}, i, 1) AND NOT list_contains(found, j))), 0)), CAST([] AS BIGINT[]))")
    letters = (f"list_transform(list_filter(range(1, length({a}) + 1), lambda i: p[i] > 0), lambda i: substr({a}, i, 1))",
               f"list_transform(list_sort(list_filter(p, lambda j: j > 0)), lambda j: substr({b}, j, 1))")
    matched = f"struct_pack(m := len(list_filter(p, lambda j: j > 0)), x := {letters[0]}, y := {letters[1]})"
    swapped = "len(list_filter(range(1, q.m + 1), lambda k: q.x[k] <> q.y[k]))"
    jaro = f"(q.m / length({a}) + q.m / length({b}) + (q.m - {swapped} / 2) / q.m) / 3"
    prefix = f"len(list_filter(range(1, 5), lambda k: k <= least(length({a}), length({b})) AND left({a}, k) = left({b}, k)))"
    score = f"CASE WHEN q.m = 0 THEN 0 ELSE list_transform([{jaro}], lambda z: CASE WHEN z < 0.7 THEN z ELSE z + {prefix} * 0.1 * (1 - z) END)[1] END"
    return (f"CASE WHEN {a} = {b} THEN 1 ELSE list_transform(list_transform([{places}], lambda p: {matched}), lambda q: {score})[1] END")


def slugify(folded: str) -> str:
    x = f"regexp_replace({folded}, '[·/—–_,:;.''\"()\\[\\]{{}}]', '-', 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9\\x{{0600}}-\\x{{06FF}}-]+', '-', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '-+', '-', 'g'), '^-|-$', '', 'g')"
    return f"CASE WHEN {x} = '' THEN 'untitled' ELSE {x} END"


def word(pattern: str) -> str:
    """A whole-word test without look-around: the text needs a rim on both sides."""
    return f"(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)"




def one_of(terms) -> str:
    import re
    return "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(terms, key=len, reverse=True))


def ladder(x: str, values) -> str:
    return f"(list_position([{', '.join(quoted(v) for v in values)}], {x}) - 1)"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)
