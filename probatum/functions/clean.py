"""Record-level cleaning functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions.text import strip


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def text_list(c: Column) -> Column:
    """A list field from its JSON text; other text is a list of itself."""
    t = strip(c)
    parsed = F.from_json(t, "array<string>", {"mode": "PERMISSIVE"})
    good = F.regexp_like(t, F.lit(r"(?s)^\[.*\]$")) & F.try_parse_json(t).isNotNull()
    return (F.when(t.isNull() | (t == ""), F.array().cast("array<string>"))
            .when(good, parsed).otherwise(F.array(t)))


def external_id(url: Column) -> Column:
    """The 32-hex id in a record address, dashes dropped."""
    found = F.regexp_extract(url, "(?i)" + fixed.EXTERNAL_ID, 1)
    return F.nullif(F.replace(found, F.lit("-"), F.lit("")), F.lit(""))


def narrative_position(categories: Column) -> Column:
    choice = None
    for label, members in fixed.NARRATIVE_POSITIONS:
        hit = F.arrays_overlap(categories, F.array(*[F.lit(m) for m in members]))
        choice = F.when(hit, F.lit(label)) if choice is None else choice.when(hit, F.lit(label))
    return choice.otherwise(F.lit("other"))


def content_hash(df: DataFrame, omit=("hash", "lastEdited")) -> Column:
    """First 16 hex digits of SHA-256 over the key-sorted record, nulls kept."""
    names = sorted(c for c in df.columns if c not in omit)
    record = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(record, 256), 1, 16)


def ladder_rank(value: Column, ladder) -> Column:
    """0 for the strongest rung; null off the ladder."""
    at = F.array_position(F.array(*[F.lit(v) for v in ladder]), value)
    return F.nullif(at, F.lit(0).cast("bigint")) - 1


def year_of(iso: Column) -> Column:
    return F.substring(iso, 1, 4)


def long_date(iso: Column) -> Column:
    return F.date_format(F.try_to_date(iso), "d MMMM yyyy")


def has_verbatim(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return (t != "") & ~F.regexp_like(t, F.lit("(?i)" + fixed.NOT_CONSULTED))


def request_hint(reference: Column) -> Column:
    """What to ask the archive for, once the unverified label is taken off."""
    return text_or_null(F.regexp_replace(reference, r"(?i)^\s*" + fixed.UNVERIFIED_REFERENCE + r"\s*[.:—–-]*\s*", ""))


def place_line(city: Column, country: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(city, F.lit("")), F.nullif(country, F.lit("")))


def backlog_flag(not_yet_searched: Column) -> Column:
    return F.when(not_yet_searched.isNotNull(), F.lit("Written")).otherwise(F.lit("Not yet documented"))


def held_positions(positions: Column) -> Column:
    """The positions a dispute records, as ``array<struct<party, text>>``; null is silence."""
    return F.filter(_parties(positions), lambda p: p["text"].isNotNull())


def silent_positions(positions: Column) -> Column:
    silent = F.filter(_parties(positions), lambda p: p["text"].isNull())
    return F.transform(silent, lambda p: p["party"])


def _parties(positions: Column) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("party"), positions[p].alias("text"))
                     for p in ("french", "spanish", "moroccan", "other")])


def figure_range(values: Column) -> Column:
    """Sorted values with their relative position; equal ends count as a span of 1."""
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high == low, F.lit(1)).otherwise(high - low)
    return F.transform(F.array_sort(values), lambda v: F.struct(
        v.alias("value"), ((v - low) / span).alias("position")))


def search_blob(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def tier_step(tier: Column) -> Column:
    return ladder_rank(tier, fixed.TIERS) + 1
