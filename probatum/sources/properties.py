"""Typed-union properties and view rows as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.functions.clean import text_list, text_or_null

# One parse per property; which member is read depends on ``type``.
PROPERTY = ("type string, title array<struct<plain_text:string>>, rich_text array<struct<plain_text:string>>, "
            "select struct<name:string>, multi_select array<struct<name:string>>, date struct<start:string>, "
            "url string, number double, checkbox boolean, relation array<struct<id:string>>, "
            "people array<struct<id:string>>, last_edited_time string")


def read_property(json: Column) -> Column:
    """``struct<text, items>`` of a property: a single value as text, or a list.

    An unknown type gives nulls; an empty rich text is null, an empty title is not.
    """
    p = F.from_json(json, PROPERTY)
    kind = p["type"]
    joined = lambda runs: F.array_join(F.transform(runs, lambda t: t["plain_text"]), "")
    number = F.when(p["number"] == F.floor(p["number"]), p["number"].cast("bigint").cast("string")).otherwise(
        p["number"].cast("string"))
    text = (F.when(kind == "title", joined(p["title"]))
            .when(kind == "rich_text", F.nullif(joined(p["rich_text"]), F.lit("")))
            .when(kind == "select", p["select"]["name"]).when(kind == "date", p["date"]["start"])
            .when(kind == "url", p["url"]).when(kind == "number", number)
            .when(kind == "checkbox", p["checkbox"].cast("string"))
            .when(kind == "last_edited_time", p["last_edited_time"]))
    items = (F.when(kind == "multi_select", F.transform(p["multi_select"], lambda s: s["name"]))
             .when(kind == "relation", F.transform(p["relation"], lambda s: s["id"]))
             .when(kind == "people", F.transform(p["people"], lambda s: s["id"])))
    return F.struct(text.alias("text"), items.alias("items"))


def from_view(rows: DataFrame, arrays=(), dates: dict[str, str] | None = None) -> DataFrame:
    """View rows as records: JSON lists become lists, blank text null, dates plain columns."""
    out = []
    for name, kind in rows.dtypes:
        if name.startswith("date:"):
            continue
        c = F.col(f"`{name}`")
        if name in arrays:
            c = text_list(c)
        elif kind == "string":
            c = F.when(text_or_null(c).isNotNull(), c)
        out.append(c.alias(name))
    for prop, target in (dates or {}).items():
        source = f"date:{prop}:start"
        c = F.col(f"`{source}`") if source in rows.columns else F.lit(None).cast("string")
        out.append(F.when(text_or_null(c).isNotNull(), c).alias(target))
    out += [F.array().cast("array<string>").alias(a) for a in arrays if a not in rows.columns]
    return rows.select(*out)


def side_table(spark, path: str, member: str) -> DataFrame:
    """A side table kept as one JSON document with a list of entries."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(member))
