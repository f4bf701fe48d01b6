"""Markdown and HTML documents, and documents assembled from ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.functions.text import frontmatter_map, frontmatter_parts, strip, to_prose
from probatum.operators.scale import list_pages


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``(path, slug, front, body)`` of a tree of markdown files."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md*")
           .text(root, wholetext=True).withColumn("path", F.input_file_name()))
    front, body = frontmatter_parts(F.col("value"))
    fields = frontmatter_map(front)
    name = F.regexp_extract("path", r"([^/]+)\.mdx?$", 1)
    return raw.select("path", F.coalesce(F.element_at(fields, "slug"), name).alias("slug"), fields.alias("front"),
                      body.alias("body"))


def prose_bodies(documents: DataFrame) -> DataFrame:
    """``(slug, body)`` with component markup removed; blank bodies stay out."""
    return documents.select("slug", to_prose(F.col("body")).alias("body")).where("body <> ''")


def read_html(spark: SparkSession, root: str) -> DataFrame:
    """``(path, html)`` of all HTML files under a directory."""
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html")
            .text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html")))


def write_bodies(bodies: DataFrame, path: str) -> None:
    """Bodies with frontmatter, partitioned by collection; blank bodies are skipped.

    ``bodies`` holds ``(collection, slug, title, body)``.
    """
    text = F.concat(F.lit("---\nslug: "), F.to_json(F.array("slug")), F.lit("\ntitle: "), F.to_json(F.array("title")),
                    F.lit("\n---\n"), "body", F.lit("\n"))
    quoted = F.regexp_replace(F.regexp_replace(text, r"(?m)^(slug|title): \[(.*)\]$", "$1: $2"), "\u0000", "")
    (bodies.where(strip(F.coalesce("body", F.lit(""))) != "").select("collection", "slug", quoted.alias("text"))
     .write.mode("overwrite").partitionBy("collection").parquet(path))


# ------------------------------------------------------------------ blocks
RICH = "array<struct<plain_text:string,code:boolean,bold:boolean,italic:boolean,href:string>>"


def rich_text(runs: Column) -> Column:
    """Markdown of formatted runs: code wins over bold and italic, then links."""
    def run(r):
        text = F.coalesce(r["plain_text"], F.lit(""))
        bold = F.when(r["bold"], F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)
        both = F.when(r["italic"], F.concat(F.lit("*"), bold, F.lit("*"))).otherwise(bold)
        linked = F.when(r["href"].isNotNull(), F.concat(F.lit("["), both, F.lit("]("), r["href"], F.lit(")"))).otherwise(both)
        return F.when(r["code"], F.concat(F.lit("`"), text, F.lit("`"))).otherwise(linked)

    return F.array_join(F.transform(runs, run), "")


def render_block(kind: Column, text: Column, depth: Column | None = None) -> Column:
    """Markdown of one block; null for an empty paragraph or an unknown kind."""
    indent = F.repeat(F.lit("  "), F.lit(0) if depth is None else depth)
    prefixed = lambda p: F.concat(F.lit(p), text)
    return (F.when(kind == "heading_1", prefixed("# ")).when(kind == "heading_2", prefixed("## "))
            .when(kind == "heading_3", prefixed("### "))
            .when(kind == "paragraph", F.when(strip(text) != "", text))
            .when(kind == "bulleted_list_item", F.concat(indent, F.lit("- "), text))
            .when(kind == "numbered_list_item", F.concat(indent, F.lit("1. "), text))
            .when(kind.isin("quote", "callout"), prefixed("> "))
            .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
            .when(kind == "divider", F.lit("---")))


def table_row(cells: Column, width: Column | None = None) -> Column:
    """One markdown table row, bars escaped and short rows padded to ``width``."""
    cells = F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")))
    if width is not None:
        cells = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int")))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def assemble(rows: DataFrame, keys: list[str], order: str, text: str | Column, glue: str = "\n\n",
             page_size: int = 10_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """Join the texts of each document in order: ``(keys…, page, body)``.

    A document of more than ``page_size`` rows goes on over further pages, whose state is
    carried by ``operators.claims.extract_paged_claims``.
    """
    pages = list_pages(rows.withColumn("_text", F.col(text) if isinstance(text, str) else text)
                       .where("_text IS NOT NULL"), keys, order, "_text", ties=ties, page_size=page_size)
    return pages.select(*keys, "page", F.array_join("items", glue).alias("body"))
