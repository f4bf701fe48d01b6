"""Reports as frames of lines: they stay distributed however many findings there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.operators.scale import cut_lineage
from probatum.plans.compare import Comparison
from probatum.plans.validate import Result, counts_by_rule, severity_rank

SHOWN_SUSPICIONS = 20
SHOWN_ADDITIONS = 40
_HEADINGS = [("Errors", "error"), ("Warnings", "warn"), ("Notes", "info")]
_LINE = "section int, rank int, rule string, slug string, line string"


def _computed(result: Result, comparison: Comparison | None) -> tuple[Result, Comparison | None]:
    """Findings and changes computed once: each section of a report reads them again."""
    once = Result(cut_lineage(result.findings), result.skipped)
    return once, comparison and Comparison(cut_lineage(comparison.changes), cut_lineage(comparison.suspicious))


def _where() -> Column:
    return F.concat_ws(" / ", "collection", "slug", "field")


def finding_line() -> Column:
    """One markdown list item per finding, with its place and detail under it."""
    head = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** `"), "rule", F.lit("` "), "message")
    place = F.when(_where() != "", F.concat(F.lit("\n  - `"), _where(), F.lit("`")))
    details = F.transform(F.filter(F.split(F.coalesce("detail", F.lit("")), "\n"), lambda l: F.trim(l) != ""),
                          lambda l: F.concat(F.lit("\n  - "), F.trim(l)))
    return F.concat(head, F.coalesce(place, F.lit("")), F.array_join(details, ""))


def _fixed(spark, rows) -> DataFrame:
    return spark.createDataFrame([(s, r, "", "", text) for s, r, text in rows], _LINE)


def _none_if_empty(rows: DataFrame, section: int) -> DataFrame:
    """``_None._`` for a section without findings."""
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(section).alias("section"), F.lit(1).alias("rank"), F.lit("").alias("rule"), F.lit("").alias("slug"),
        F.lit("_None._").alias("line"))


def markdown(result: Result, health: DataFrame, taken_at: str, origin: str, comparison: Comparison | None = None) -> DataFrame:
    """The report in order: ``(section, rank, rule, slug, line)``.

    Suspicious changes come first; a section without content says so.
    """
    spark = result.findings.sparkSession
    result, comparison = _computed(result, comparison)
    rows = lambda df, section: df.select(F.lit(section).alias("section"), F.lit(1).alias("rank"), "rule",
                                         F.coalesce("slug", F.lit("")).alias("slug"), finding_line().alias("line"))
    parts = [_fixed(spark, [(0, 0, f"# Integrity report — {taken_at[:10]}"), (0, 1, f"Snapshot of {taken_at[:10]} (origin: {origin})."),
                            (1, 0, "## Suspicious changes since last run")])]
    if comparison is None:
        parts.append(_fixed(spark, [(1, 1, "_No comparison run._")]))
    else:
        parts += [rows(comparison.suspicious, 1), _none_if_empty(comparison.suspicious, 1)]
    for i, (heading, severity) in enumerate(_HEADINGS, start=2):
        group = result.findings.where(F.col("severity") == severity)
        parts += [_fixed(spark, [(i, 0, f"## {heading}")]), rows(group, i), _none_if_empty(group, i)]
    if result.skipped:
        parts.append(_fixed(spark, [(5, 0, "## Not run")] + [(5, 1, f"- **{r}** — {why}") for r, why in result.skipped]))
    parts.append(_fixed(spark, [(6, 0, "## Corpus health"), (6, 9, "> Counts, never a percentage or a score.")]))
    parts.append(health.where("n > 0").select(
        F.lit(6).alias("section"), F.lit(1).alias("rank"), F.col("dimension").alias("rule"), F.col("value").alias("slug"),
        F.concat("dimension", F.lit(": "), "value", F.lit(" "), F.col("n").cast("string")).alias("line")))
    if comparison is not None:
        parts.append(_fixed(spark, [(7, 0, "## Change volume"), (7, 2, "New records:")]))
        parts.append(comparison.volume().select(
            F.lit(7).alias("section"), F.lit(1).alias("rank"), F.col("kind").alias("rule"), F.lit("").alias("slug"),
            F.concat(F.lit("- "), F.initcap("kind"), F.lit(": "), F.col("n").cast("string")).alias("line")))
        first = comparison.changes.where("kind = 'added'").orderBy("collection", "slug").limit(SHOWN_ADDITIONS)
        parts.append(first.select(F.lit(7).alias("section"), F.lit(3).alias("rank"), F.col("collection").alias("rule"),
                                  F.col("slug").cast("string").alias("slug"),
                                  F.concat(F.lit("- `"), "collection", F.lit("` "), "title").alias("line")))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return lines.orderBy("section", "rank", "rule", "slug", "line")


def json_lines(result: Result, health: DataFrame, taken_at: str, origin: str, comparison: Comparison | None = None) -> DataFrame:
    """The report as JSON lines: one head with the counts, then one line per finding."""
    spark = result.findings.sparkSession
    result, comparison = _computed(result, comparison)
    numbers = health.agg(F.sort_array(F.collect_list(F.struct("dimension", "value", "n"))).alias("health"))
    volume = (comparison.volume().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("changeVolume"))
              if comparison is not None else spark.createDataFrame([(None,)], "changeVolume map<string,bigint>"))
    per_rule = counts_by_rule(result.findings).agg(F.sort_array(F.collect_list(F.struct("rule", "severity", "n"))).alias("counts"))
    skipped = F.array(*[F.struct(F.lit(r).alias("id"), F.lit(why).alias("why")) for r, why in result.skipped])
    # three one-row aggregates
    head = per_rule.select(F.to_json(F.struct(
        F.lit(taken_at).alias("takenAt"), F.lit(origin).alias("origin"), "counts", skipped.alias("skipped"),
        volume.scalar().alias("changeVolume"), numbers.scalar().alias("health")), {"ignoreNullFields": "false"}).alias("json"))
    rows = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), "rule", "severity", "collection", "slug", "field",
                                                         "message", "detail")).alias("json"))
    out = head.select(F.lit(0).alias("part"), "json").unionByName(rows(result.findings, "finding").select(F.lit(2).alias("part"), "json"))
    if comparison is not None:
        out = out.unionByName(rows(comparison.suspicious, "suspicious").select(F.lit(1).alias("part"), "json"))
    return out


def headline_suspicions(comparison: Comparison) -> DataFrame:
    """The first suspicious changes a daily reader should see."""
    return comparison.suspicious.orderBy(severity_rank(), "collection", F.coalesce("slug", F.lit("")), "message").limit(SHOWN_SUSPICIONS)
