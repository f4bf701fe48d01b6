"""Counts: zero-filled tallies, health of a collection, groups and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions.clean import ladder_rank
from probatum.functions.text import java_pattern

NOT_RECORDED = "(not recorded)"


def tallies(df: DataFrame, dimensions: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``(dimension, value, n)`` of several columns in one pass.

    Each vocabulary value is present, with 0 where nothing has it; a value off the
    vocabulary has a row of its own, and nulls are counted apart when there are any.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(c), F.lit(NOT_RECORDED)).alias("value"))
        for d, (c, _) in dimensions.items()])).alias("cell")
    counted = df.select(cells).groupBy("cell.dimension", "cell.value").agg(F.count(F.lit(1)).alias("n"))
    rows = [(d, v, 0) for d, (_, vocabulary) in dimensions.items() for v in vocabulary]
    zeros = df.sparkSession.createDataFrame(rows, "dimension string, value string, n bigint")
    return counted.unionByName(zeros).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def counts(frames: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)`` per table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in frames.items()])


def grouped(df: DataFrame, by: str, default: str = "Not recorded", **measures: Column) -> DataFrame:
    """Rows per value of a column, null under a label of its own, with further counts."""
    return df.groupBy(F.coalesce(F.col(by), F.lit(default)).alias(by)).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in measures.items()])


def by_country(archives: DataFrame) -> DataFrame:
    """Holdings per country, those with decisive holdings first."""
    return (archives.groupBy("country")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") == "1 - decisive").alias("decisive"))
            .orderBy(F.desc("decisive"), F.desc("n"), "country"))


def by_vocabulary_order(df: DataFrame, by: str, order: list[str], other: str) -> DataFrame:
    """Rows per value in the vocabulary's order; anything else falls in one last group."""
    known = F.when(F.col(by).isin(order), F.col(by)).otherwise(F.lit(other))
    place = F.coalesce(ladder_rank(F.col("value"), order), F.lit(len(order)))
    return (df.groupBy(known.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("place", place).orderBy("place"))


def with_share(df: DataFrame, n: str = "n") -> DataFrame:
    """Add the rounded percent of the total, 0 when there is nothing."""
    total = df.agg(F.sum(n)).scalar()
    share = F.when(total > 0, F.floor(100 * F.col(n) / total + 0.5)).otherwise(0).cast("bigint")
    return df.withColumn("percent", share)


def health(snapshot, as_of, stale_days: int = 90) -> DataFrame:
    """``(dimension, value, n)``: counts only, never a score."""
    people, sources, archives = snapshot["people"], snapshot["sources"], snapshot["archives"]
    title = lambda name: name.capitalize()
    sizes = counts({title(n): snapshot[n] for n in (
        "people", "events", "sources", "archives", "relationships", "places", "groups", "pages")
        if snapshot.get(n) is not None}).select(F.lit("counts").alias("dimension"), F.col("name").alias("value"), "n")
    written = F.coalesce("assessment", F.lit("")) != ""
    falsifier = F.regexp_like("assessment", F.lit(java_pattern(fixed.HEALTH_FALSIFIER, ignore_case=True)))
    stale = F.datediff(F.lit(as_of), F.try_to_date(F.substring("lastReviewed", 1, 10))) > stale_days
    cells = [("impact", "rated", F.coalesce("impact", F.lit("")) != ""), ("impact", "total", F.lit(True)),
             ("assessments", "written", written), ("assessments", "total", F.lit(True)),
             ("assessments", "withFalsifier", written & falsifier), ("stale", "stale", stale)]
    marks = people.agg(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"),
                                          F.count_if(c).alias("n")) for d, v, c in cells]).alias("cells"))
    marks = marks.select(F.inline("cells"))
    parts = [sizes,
             tallies(people, {"dossierStatus": ("dossierStatus", fixed.DOSSIER_STATUS),
                              "evidenceBase": ("evidenceBase", fixed.EVIDENCE_BASE),
                              "impactByValue": ("impact", fixed.IMPACT)}),
             tallies(sources, {"sourceVerification": ("verification", fixed.SOURCE_VERIFICATION),
                               "tiers": ("tier", fixed.TIERS)}),
             tallies(archives, {"archiveVerification": ("verification", fixed.ARCHIVE_VERIFICATION)}),
             marks]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ facets and lists
def facet_filter(df: DataFrame, chosen: dict[str, str], text: str = "", blob: str = "search") -> DataFrame:
    """Rows that match every chosen facet and contain the free text.

    A list column matches on a whole member; an empty choice matches all rows.
    """
    types = dict(df.dtypes)
    for column, value in chosen.items():
        if value:
            df = df.where(F.array_contains(column, value) if types[column].startswith("array")
                          else F.col(column) == value)
    query = text.strip().lower()
    return df.where(F.contains(F.col(blob), F.lit(query))) if query else df


def facet_values(df: DataFrame, columns: list[str], default: str = "Not recorded") -> DataFrame:
    """``(facet, value, n)``: distinct values of each facet, list members apart."""
    types = dict(df.dtypes)
    member = lambda c: (F.transform(c, lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))
                        if types[c].startswith("array") else
                        F.array(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit(default)).alias("value"))))
    cells = df.select(F.explode(F.concat(*[member(c) for c in columns])).alias("cell"))
    return cells.groupBy("cell.facet", "cell.value").agg(F.count(F.lit(1)).alias("n"))


def ladder_order(column: str, ladder: list[str], *then: str | Column, unknown_first: bool = False) -> list[Column]:
    """The order by a vocabulary's order, then by further columns."""
    place = F.coalesce(ladder_rank(F.col(column), ladder), F.lit(-1 if unknown_first else len(ladder)))
    return [place, *[F.col(c) if isinstance(c, str) else c for c in then]]


def people_order() -> list[Column]:
    """The order of the people list; without a known year of birth they come after their status's others."""
    return ladder_order("dossierStatus", fixed.DOSSIER_STATUS, F.coalesce("_derivedBornYear", F.lit(9999)), "name", "slug", unknown_first=True)


def index_figures(disputes: DataFrame, archives: DataFrame, people: DataFrame, claims: DataFrame,
                  home_country: str | None = None) -> DataFrame:
    """The headline counts of the front page, one row."""
    from probatum.functions.clean import has_verbatim
    one = lambda df, **cells: df.agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    decisive = F.col("priority") == "1 - decisive"
    parts = [one(disputes, resolved=F.col("status") == "Resolved", live=~F.col("status").eqNullSafe(F.lit("Resolved"))),
             one(archives, decisive=decisive, decisiveAtHome=decisive & F.col("country").eqNullSafe(F.lit(home_country)),
                 unverified=F.col("verification") == fixed.NOT_YET_VERIFIED, withPlan=F.col("notYetSearched").isNotNull()),
             one(people, fullDossiers=F.col("dossierStatus") == "Full dossier"),
             one(claims, consulted=has_verbatim(F.col("whatTheDocumentSays")))]
    cells = [p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in p.columns])).alias("x"))
             .select("x.*") for p in parts]
    return reduce(DataFrame.unionByName, cells)


def home_authored(sources: DataFrame, language: str, tiers: list[str], above: int = 0) -> DataFrame:
    """Sources in a language and of the tiers written at home; ``drifted`` once more than ``above`` exist."""
    found = sources.where(F.array_contains("language", language) & F.col("tier").isin(list(tiers)))
    return found.withColumn("drifted", found.agg(F.count(F.lit(1))).scalar() > above)


def headings(documents: DataFrame, slug: str = "slug", body: str = "body") -> DataFrame:
    """Contents list of each document: ``(slug, line_no, depth, title)``, fences skipped."""
    from pyspark.sql import Window
    from probatum.functions.text import heading
    lines = documents.select(F.col(slug).alias("slug"), F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))
    fence = F.regexp_like("line", F.lit("^```"))
    lines = lines.where(fence | F.regexp_like("line", F.lit(r"^#{2,3}\s+")))
    above = Window.partitionBy("slug").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("inside", F.coalesce(F.sum(fence.cast("int")).over(above), F.lit(0)) % 2 == 1)
    depth, title = heading(F.col("line"))
    return lines.where(~fence & ~F.col("inside")).select("slug", "line_no", depth.alias("depth"), title.alias("title"))
