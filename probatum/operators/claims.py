"""Graded claims in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions.text import java_pattern, literal_pattern, looks_withheld, plain, strip, tokens_present

_FENCE = r"^```"
_HEADING = r"^#{2,4}\s+(.*)$"
_LEADS = "|".join(literal_pattern(t) for t, _, _ in sorted(fixed.LEAD_INS, key=lambda r: -len(r[0])))
_CLAIM = java_pattern(rf"^\*\*({_LEADS})\s*[.:]?\*\*\s*(.*)$", ignore_case=True)


def resolve_lead_in(lead: Column) -> Column:
    """``struct<canonical, status, withheld>`` of a lead-in, null if it is none."""
    key = F.lower(strip(F.regexp_replace(strip(lead), r"[.:]$", "")))
    table = F.create_map(*[x for text, status, withheld in fixed.LEAD_INS for x in (
        F.lit(text.lower()),
        F.struct(F.lit(text).alias("canonical"), F.lit(status).cast("string").alias("status"),
                 F.lit(withheld).alias("withheld")))])
    return F.element_at(table, key)


def marker_lines(documents: DataFrame, slug: str = "slug", body: str = "body", more: tuple[str, ...] = ()) -> DataFrame:
    """The lines that matter to claims: fences, headings and lead-ins, with the columns in ``more``.

    All other lines are dropped before anything is shuffled.
    """
    lines = documents.select(F.col(slug).alias("slug"), *more, F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))
    opened = strip(F.regexp_replace("line", r"^\s*[-*]\s+", ""))
    lines = lines.withColumn("fence", F.regexp_like("line", F.lit(_FENCE))).withColumn(
        "heading", F.regexp_like("line", F.lit(_HEADING))).withColumn("opened", opened)
    return lines.where(F.col("fence") | F.col("heading") | F.regexp_like("opened", F.lit(_CLAIM)))


def _resolved(lines: DataFrame) -> DataFrame:
    """Marker lines with their title, or the lead-in and text of their claim."""
    return (lines.withColumn("title", F.when(F.col("heading"), plain(F.regexp_extract("line", _HEADING, 1))))
            .withColumn("resolved", resolve_lead_in(F.regexp_extract("opened", _CLAIM, 1)))
            .withColumn("text", plain(F.regexp_extract("opened", _CLAIM, 2))))


_IS_CLAIM = "NOT heading AND resolved IS NOT NULL AND text <> ''"


def _claim_rows(claims: DataFrame) -> DataFrame:
    """The columns of claims from ``slug, n, section, resolved, text``."""
    n = F.col("n").cast("string")
    return claims.select(
        F.concat_ws("-", "slug", n).alias("id"), F.concat(F.lit("claim-"), n).alias("anchor"),
        F.col("slug").alias("hostSlug"), "section", F.col("resolved.canonical").alias("leadIn"),
        F.col("resolved.status").alias("status"),
        (F.col("resolved.withheld") | looks_withheld(F.col("text"))).alias("withheld"),
        tokens_present(F.col("text"), fixed.TIERS).alias("tiers"),
        F.contains("text", F.lit(fixed.NOT_YET_VERIFIED)).alias("unverifiedRef"), "text")


def extract_claims(documents: DataFrame, slug: str = "slug", body: str = "body") -> DataFrame:
    """One row per graded claim: index, section, lead-in, status, flags and text.

    Lines in code fences are skipped, the last heading above a claim is its section,
    and a claim's index counts the claims of its document from 0.
    """
    by_line = Window.partitionBy("slug").orderBy("line_no")
    above = by_line.rowsBetween(Window.unboundedPreceding, -1)
    lines = marker_lines(documents, slug, body)
    fences = F.coalesce(F.sum(F.col("fence").cast("int")).over(above), F.lit(0))
    # the two filters run in order: headings inside fences must not carry forward
    lines = _resolved(lines.withColumn("in_fence", fences % 2 == 1).where("NOT fence AND NOT in_fence"))
    section = F.last("title", ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("section", section).where(_IS_CLAIM)
    return _claim_rows(lines.withColumn("n", F.row_number().over(by_line) - 1))


def page_states(lines: DataFrame) -> DataFrame:
    """What stands before each page: ``(slug, page, open, section, claims)``.

    Every page yields its fences and, for either case of a fence being open where it
    starts, its last heading and its number of claims (``lines`` carry ``odd``: an odd
    number of the page's own fences stand above).  Which case holds follows from the fences
    of the pages before; a page is one row in this scan, whatever it holds.
    """
    def case(parity: int) -> list[Column]:
        here = (F.col("odd") == parity) & ~F.col("fence")
        title = here & F.col("heading")
        return [F.max_by(F.when(title, F.col("title")), F.when(title, F.col("line_no"))).alias(f"title{parity}"),
                F.count_if(here & F.expr(_IS_CLAIM)).alias(f"claims{parity}")]

    pages = lines.groupBy("slug", "page").agg(F.count_if("fence").alias("fences"), *case(0), *case(1))
    before = Window.partitionBy("slug").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("open", F.coalesce(F.sum("fences").over(before), F.lit(0)) % 2)
    # lines with an even number of fences above them count where none is open, those with an odd number where one is
    told = lambda name: F.when(F.col("open") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    return pages.select("slug", "page", "open", F.last(told("title"), ignorenulls=True).over(before).alias("before"),
                        F.coalesce(F.sum(told("claims")).over(before), F.lit(0)).alias("claims"))


def extract_paged_claims(pages: DataFrame, slug: str = "slug", page: str = "page", body: str = "body") -> DataFrame:
    """``extract_claims`` of documents that go on over several pages, as if each were one text.

    ``pages`` holds a row per page; a page ends where a line ends.  Open fences, sections
    and the count of claims are carried from page to page (see ``page_states``); no
    document is put together.
    """
    lines = _resolved(marker_lines(pages.withColumn("page", F.col(page)), slug, body, ("page",)))
    by_line = Window.partitionBy("slug", "page").orderBy("line_no")
    above = by_line.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("odd", F.coalesce(F.sum(F.col("fence").cast("int")).over(above), F.lit(0)) % 2)
    lines = lines.join(page_states(lines), ["slug", "page"]).where("NOT fence AND odd = open")
    section = F.last("title", ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("section", F.coalesce(section, "before")).where(_IS_CLAIM)
    return _claim_rows(lines.withColumn("n", F.col("claims") + F.row_number().over(by_line) - 1))


def with_host(claims: DataFrame, hosts: DataFrame, people: DataFrame) -> DataFrame:
    """Add the host's title, kind, address and, for a person, first phase.

    ``hosts`` holds ``(slug, title, kind, url)``.
    """
    first = people.select(F.col("slug").alias("hostSlug"), F.get("phase", F.lit(0)).alias("phase"))
    named = hosts.select(F.col("slug").alias("hostSlug"), F.col("title").alias("host"),
                         F.col("kind").alias("hostKind"), F.col("url").alias("_url"))
    return (claims.join(named, "hostSlug", "left").join(first, "hostSlug", "left")
            .withColumn("url", F.concat("_url", F.lit("#"), "anchor")).drop("_url"))


def status_counts(claims: DataFrame, by_host: bool = False) -> DataFrame:
    """Claims per status; ungraded is its own value, withheld overlaps all of them."""
    keys = ["hostSlug"] if by_host else []
    status = F.coalesce("status", F.lit("Ungraded")).alias("status")
    return claims.groupBy(*keys, status).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("withheld").alias("withheld"))


WITHHELD, UNGRADED = "withheld", "Ungraded"


def filter_claims(claims: DataFrame, status: str | None = None, phase: str | None = None, host: str | None = None) -> DataFrame:
    """Claims of a status, a phase and a host kind; an empty or missing choice lets all pass.

    Next to the statuses, ``Ungraded`` stands for claims without one and ``withheld`` for
    withheld claims of any status.
    """
    out = claims
    if status == WITHHELD:
        out = out.where("withheld")
    elif status:
        out = out.where(F.coalesce("status", F.lit(UNGRADED)) == status)
    for column, wanted in (("phase", phase), ("hostKind", host)):
        if wanted:
            out = out.where(F.col(column) == wanted)
    return out
