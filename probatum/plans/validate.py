"""Run the rules over a snapshot, gate on the findings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.config import Settings
from probatum.operators.rules import ALL_RULES, FINDING, Rule, first_of_same
from probatum.operators.scale import cut_lineage
from probatum.plans.build import typed_collections
from probatum.operators import resolve

SEVERITY_ORDER = ["error", "warn", "info"]
NEEDS_PREVIOUS = "needs a previous snapshot"


class GateFailed(RuntimeError):
    """At least one finding is an error."""


@dataclass
class Result:
    """Findings, and the rules that could not run: silence is never a pass."""

    findings: DataFrame
    skipped: list[tuple[str, str]]


def snapshot_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A snapshot for the rules from raw collections: plain aliases, soft relations."""
    tables = typed_collections(raw, tagged_aliases=False)
    people = tables["people"].select("notionId", "slug", "name")
    index = people.select(F.col("notionId").alias("id"), "slug", "name").where("id IS NOT NULL")
    if "relationships" in tables:
        tables["relationships"] = resolve.resolve_endpoints(tables["relationships"], index).drop("fromId", "toId")
    if "events" in tables:
        # whether anybody is linked is all the rules ask; the links themselves are long
        refs = resolve.reference_rows(tables["events"], "peopleIds", "people", as_address=False)
        linked = (resolve.resolve_references(refs, index).where("slug IS NOT NULL")
                  .groupBy(F.col("owner").alias("slug")).agg(F.min("slug").alias("first")))
        events = tables["events"].join(linked, "slug", "left")
        tables["events"] = events.withColumn("people", F.filter(F.array("first"), lambda p: p.isNotNull())).drop("first", "peopleIds")
    if "pages" in raw:
        tables["pages"] = raw["pages"]
    if "property_types" in raw:
        tables["property_types"] = raw["property_types"]
    return tables


def _broken(spark, rule: Rule, error: Exception) -> DataFrame:
    text = str(error)
    return spark.createDataFrame([(rule.id, "error", None, None, None, f"Rule {rule.id} ({rule.title}) failed: {text.splitlines()[0] if text else type(error).__name__}",
                                   f"a fault of the rule, not of the records: {text}")], FINDING)


def run_rules(snapshot, settings: Settings, previous=None, only: list[str] | None = None, rules=ALL_RULES,
              staging: str | None = None, plan_only: bool = False) -> Result:
    """Findings of all selected rules.

    Each rule is executed by itself, into the session's checkpoint folder or into the shared
    folder ``staging``, so that a rule that fails takes no other down: its fault becomes an
    error finding.  With ``plan_only`` nothing runs yet, and only rules that cannot be
    planned are caught.
    """
    spark = snapshot["people"].sparkSession
    parts, skipped = [], []
    for rule in rules:
        if only and rule.id not in only:
            continue
        if rule.requires_diff and previous is None:
            skipped.append((rule.id, NEEDS_PREVIOUS))
            continue
        try:
            found = rule.run(snapshot, settings, previous)
            if staging:
                found.write.mode("overwrite").parquet(f"{staging}/rule={rule.id}")
                found = spark.read.schema(FINDING).parquet(f"{staging}/rule={rule.id}")
            elif not plan_only:
                found = cut_lineage(found)
        except Exception as error:  # noqa: BLE001  any fault of a rule is reported, not raised
            found = _broken(spark, rule, error)
        parts.append(found)
    empty = spark.createDataFrame([], FINDING)
    return Result(reduce(DataFrame.unionByName, parts, empty), skipped)


def severity_rank(column: str = "severity"):
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col(column))


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(), "rule", F.coalesce("slug", F.lit("")), "message")


def dedup_findings(findings: DataFrame) -> DataFrame:
    """Of findings with the same rule and message the first by record and field."""
    return first_of_same(findings)


def counts_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def assert_gate(findings: DataFrame, exit_zero: bool = False) -> int:
    """The number of errors; raises when there are any, unless told to forgive them."""
    errors = findings.agg(F.count_if(F.col("severity") == "error")).first()[0]
    if errors and not exit_zero:
        raise GateFailed(f"{errors} finding(s) of severity error")
    return errors


def stale(snapshot, settings: Settings, days: int) -> DataFrame:
    """Records not reviewed for ``days``; full dossiers get two thirds of it."""
    return run_rules(snapshot, settings.staleness(days), only=["R10"]).findings
