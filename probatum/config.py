"""Settings of a validation run: defaults, with a JSON override merged over them."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from datetime import date

from probatum import fixed


@dataclass(frozen=True)
class Settings:
    """Severities, thresholds and side tables of the rules.

    ``as_of`` stands in for the wall clock so that a run can be repeated.
    """

    as_of: date = field(default_factory=date.today)
    severities: dict = field(default_factory=lambda: dict(fixed.SEVERITIES))
    stale_days: int = 90
    stale_days_full: int = 60
    #: above 0.45: at that score or less every pair of names would be a candidate
    alias_threshold: float = 0.72
    #: a country that the vocabulary does not have
    home_country: str | None = None
    allowed_self_loops: tuple = tuple(fixed.ALLOWED_SELF_LOOPS)
    quantities: tuple = tuple(fixed.QUANTITIES)
    known_distinct: tuple = tuple(fixed.KNOWN_DISTINCT)
    never_merge: tuple = tuple(fixed.NEVER_MERGE)

    def __post_init__(self):
        if self.alias_threshold <= 0.45:
            raise ValueError("alias_threshold must be above 0.45")

    def severity(self, rule: str, default: str = "error") -> str:
        return self.severities.get(rule, default)

    def staleness(self, days: int) -> "Settings":
        """The stale report: one threshold, full dossiers get two thirds of it."""
        return dataclasses.replace(self, stale_days=days, stale_days_full=int(days * 0.67))


def load_settings(text: str | None = None, **overrides) -> Settings:
    """Merge a JSON document over the defaults; only ``severities`` merges by key."""
    base = Settings()
    given = json.loads(text) if text else {}
    if "severities" in given:
        given["severities"] = {**base.severities, **given["severities"]}
    if "as_of" in given:
        given["as_of"] = date.fromisoformat(given["as_of"])
    return dataclasses.replace(base, **{**given, **overrides})
