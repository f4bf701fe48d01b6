"""Record-level rules over arriving records.

The rules that look at one record at a time keep no state, so they run unchanged on a
streaming frame; rules that compare records run on snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from probatum.config import Settings
from probatum.operators import rules

RECORD_RULES = {"R01": rules.r01, "R06": rules.r06, "R07": rules.r07, "R10": rules.r10}


def validate_stream(people: DataFrame, settings: Settings, only=tuple(RECORD_RULES)) -> DataFrame:
    """Findings of the record-level rules on a stream of people records."""
    return rules.union([RECORD_RULES[r]({"people": people}, settings) for r in only])
