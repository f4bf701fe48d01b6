"""Checks on balanced elements of HTML pages."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions.text import strip_tags

# executors get these functions with the task, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

class _Marked(HTMLParser):
    """Collects the source of marked elements in one pass over a page.

    Open elements of the two kinds stand on a stack each; one that is never closed reaches
    to the end of the page, and an end tag without a start is passed over.
    """

    KINDS = ("div", "span")

    def __init__(self, page: str):
        super().__init__(convert_charrefs=False)
        self._page, self._lines = page, [0]
        for line in page.split("\n"):
            self._lines.append(self._lines[-1] + len(line) + 1)
        self._open: dict[str, list[int | None]] = {kind: [] for kind in self.KINDS}
        self._starts: list[int] = []
        self._ends: dict[int, int] = {}
        self.feed(page)
        self.close()

    def _here(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag in self._open:
            marked = ("data-verification", fixed.NOT_YET_VERIFIED) in attrs
            at = self._here() if marked else None
            self._open[tag].append(at)
            if marked:
                self._starts.append(at)

    def handle_startendtag(self, tag, attrs):  # a closing slash means nothing on these elements
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self._open.get(tag) and (start := self._open[tag].pop()) is not None:
            self._ends[start] = self._page.index(">", self._here()) + 1

    def sources(self) -> list[str]:
        return [self._page[start:self._ends.get(start, len(self._page))] for start in self._starts]


def marked_elements(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def elements(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: _Marked(page).sources())

    return elements(html)


def unverified_elements(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, element)``: elements marked unverified whose text lacks the words.

    Only pages with such a mark reach Python; ``element`` counts them from 1.
    """
    marked = pages.where(F.contains("html", F.lit('data-verification="NOT YET VERIFIED"')))
    each = marked.select(key, F.posexplode(marked_elements(F.col("html"))).alias("pos", "source"))
    silent = each.where(~F.contains(strip_tags(F.col("source")), F.lit(fixed.NOT_YET_VERIFIED)))
    return silent.select(key, (F.col("pos") + 1).cast("bigint").alias("element"))
