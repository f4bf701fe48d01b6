"""Search index and ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.functions.clean import place_line
from probatum.functions.names import fold
from probatum.functions.text import strip
from probatum.operators.scale import containment_pairs, cut_lineage, lookup_join

TOP = 60
#: up to so many queries are tested on every term, more are looked up by their words
FEW = 64


def _present(*columns) -> Column:
    return F.filter(F.array(*columns), lambda t: t.isNotNull() & (t != ""))


def _folded(terms: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(terms, fold), lambda t: t != ""))


def _names(title: str, aliases: Column) -> Column:
    return F.concat(F.array(title), F.transform(aliases, lambda a: a["value"]))


def build_index(people=None, events=None, sources=None, archives=None, places=None, groups=None) -> DataFrame:
    """One index over the record types: ``(type, slug, title, subtitle, phase, terms, folded)``.

    Notes among aliases are no names.  A reference number is a term but is not folded.
    """
    none = F.array().cast("array<string>")
    parts = []

    def add(df, kind, title, subtitle, terms, folded, phase=none):
        if df is not None:
            parts.append(df.select(F.lit(kind).alias("type"), "slug", F.col(title).alias("title"),
                                   subtitle.alias("subtitle"), phase.alias("phase"),
                                   terms.alias("terms"), folded.alias("folded")))

    real = F.filter(F.col("aliases"), lambda a: ~a["isNote"])
    add(people, "person", "name", F.col("oneLine"), _names("name", real), _folded(_names("name", real)), F.col("phase"))
    add(events, "event", "event", F.col("summary"), _present("event", "location"),
        _folded(_present("event", "location")), _present("phase"))
    add(sources, "source", "title", F.col("author"), _present("title", "author", "archivalReference"),
        _folded(_present("title", "author")))
    add(archives, "archive", "institution", place_line(F.col("city"), F.col("country")),
        _present("institution", "city", "country", "fonds"), _folded(_present("institution", "city", "country")))
    add(places, "place", "place", F.col("region"), _names("place", F.col("aliases")), _folded(_names("place", F.col("aliases"))))
    add(groups, "group", "group", F.col("type"), _names("group", F.col("aliases")), _folded(_names("group", F.col("aliases"))))
    return reduce(DataFrame.unionByName, parts)


def inverted(index: DataFrame) -> DataFrame:
    """``(type, slug, term, folded)``, one row per term; ``folded`` is null where not folded."""
    folded = index.select("type", "slug", F.explode("folded").alias("folded"))
    terms = index.select("type", "slug", F.explode("terms").alias("term"))
    return terms.unionByName(folded, allowMissingColumns=True)


def _looked_up(index: DataFrame, asked: DataFrame, value: Callable[..., Column], parts: dict) -> Callable[[str, str], DataFrame]:
    """Scores by way of the words of the distinct terms, for many queries."""
    # folded once; the vocabularies and both look-ups read it
    terms = cut_lineage(inverted(index))
    distinct = lambda c: terms.where(F.col(c).isNotNull()).select(F.col(c).alias("t")).distinct()

    def matches(pattern, kind):
        vocabulary = distinct(kind)
        patterns = asked.select(F.col(pattern).alias("p")).distinct()
        pairs = containment_pairs(patterns, vocabulary, "p", "p", "t", "t").select(
            F.col("pattern_id").alias("p"), F.col("text_id").alias("t"))
        return pairs.withColumn("score", value(F.col("t"), F.col("p"), *parts[kind]))

    def scored(pattern, kind):
        hits = matches(pattern, kind)
        found = terms.where(F.col(kind).isNotNull()).select("type", "slug", F.col(kind).alias("t"))
        by_record = found.join(hits, "t").select("type", "slug", F.col("p").alias(pattern), "score")
        return asked.select("qid", pattern).join(by_record, pattern).select("qid", "type", "slug", "score")
    return scored


def score_records(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, type, slug, score)`` for every record a query matches.

    ``queries`` holds ``(qid, raw)``.  A folded term scores 100 when equal, 70 as
    prefix, 45 as part; an unfolded term 100 when equal, 60 as part.
    """
    asked = queries.select("qid", strip(F.col("raw")).alias("raw"))
    asked = asked.where("raw <> ''").withColumn("q", F.coalesce(F.nullif(fold(F.col("raw")), F.lit("")), F.lower("raw")))
    value = lambda t, p, part, start: F.when(t == p, 100).when(F.startswith(t, p), start).otherwise(part)
    parts = {"folded": (45, 70), "term": (60, 60)}
    if asked.limit(FEW + 1).count() <= FEW:
        # each term is read once and meets every query where it is
        few, terms = F.broadcast(asked), inverted(index)

        def scored(pattern, kind):
            met = terms.where(F.col(kind).isNotNull()).join(few, F.contains(F.col(kind), F.col(pattern)))
            return met.select("qid", "type", "slug", value(F.col(kind), F.col(pattern), *parts[kind]).alias("score"))
    else:
        scored = _looked_up(index, asked, value, parts)

    both = scored("q", "folded").unionByName(scored("raw", "term"))
    return both.groupBy("qid", "type", "slug").agg(F.max("score").alias("score"))


def ranked(index: DataFrame, queries: DataFrame, types=None, phase: str | None = None, top: int = TOP) -> DataFrame:
    """The best ``top`` records per query, by score and title, with the term that matched."""
    if types:
        index = index.where(F.col("type").isin(list(types)))
    if phase:
        index = index.where(F.array_contains("phase", phase))
    scores = score_records(index, queries).join(
        index.select("type", "slug", "title", "terms"), ["type", "slug"])
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "title", "type", "slug")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    raw = strip(F.col("raw"))
    best = lookup_join(best, queries.select("qid", "raw"), ["qid"], "inner")
    best = best.withColumn("q", F.coalesce(F.nullif(fold(raw), F.lit("")), F.lower(raw)))
    hit = F.get(F.filter("terms", lambda t: F.contains(fold(t), F.col("q")) | F.contains(t, raw)), F.lit(0))
    return (best.withColumn("hit", hit)
            .withColumn("via", F.when(fold(F.col("hit")) != fold(F.col("title")), F.col("hit")))
            .select("qid", "rank", "type", "slug", "title", "score", "via"))


def best_match(index: DataFrame, queries: DataFrame, order: str = "ord") -> DataFrame:
    """The top record per query; ties keep index order."""
    scores = score_records(index, queries).join(index.select("type", "slug", order), ["type", "slug"])
    top = F.max_by(F.struct("type", "slug", "score"), F.struct(F.col("score"), -F.col(order)))
    return scores.groupBy("qid").agg(top.alias("top")).select("qid", "top.*")
