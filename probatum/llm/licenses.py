"""License scans by diagonal voting (DataFrame operations only).

Every rolling word k-gram of a text is looked up by hash among the k-grams of short
license templates.  A match votes for its diagonal, position in the text minus position in
the template; neighbouring diagonals (words put in or left out) are merged into spans, and a
span counts when the template words that its verified k-grams cover are a large enough share.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probatum.llm.shared import ascii_lower

#: words: letters and digits, everything beyond ASCII included
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: fixed values: phrases whose every place is reported, and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: templates (in words as above) and the labels that this operator adds
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("gpl-notice", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the "
                   "gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
GRAM, SLACK, GAP, COVERAGE = 3, 3, 8, 0.8
_SEED = 42


def gram_hash(words: list[str]) -> int:
    """What ``xxhash64`` gives for the words as columns: each word is hashed with the last hash as seed."""
    h = _SEED
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def template_grams(templates: list[tuple[str, str]], phrases: dict[str, str]) -> list[tuple]:
    """``(hash, gram, template, label, tpos, length, k, is_phrase)``; a phrase is one gram of its own length."""
    out = []
    for number, (label, text, whole) in enumerate([*((lab, t, False) for lab, t in templates), *((lab, p, True) for p, lab in phrases.items())]):
        words = text.split(" ")
        k = len(words) if whole else min(GRAM, len(words))
        for at in range(len(words) - k + 1):
            gram = words[at:at + k]
            out.append((gram_hash(gram), " ".join(gram), number, label, at, len(words), k, whole))
    return out


def _positions(spark: SparkSession, grams: list[tuple]) -> DataFrame:
    return spark.createDataFrame(grams, "hash bigint, gram string, template int, label string, tpos int, length int, k int, is_phrase boolean")


def matches(docs: DataFrame, doc_id: str, text: str, grams: list[tuple]) -> DataFrame:
    """One row per text that marks it (``pos`` null), and one per k-gram of it that a template has.

    The first word of a gram and its hash are tested inside the row, so that only hits leave
    it; the join to the template positions then verifies the words.  The positions are as many
    as the given templates have words and are broadcast.
    """
    firsts = sorted({g[1].split(" ")[0] for g in grams})
    by_k = {k: sorted({g[0] for g in grams if g[6] == k}) for k in sorted({g[6] for g in grams})}
    body = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"),
                        F.regexp_extract_all(ascii_lower(body), F.lit(LICENSE_WORD), F.lit(0)).alias("words"))

    def word(at: Column, ahead: int) -> Column:
        return F.get("words", at + ahead)

    def is_hit(at: Column) -> Column:
        found = F.lit(False)
        for k, hashes in by_k.items():
            found |= F.xxhash64(*[word(at, j) for j in range(k)]).isin(hashes)
        return word(at, 0).isin(firsts) & found

    def gram(at: Column, k: int) -> Column:
        # beyond the text's end a gram gets shorter and equals no template's gram of k words
        return F.struct(at.cast("int").alias("pos"), F.lit(k).alias("k"), F.concat_ws(" ", *[word(at, j) for j in range(k)]).alias("gram"),
                        F.xxhash64(*[word(at, j) for j in range(k)]).alias("hash"))

    nothing = F.array().cast("array<int>")
    places = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), is_hit)).otherwise(nothing)
    mark = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(0).alias("k"), F.lit("").alias("gram"), F.lit(0).cast("bigint").alias("hash")))
    hits = F.flatten(F.transform(places, lambda at: F.array(*[gram(at, k) for k in by_k])))
    rows = words.select("doc_id", "text_hash", F.size("words").cast("bigint").alias("n_words"), F.inline(F.concat(mark, hits)))
    known = _positions(docs.sparkSession, grams)
    return rows.join(F.broadcast(known), ["hash", "gram", "k"], "left").where("pos IS NULL OR template IS NOT NULL")


def spans(found: DataFrame) -> DataFrame:
    """Verified spans from ``matches``: ``doc_id, text_hash, n_words, copies, template, label, is_phrase, first, last, coverage``.

    Places of phrases stay apart.  A text has one further row without a template, whose
    ``copies`` counts the equal rows of the input.
    """
    text = ["doc_id", "text_hash", "n_words"]
    about = ["template", "label", "is_phrase", "length", "k"]
    votes = (found.withColumn("diagonal", F.col("pos") - F.col("tpos")).groupBy(*text, *about, "diagonal")
             .agg(F.count(F.lit(1)).alias("copies"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("tposs")))
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("lo", "diagonal")
    apart = (F.col("is_phrase") | (F.col("lo") > F.lag("hi").over(along) + F.col("k") + GAP)
             | (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > SLACK))
    numbered = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(along))
    covered = F.flatten(F.transform("tposs", lambda t: F.sequence(t, t + F.col("k") - 1)))
    return (numbered.withColumn("covered", covered).groupBy(*text, *about, "span")
            .agg(F.min("lo").alias("first"), (F.max("hi") + F.first("k") - 1).alias("last"), F.max("copies").alias("copies"),
                 (F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.col("length")).alias("coverage"))
            .where(F.col("template").isNull() | (F.col("coverage") >= COVERAGE)).drop("span", "k", "length"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start (null without any).  Labels are distinct, sorted and joined
    by commas, empty without any.  ``score`` is the largest share of a template that a span
    covers, 1 for a phrase, 0 without a span.  Null and empty texts have no words.  Equal
    rows are scanned as one and returned as often as they came; null ids are kept; an empty
    table gives no rows; further columns are not read.
    """
    grams = template_grams(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    found = spans(matches(docs, doc_id, text, grams))
    places = F.when(F.col("is_phrase"), F.col("first").cast("bigint"))

    def listed(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    by_text = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"), F.count(places).alias("n_base"),
        F.min(places).alias("first_word"), F.max(places).alias("last_word"),
        listed(F.when(F.col("is_phrase"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("coverage"))), F.lit(0.0)).alias("score"))
    return by_text.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                          F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")
