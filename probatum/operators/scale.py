"""Joins, ordinals and lists that stay balanced when one key holds much of the data."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 2_000_000
SALTS = 32
#: hashed groups of keys that rows are counted in, before single keys are
BUCKETS = 4096


def planned_bytes(df: DataFrame) -> int:
    """The size the optimizer plans with; joins and aggregates are estimated upwards."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return planned_bytes(df) <= limit


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute a frame once, for several uses, in the session's checkpoint folder.

    The folder is the one named in ``spark.checkpoint.dir``.  Only a local session may
    do without; a cluster needs a folder that all machines share.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def shuffle_tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for shuffles whose few bytes are much work: given as a number, they are not merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                limit: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS,
                salts: int = SALTS) -> DataFrame:
    """Join many rows to a table that is unique on ``on``.

    A right side of checked small size is broadcast.  Beyond it, keys with more than
    ``hot_rows`` left rows are spread over ``salts`` partitions and their right rows
    repeated as often; all other keys join as they are.  Rows are counted by hashed groups of
    keys, and by key only in groups that hold so many, so that counting shuffles next to nothing.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), on, how)
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(BUCKETS)).alias("_bucket")
    full = left.groupBy(bucket).count().where(F.col("count") > hot_rows).select("_bucket")
    hot = (left.select(*on, bucket).join(F.broadcast(full), "_bucket", "left_semi")
           .groupBy(*on).count().where(F.col("count") > hot_rows)
           .select(*on, F.lit(True).alias("_hot")))
    # there are at most (left rows / hot_rows) hot keys
    hot = F.broadcast(hot)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    left = left.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(row, F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    right = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def paired(left: DataFrame, right: DataFrame, on: list[str], salts: int = SALTS, lists: int = 64) -> DataFrame:
    """Inner join where both sides may hold many rows of a key, so that most of the result is pairs.

    Rows of the right go into lists per key, repeated for each salt; rows of the left are dealt
    to the salts.  A key's pairs are made in many tasks and are never shuffled.  Keys are not null.
    """
    other = [c for c in right.columns if c not in on]
    deal = lambda df, n: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(n)).cast("int")
    listed = (right.groupBy(*on, deal(right, lists).alias("_list")).agg(F.collect_list(F.struct(*other)).alias("_other")).drop("_list")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    # a merge join, so that the left side is dealt out whatever its size; a fixed number of tasks, since few bytes make many pairs
    spread = lambda df: df.repartition(shuffle_tasks(left), *on, "_salt")
    dealt = spread(left.withColumn("_salt", deal(left, salts))).hint("merge")
    return dealt.join(spread(listed), [*on, "_salt"]).select(*left.columns, F.inline("_other"))


def ordinal_within(df: DataFrame, keys: list[str], order: str, name: str = "ordinal",
                   ties: tuple[str, ...] = ()) -> DataFrame:
    """``row_number`` per key without putting a whole key in one task.

    Rows are dealt out by ranges of (keys, order, ties) whose bounds Spark samples, so that
    ranges hold like numbers of rows however values and keys are spread.  They are numbered
    inside (range, key), and each range starts after the rows that the earlier ones hold.
    Nulls come first, as in a window.
    """
    ranged = cut_lineage(df.repartitionByRange(*[F.col(c) for c in (*keys, order, *ties)])
                         .withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*keys).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = Window.partitionBy("_range", *keys).orderBy(order, *ties)
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    # null-safe, so that a null key keeps its rows
    joined = numbered.alias("n").join(
        starts.alias("s"),
        _all([F.col("n._range") == F.col("s._range"), *[F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]]), "inner")
    return joined.select(*[F.col(f"n.{c}") for c in df.columns],
                         (F.col("s._start") + F.col("n._local")).alias(name))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Every row with its place in one order over the whole frame, from 1."""
    columns = [f"_order{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, columns)])
    return ordinal_within(keyed, [], columns[0], name, tuple(columns[1:])).drop(*columns)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def list_pages(df: DataFrame, keys: list[str], order: str, value: str | Column,
               ties: tuple[str, ...] = (), page_size: int = 10_000,
               name: str = "items") -> DataFrame:
    """Ordered lists per key in pages: ``(keys…, page, items)``, page 0 first.

    A key with up to ``page_size`` members is one row; a larger one goes on over
    further pages, so no list grows without bound and no member is left out.
    """
    value = F.col(value) if isinstance(value, str) else value
    numbered = ordinal_within(df.withColumn("_value", value), keys, order, "_ordinal", ties)
    numbered = numbered.withColumn("page", F.floor((F.col("_ordinal") - 1) / page_size).cast("bigint"))
    entries = F.sort_array(F.collect_list(F.struct("_ordinal", "_value")))
    return numbered.groupBy(*keys, "page").agg(
        F.transform(entries, lambda e: e["_value"]).alias(name))


# ------------------------------------------------------------------ containment
_GRAM = 8
#: a word in more texts than this is looked up together with a second word of its pattern
FREQUENT = 1000


def _split(text: str | Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _words(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    return texts.select(F.col(text_id).alias("text_id"), F.explode(F.array_distinct(_split(text))).alias("word"))


def _asked(patterns: DataFrame, pattern_id: str, pattern: str) -> DataFrame:
    """``pattern_id, pattern, single, tokens``: what a text that holds the pattern must hold.

    A token that has others on both sides is a word of its own in the text (``=`` before
    it); a word ends with the first (``>``) and one starts with the last (``<``); a token
    alone may be anywhere in a word (``~``).  Two inner tokens are enough, so the outer
    ones are left out of longer patterns.
    """
    marked = lambda mark, t: F.concat(F.lit(mark), t)
    split = _split("pattern")
    inner = F.transform(F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))), lambda t: marked("=", t))
    ends = F.when(F.size(split) > 1, F.array(marked(">", F.get(split, F.lit(0))), marked("<", F.get(split, F.size(split) - 1)))).otherwise(
        F.transform(split, lambda t: marked("~", t)))
    single = ~F.regexp_like("pattern", F.lit(r"\s"))
    return (patterns.select(F.col(pattern_id).alias("pattern_id"), F.col(pattern).alias("pattern"))
            .where(F.col("pattern").isNotNull() & (F.size(split) > 0)).select(
                "*", single.alias("single"), F.array_distinct(F.when(F.size(inner) > 1, inner).otherwise(F.concat(inner, ends))).alias("tokens")))


def _matches(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, word, df)`` where the word is, or holds in the right place, what the token asks for; ``df`` texts hold the word."""
    asked = tokens.select("token", F.left("token", F.lit(1)).alias("mark"), F.expr("substring(token, 2)").alias("part"))
    whole = asked.where("mark = '='").join(vocabulary, F.col("part") == F.col("word")).select("token", "word", "df")
    head = F.when(F.col("mark") == ">", F.right("part", F.lit(_GRAM))).otherwise(F.left("part", F.lit(_GRAM)))
    heads = asked.where("mark <> '='").withColumn("piece", head)
    # only pieces as long as some token's: at most _GRAM lengths of each kind
    lengths = heads.select("mark", F.length("piece").alias("n")).distinct()
    sized = vocabulary.select("word", "df", F.explode(F.sequence(F.lit(1), F.least(F.lit(_GRAM), F.length("word")))).alias("n"))
    sized = sized.join(F.broadcast(lengths), "n")
    starts = F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)
    pieces = (F.when(F.col("mark") == "<", F.array(F.left("word", F.col("n")))).when(F.col("mark") == ">", F.array(F.right("word", F.col("n"))))
              .otherwise(F.array_distinct(F.transform(starts, lambda s: F.substring(F.col("word"), s, F.col("n"))))))
    grams = sized.select("word", "df", "mark", F.explode(pieces).alias("piece"))
    holds = (F.when(F.col("mark") == "<", F.startswith("word", F.col("part"))).when(F.col("mark") == ">", F.endswith("word", F.col("part")))
             .otherwise(F.contains("word", F.col("part"))))
    return whole.unionByName(grams.join(heads, ["mark", "piece"]).where(holds).select("token", "word", "df"))


def _anchored(asked: DataFrame, matches: DataFrame) -> DataFrame:
    """Patterns all of whose tokens are in some text, with the one or two that the fewest texts hold (``first``, ``second``)."""
    df = matches.groupBy("token").agg(F.sum("df").alias("df"))
    told = asked.select("pattern_id", "pattern", "single", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(df, "token")
    ranked = told.groupBy("pattern_id", "pattern", "single", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).where(F.size("t") == F.col("n"))
    return ranked.select("pattern_id", "pattern", "single", F.col("t")[0]["token"].alias("first"),
                         F.when((F.col("n") > 1) & (F.col("t")[0]["df"] > FREQUENT), F.get("t", F.lit(1))["token"]).alias("second"))


def _lookup(patterns: DataFrame, texts: DataFrame, pattern_id: str, pattern: str, text_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patterns with their anchors, the words that match these, and the words of all texts."""
    asked = cut_lineage(_asked(patterns, pattern_id, pattern))
    words = _words(texts, text_id, text)
    vocabulary = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    matches = cut_lineage(_matches(asked.select(F.explode("tokens").alias("token")).distinct(), vocabulary))
    anchored = cut_lineage(_anchored(asked, matches))
    needed = anchored.select(F.explode(F.array("first", "second")).alias("token")).where("token IS NOT NULL").distinct()
    return anchored, matches.join(needed, "token", "left_semi").select("token", "word"), words


def containment_candidates(anchored: DataFrame, hits: DataFrame, words: DataFrame) -> DataFrame:
    """``pattern_id, pattern, single, text_id``: texts that hold the anchors of a pattern.

    A rare anchor is enough; beside a frequent one the text must hold the pattern's second,
    so that patterns on one common word don't meet every text that holds it.
    """
    postings = words.join(hits, "word").select("token", "text_id").distinct()
    alone = anchored.where("second IS NULL").join(postings.withColumnRenamed("token", "first"), "first")
    both = anchored.where("second IS NOT NULL")
    wanted = both.select("first", "second").distinct()
    held = lambda c: postings.join(wanted.select(F.col(c).alias("token")).distinct(), "token", "left_semi").withColumnRenamed("token", c)
    pairs = held("first").join(held("second"), "text_id").join(wanted, ["first", "second"], "left_semi")
    out = ["pattern_id", "pattern", "single", "text_id"]
    return alone.select(*out).unionByName(both.join(pairs, ["first", "second"]).select(*out))


def containment_pairs(patterns: DataFrame, texts: DataFrame, pattern_id: str, pattern: str,
                      text_id: str, text: str) -> DataFrame:
    """All ``(pattern_id, text_id)`` where the text contains the pattern as a substring.

    No pair is tested that does not share the pattern's rarest word, and where that is
    frequent its second rarest too: these are looked up in the distinct words of the texts.
    Patterns without any word, null ones too, are left out.
    """
    anchored, hits, words = _lookup(patterns, texts, pattern_id, pattern, text_id, text)
    pairs = containment_candidates(anchored, hits, words)
    alone = pairs.where("single").select("pattern_id", "text_id")
    whole = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("_text"))
    checked = (pairs.where("NOT single").join(whole, "text_id")
               .where(F.contains("_text", F.col("pattern"))).select("pattern_id", "text_id"))
    return alone.unionByName(checked)


def contained_somewhere(patterns: DataFrame, texts: DataFrame, pattern_id: str, pattern: str,
                        text_id: str, text: str) -> DataFrame:
    """The ids of patterns that at least one text contains (see ``containment_pairs``)."""
    anchored, hits, words = _lookup(patterns, texts, pattern_id, pattern, text_id, text)
    # a single word is in a text if it is in a word: anchored at all
    alone = anchored.where("single").select("pattern_id")
    pairs = containment_candidates(anchored.where("NOT single"), hits, words)
    whole = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("_text"))
    checked = pairs.join(whole, "text_id").where(F.contains("_text", F.col("pattern"))).select("pattern_id").distinct()
    return alone.unionByName(checked)
