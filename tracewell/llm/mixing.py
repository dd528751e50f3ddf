"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

Every source has a weight and a tilt: its share of the words drawn at time t of training (0 to 1) follows
1 + tilt * (2t - 1), whose integral is its cumulative demand. A source's documents stand in an order of hashes; the place
of a document in the cumulative words of its source, pass after pass, is turned into a time by inverting that demand,
and documents are dealt to ranges of time and sorted there. Whole documents are drawn: all floor(target / size) times,
and those within the rest of the target once more, to the nearest document.

Cumulative words come from three levels of windows (within a bucket of about ROWS documents, a group of buckets, a source),
so that no window holds more than about the square root of a source's buckets, whatever share of all rows it has.

Defined results: null texts have size 0; a null source is a source of its own, the last; null ids are allowed and rows that
repeat are drawn each by itself; a source without words has target 0. Other columns pass through mixed() unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import tables

WEIGHTS = (5.0, 2.0, 1.0)
TILTS = (0.5, 0.0, -0.5)
MOST = 3.0
ROWS = 512

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, tilt) of each source in sized(source, size). One task ranks the sources (not their rows):
    16 million of them are about a gigabyte.

    Targets share all words by weight; one that would be over most times its source's size stops there and the excess is
    shared anew. That is min(cap, level * weight) for one level, found by one pass over the sources in order of cap / weight.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("n") % len(values) + 1).cast("int"))
    ranked = sources.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", cycle(weights).alias("weight"), cycle(tilts).alias("tilt"), (most * F.col("source_size")).alias("cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    stepped = ranked.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    shown = stepped.withColumn("level", F.max(free).over(everything))  # the first that fits: capping more lowers it
    return shown.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"), "tilt")


def plan(sized: DataFrame, n_rows: int, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """sized (row key columns, source, size) with source_size, target, copies and times array<double>, one for each copy.

    Every row needs a column "key" (string); the documents of a source are in order of the MD5 of key and seed, and buckets are
    ranges of it. Rows equal in key and size may swap.
    """
    buckets = max(1, -(-n_rows // ROWS))
    per_group = max(1, math.isqrt(buckets))
    hashed = sized.withColumn("hash", F.md5(F.concat("key", F.lit(f":{seed}"))))
    hashed = hashed.withColumn("bucket", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)))
    hashed = hashed.withColumn("group", F.floor(F.col("bucket") / per_group))
    hashed = hashed.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # joins by name, as null is a source
    inner = Window.partitionBy("name", "bucket").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hashed.withColumn("upto", F.sum("size").over(inner))

    sums = hashed.groupBy("name", "group", "bucket").agg(F.sum("size").alias("words"))
    in_group = Window.partitionBy("name", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("name").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("name", "group").agg(F.sum("words").alias("words")).select("name", "group", F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("group_at"))
    places = sums.withColumn("bucket_at", F.coalesce(F.sum("words").over(in_group), F.lit(0))).join(groups, ["name", "group"])
    goals = targets(sized, weights, tilts, most).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    places = places.join(goals, "name").select("name", "bucket", (F.col("bucket_at") + F.col("group_at")).alias("at"), "source_size", "target", "tilt")

    met = rows.join(places, ["name", "bucket"]).withColumn("before", F.col("at") + F.col("upto") - F.col("size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    met = met.withColumn("passes", F.floor(ratio)).withColumn("rest", (ratio - F.floor(ratio)) * F.col("source_size"))
    middle = F.col("before") + F.col("size") / 2
    met = met.withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.lit(math.floor(most)), F.col("passes") + F.when(middle <= F.col("rest"), 1).otherwise(0))).cast("int"))
    demand = lambda c: F.least(F.lit(1.0), (c * F.col("source_size") + middle) / F.greatest(F.col("target"), F.lit(1.0)))
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: when_drawn(demand(c), F.col("tilt")))
    return met.withColumn("times", F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")))


def when_drawn(u: Column, tilt: Column) -> Column:
    """The time at which the share u of a source's demand is met: the inverse of t + tilt * (t * t - t)."""
    b = 1 - tilt
    root = (F.sqrt(b * b + 4 * tilt * u) - b) / (2 * tilt)
    return F.when(F.abs(tilt) < 1e-9, u).otherwise(root)


def key_of(id_col: str, text_col: str) -> Column:
    """What a row's place depends on: its id, or its text where it has none, so that rows without ids lie in all buckets."""
    return F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, key, source, size), cut from the texts so that these are read once."""
    return tables.cut(docs.select(F.col(id_col).alias("id"), key_of(id_col, text_col).alias("key"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, most: float = MOST, bytes_per_range: int = 8 << 20) -> DataFrame:
    """The rows of docs in the order of training, each as often as the mix draws it.

    Ranges of time hold about as many words each, as times are shares of the words, so ranges need no sample of the rows.
    Rows are told apart by id, source and the text's hash, and those equal in all three by number. Rows without an id are
    in the order of their texts' hashes.
    """
    body, source = F.xxhash64(text_col), F.col(source_col).cast("string")
    sized = tables.cut(docs.select(F.col(id_col).alias("id"), key_of(id_col, text_col).alias("key"), source.alias("source"), body.alias("body"), n_words(F.col(text_col)).alias("size")))
    n = sized.count()
    total = sized.agg(F.sum("size")).first()[0] or 0
    same = ["id", "source", "body"]
    # the rows ride in a struct, so that no column of theirs can be taken for one of the plan's
    docs_, number = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.col(id_col).alias("__own"), source.alias("__source"), body.alias("__body")), F.lit(1)
    if sized.groupBy(*same).count().filter("count > 1").limit(1).count():
        sized = tables.cut(sized.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("key"))))
        number = F.row_number().over(Window.partitionBy("__own", "__source", "__body").orderBy("__body"))
    else:
        sized = sized.withColumn("nth", F.lit(1))
    drawn = plan(sized, n, weights, tilts, most).filter(F.col("copies") > 0).select(F.col("id").alias("__id"), F.col("source").alias("__of"), F.col("body").alias("__hash"), F.col("nth").alias("__nth"), F.col("times").alias("__times"))
    parts = min(1 << 18, max(1, -(-6 * int(total) // bytes_per_range)))
    equal = F.col("__own").eqNullSafe(F.col("__id")) & F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__body") == F.col("__hash")) & (F.col("__number") == F.col("__nth"))
    out = docs_.withColumn("__number", number).join(drawn, equal).withColumn("__time", F.explode("__times"))
    out = out.withColumn("__range", F.least(F.lit(parts - 1), F.floor(F.col("__time") * parts)).cast("int"))
    return out.repartitionById(parts, F.col("__range")).sortWithinPartitions("__range", "__time", "__id", "__body").select("__row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = sizes(docs, "doc_id", "text", "source")
    drawn = plan(sized, sized.count())
    return drawn.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.round(F.array_min("times"), 9).alias("first_time"),
    )


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][n % 3 + 1]::DOUBLE AS weight, [0.5, 0.0, -0.5][n % 3 + 1]::DOUBLE AS tilt, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM r
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT source, source_size, tilt, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.tilt, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS ratio,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.key || ':17'), d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS DOUBLE) + d.size / 2::DOUBLE AS middle
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(3, floor(ratio) + CASE WHEN middle <= (ratio - floor(ratio)) * source_size THEN 1 ELSE 0 END) END AS copies,
    least(1.0::DOUBLE, middle / greatest(target, 1.0::DOUBLE)) AS u FROM p
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN abs(tilt) < 1e-9 THEN u ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u) - (1 - tilt)) / (2 * tilt) END, 9) END AS first_time FROM c
"""
