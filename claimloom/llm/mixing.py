"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. A source's keys are uniform, so equal
ranges of the key are buckets of about BUCKET_ROWS rows: sorting within buckets
range-sorts the source, and prefix sums of the words run over rows within a
bucket, over buckets within a block of BLOCK buckets, and over blocks. No task
holds a whole source. The budget of a source cuts its sorted row of documents at
the exact word, after as many whole epochs as the budget holds.

Defined cases: a null text has size 0; a null source is a source of its own,
after all others; a source without words has target 0; rows that repeat a doc_id
are sorted by size as well, so that reruns agree; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import WORD, free_name, held_names, stored, table

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix:"
BUCKET_ROWS = 256
BLOCK = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n_rows, source_size and target of each source.

    Raising one level until the targets min(most * size, level * weight) add up
    to all words is what reshaping the excess by weight comes to. With sources by
    the level at which they stop, the level is the largest of
    (words - stopped before) / (weight left), over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("stop", most * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped, weighed = F.coalesce(F.sum("stop").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("level", (F.sum("source_size").over(everything) - stopped) / (F.sum("weight").over(everything) - weighed))
    level = F.max("level").over(everything)
    return by.select("source", "n_rows", "source_size", F.least(F.col("stop").cast("double"), level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row."""
    held_names(docs, "doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = stored(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "sizes")
    return take(rows, source_targets(rows, weights, most))


def take(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Cuts each source's rows, by key, at its target."""
    targets = stored(targets.select(F.col("source").alias("s"), "n_rows", "source_size", "target"), "targets")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.floor(place * F.ceil(F.col("n_rows") / BUCKET_ROWS))).withColumn("block", F.floor(F.col("bucket") / BLOCK))

    def running(*keys: str, order):
        return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def before(col: str, window) -> F.Column:
        return F.coalesce(F.sum(col).over(window), F.lit(0))

    buckets = rows.groupBy("source", "block", "bucket").agg(F.sum("size").alias("b_size"))
    blocks = buckets.groupBy("source", "block").agg(F.sum("b_size").alias("k_size"))
    blocks = blocks.select(F.col("source").alias("k_source"), F.col("block").alias("k_block"), before("k_size", running("source", order=["block"])).alias("k_before"))
    buckets = buckets.withColumn("b_before", before("b_size", running("source", "block", order=["bucket"])))
    same = F.col("source").eqNullSafe(F.col("k_source")) & (F.col("block") == F.col("k_block"))
    buckets = buckets.join(blocks, same).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.col("k_before") + F.col("b_before")).alias("offset"))

    rows = rows.withColumn("r_before", before("size", running("source", "bucket", order=["key", "doc_id", "size"])))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    budget = F.floor("target")
    epochs = F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("r_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, columns kept.

    A document that the budget cuts goes in whole, so a source has less than
    one document more than its target. A document without words goes: no budget
    takes it. Rows that repeat a doc_id within a source are taken equally often.
    """
    own_id, own_source, copies, copy = (free_name(x, *docs.columns) for x in ("_id", "_source", "_copies", "_copy"))
    ids = mix(docs, weights, most, seed).filter("taken > 0")
    times = F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    ids = ids.groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source)).agg(times.alias(copies))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source))
    out = docs.filter(F.col("text").rlike(WORD)).join(ids, same)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || doc_id) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS stop,
         [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(stop::DOUBLE, max(level) OVER () * weight) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(floor(t.target)::BIGINT // nullif(t.source_size, 0), 0) AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM r
"""
