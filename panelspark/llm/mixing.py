"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import cut_lineage

#: Hash buckets of a source for the running sum; one bucket of one source is sorted in a task.
BUCKETS_HEX = 3


def source_targets(sizes: DataFrame, weights: Column, budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Target of each source: one row per source with ``source_size`` and ``target``.

    ``weights`` may use ``_rank``, the place of the source by code point from 0 (NULL last).  All
    sources share ``budget`` times all sizes by weight; a source is clamped at ``max_epochs`` times its
    size and the excess is shared again by weight.  With sources in the order of size over weight the
    clamped ones come first, so one running sum finds the water level.  A source without words gets 0.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    named = per.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    everything = Window.partitionBy(F.lit(1))
    before = (Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_w"), "_rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    filled = (named.withColumn("_w", weights.cast("double")).withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
              .withColumn("_total", F.lit(float(budget)) * F.sum("source_size").over(everything))
              .withColumn("_weight", F.sum("_w").over(everything))
              .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                          / (F.col("_weight") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
              .withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
              .withColumn("_used", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everything))
              .withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0.0)).over(everything)))
    rest = F.col("_w") * ((F.col("_total") - F.col("_used")) / (F.col("_weight") - F.col("_taken")))
    return filled.select("_source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(rest).alias("target"))


def cycle_weights(*weights: float) -> Column:
    """Weights that repeat over the sources in their order."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))


def mix(docs: DataFrame, size: Column, weights: Column, *, source: str = "source", key: str = "doc_id", budget: float = 1.5,
        max_epochs: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``repeats`` and ``taken`` (size times repeats).

    Every row of a source is taken floor(target / source_size) times; the missing fraction is one more
    copy of the rows that come first by a seeded md5 of their key, up to the row whose middle passes the
    target, so a source misses its target by half a row at most and reruns agree.  The running sum is
    split: sizes per (source, hash bucket) first, and only the bucket in which the target falls is
    ordered row by row, so a source with a third of all rows is spread over thousands of groups.

    NULL sources are a source of their own, a source without words is not taken, NULL keys hash as the
    empty text; equal rows are separate rows.  An empty table gives an empty table.  Input columns named as a result column are replaced.
    """
    added = ("size", "source_size", "target", "repeats", "taken")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    # A struct of the input keeps any column names apart from those used here.
    rows = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("_row"), F.col(f"`{source}`").alias("_source"),
                        size.cast("long").alias("_size"), draw.alias("_draw"))
            .withColumn("_bucket", F.substring("_draw", 1, BUCKETS_HEX)))
    hist = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_bucket_size"))
    hist = cut_lineage(hist, "mix_sizes")
    targets = source_targets(hist.select("_source", F.col("_bucket_size").alias("_size")), weights, budget, max_epochs)
    targets = (targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
               .withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size")).withColumnRenamed("_source", "_s"))
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = (hist.withColumn("_before", F.coalesce(F.sum("_bucket_size").over(running), F.lit(0)))
              .join(targets, F.col("_source").eqNullSafe(F.col("_s"))).select("_s", F.col("_bucket").alias("_b"), "_before",
                                                                             "_bucket_size", "source_size", "target", "_whole", "_extra"))
    placed = cut_lineage(placed, "mix_targets")
    inside = (F.col("_extra") > 0) & (F.col("_before") + F.col("_bucket_size") <= F.col("_extra"))
    cut = (F.col("_before") < F.col("_extra")) & ~inside
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    # At most one bucket of each source is cut.  The other rows move once, by a merge join at any size.
    edges = cut_lineage(placed.where(cut), "mix_edges")
    order = (Window.partitionBy("_source", "_bucket").orderBy("_draw", "_size").rowsBetween(Window.unboundedPreceding, -1))
    clear = rows.join(placed.where(~cut).hint("merge"), same).withColumn("_more", F.when(inside, 1).otherwise(0))
    edge = (rows.join(edges, same).withColumn("_sum", F.col("_before") + F.coalesce(F.sum("_size").over(order), F.lit(0)))
            .withColumn("_more", F.when(2 * F.col("_sum") + F.col("_size") <= 2 * F.col("_extra"), 1).otherwise(0)).drop("_sum"))
    repeats = (F.col("_whole") + F.col("_more")).cast("long")
    return clear.unionByName(edge).select("_row.*", F.col("_size").alias("size"), "source_size", "target", repeats.alias("repeats"),
                                          (F.col("_size") * repeats).alias("taken"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``repeats`` says; the helper columns go."""
    copies = mixed.where("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return copies.drop("_copy", "size", "source_size", "target", "repeats", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
named AS (SELECT *, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS rk FROM per),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2 * source_size AS cap FROM named),
lev AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS weight,
  coalesce(sum(cap) OVER o, 0)::DOUBLE AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap::DOUBLE <= w * ((total - cap_before) / (weight - w_before)) AS filled FROM lev),
g AS (SELECT *, sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()::DOUBLE AS used, sum(CASE WHEN filled THEN w ELSE 0 END) OVER () AS wused FROM f),
t AS (SELECT src, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE w * ((total - used) / (weight - wused)) END AS target FROM g),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
s AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, x.target - x.whole * x.source_size AS extra,
  coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, '')), d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN x ON d.src IS NOT DISTINCT FROM x.src)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN 2 * before + size <= 2 * extra THEN 1 ELSE 0 END)::BIGINT AS taken FROM s
"""
