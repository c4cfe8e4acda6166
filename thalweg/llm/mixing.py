"""Mixing sources to target weights (operator 3).

Every document gets a hash-random key; within its source documents stand in key
order.  The key's leading digits cut a source into ranges, token counts are
summed per range, ranges get prefix sums in two levels, and a window inside each
range completes the running count, so no task sees a whole source.  A source's
budget is then whole epochs plus one exact cut of the running count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import n_words, saved

#: No document is taken more often than this.
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, budget) from (source, size).

    Weights repeat over the sources by code point, null last.  Targets share the
    sum of all sizes by weight; one that would exceed ``max_epochs`` times its
    source stops there and its excess is shared again by weight.  With sources
    in order of size per weight that is one pass: source i is full if
    ``max_epochs * size_i * W <= w_i * (T - C)`` where C is what earlier ones
    took and W the weight from i on.  All sums are exact integers.
    The windows here run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k, n = max_epochs, len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    lcm = 1
    for w in weights:
        lcm *= w
    ranked = total.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(order) - 1) % n + 1).cast("long"))
    ranked = ranked.withColumn("_r", F.expr(f"source_size * {lcm} div _w"))
    fill = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("_t", F.sum("source_size").over(everything))
        .withColumn("_c", F.coalesce(F.sum(F.col("source_size") * k).over(before), F.lit(0)))
        .withColumn("_s", F.sum("_w").over(after))
        .withColumn("_full", F.col("source_size") * k * F.col("_s") <= F.col("_w") * (F.col("_t") - F.col("_c")))
        .withColumn("_rest", F.col("_t") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("source_size") * k)).over(everything), F.lit(0)))
        .withColumn("_free", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything))
    )
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("_full"), (F.col("source_size") * k).cast("double"))
        .otherwise((F.col("_w") * F.col("_rest")).cast("double") / F.col("_free").cast("double"))
        .alias("target"),
        F.when(F.col("_full"), F.col("source_size") * k).otherwise(F.expr("_w * _rest div _free")).alias("budget"),
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of ``docs``, and its
    columns ``keep`` (numbers or strings).

    size is the text's number of words (null or empty: 0), taken how many words
    of the document the mix takes, repeats counted: whole epochs times its size
    plus, for the last epoch, what lies before the cut of its source.  taken sums
    to the floor of the source's target exactly.  The key is the MD5 of
    ``seed`` and doc_id, or of the text's hash where that is null, so reruns agree;
    rows that agree in doc_id stand in order of size and of ``keep``, which leaves
    the result the same whatever the order of equal rows.  An empty table gives no rows.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")))
    narrow = saved(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            n_words(F.col("text")).alias("size"),
            *keep,
            F.md5(F.concat(F.lit(seed), own)).alias("_key"),
        ),
        "mix",
    )
    narrow = narrow.withColumns({"_d1": F.substring("_key", 1, 2), "_d2": F.substring("_key", 3, 2)})
    ranges = narrow.groupBy("source", "_d1", "_d2").agg(F.sum("size").alias("_n"))
    outer = ranges.groupBy("source", "_d1").agg(F.sum("_n").alias("_n1"))
    past = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.select(F.col("source").alias("_s"), F.col("_d1").alias("_e1"), F.coalesce(F.sum("_n1").over(past("source", "_d1")), F.lit(0)).alias("_p1"))
    inner = ranges.withColumn("_p2", F.coalesce(F.sum("_n").over(past("source", "_d1", "_d2")), F.lit(0)))
    inner = inner.join(outer, inner["source"].eqNullSafe(outer["_s"]) & (inner["_d1"] == outer["_e1"])).select(
        F.col("source").alias("_s"), F.col("_d1").alias("_e1"), F.col("_d2").alias("_e2"), (F.col("_p1") + F.col("_p2")).alias("_p")
    )
    local = Window.partitionBy("source", "_d1", "_d2").orderBy("_key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("_p3", F.coalesce(F.sum("size").over(local), F.lit(0)))
    placed = placed.join(inner, placed["source"].eqNullSafe(inner["_s"]) & (placed["_d1"] == inner["_e1"]) & (placed["_d2"] == inner["_e2"])).drop("_s", "_e1", "_e2")
    targets = saved(source_targets(narrow, weights, max_epochs), "targets").withColumnRenamed("source", "_s")
    both = placed.join(targets, placed["source"].eqNullSafe(targets["_s"]))
    whole = F.expr("case when source_size > 0 then budget div source_size else 0 end")
    part = F.expr("case when source_size > 0 then budget % source_size else 0 end")
    running = F.col("_p") + F.col("_p3")
    return both.select(
        "doc_id",
        "source",
        "size",
        *keep,
        "source_size",
        "target",
        (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part - running))).cast("long").alias("taken"),
    )
