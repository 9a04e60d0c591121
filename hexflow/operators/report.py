"""What a run shows: peak, ratios, export rows, tooltips, latencies, and the paper's metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexflow.functions import colour, grid
from hexflow.functions.classify import friction_tier
from hexflow.sources.shared import written


def merge_desire(*parts: DataFrame) -> DataFrame:
    """``cell_id, score`` added up over shards (cell_id, score)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("cell_id").agg(F.sum("score").alias("score"))


def peak_flow(desire: DataFrame) -> DataFrame:
    """``peak``: the greatest score, at least of an empty run 1; ``readout``: what the panel shows."""
    peak = F.coalesce(F.max("score"), F.lit(1)).cast("long")
    return desire.agg(peak.alias("peak"), F.greatest(F.lit(0), F.round(peak.cast("double"))).cast("long").alias("readout"))


def flow(desire: DataFrame) -> DataFrame:
    """``cell_id, score, ratio``."""
    return desire.crossJoin(F.broadcast(peak_flow(desire).select("peak"))).select("cell_id", "score", colour.flow_ratio(F.col("score"), F.col("peak")).alias("ratio"))  # one row


def export_rows(desire: DataFrame, visible: DataFrame, state: DataFrame) -> DataFrame:
    """``cell_id, score, affordance, friction`` of cells scored or in view whose score is not nought."""
    both = desire.select("cell_id").union(visible.select("cell_id")).distinct()
    out = both.join(desire.select("cell_id", "score"), "cell_id", "left").where(F.coalesce("score", F.lit(0)) != 0)
    out = out.join(state.select("cell_id", "affordance", "friction"), "cell_id", "left")
    return out.select("cell_id", "score", F.coalesce("affordance", F.lit(0.0)).alias("affordance"), F.coalesce("friction", F.lit(1.0)).alias("friction"))


def tooltips(rows: DataFrame) -> DataFrame:
    label = F.initcap(F.replace(friction_tier(F.col("friction")), F.lit("_"), F.lit(" ")))
    label = F.concat(F.substring(label, 1, 1), F.lower(F.substring(label, 2, 99)))
    return rows.select("cell_id", F.round("score").cast("long").alias("flow"), F.format_number("affordance", 2).alias("affordance"), label.alias("type"), "friction")


def latencies(events: DataFrame, value: str = "value", by: str = "event_type") -> DataFrame:
    """Count, exact p50, p95 and p99 (the value at the rank that reaches the share) and maximum of a measure per kind.

    Equal values are counted first.  The different values are then dealt into ranges of about as many each, however long
    the tail, and written once with their range; ranges are summed in parallel and only then put together.
    """
    each = events.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = written(each.repartitionByRange(by, "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(by, "_part").agg(F.sum("_n").alias("_m"))
    kind = Window.partitionBy(by)  # a row a range
    before = F.sum("_m").over(kind.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(kind).alias("_all"))
    rank = F.col("_before") + F.sum("_n").over(Window.partitionBy(by, "_part").orderBy("_v"))
    ranked = ranged.join(starts, [by, "_part"]).withColumn("_rank", rank)
    at = lambda s: F.min(F.when(F.col("_rank") >= F.ceil(F.col("_all") * F.lit(s)), F.col("_v")))
    return ranked.groupBy(by).agg(F.sum("_n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("_v").alias("max"))


def mean_distance_difference(steps: DataFrame, gradients: DataFrame) -> DataFrame:
    """``dest, mdd``: the mean of what each walked step's cell lies off the walk's least distance.

    ``steps`` has dest, walk_id, cell_id.
    """
    own = steps.join(gradients, ["dest", "cell_id"]).withColumn("d", F.col("dist8") / 8.0)
    least = own.groupBy("dest", "walk_id").agg(F.min("d").alias("least"))
    return own.join(least, ["dest", "walk_id"]).groupBy("dest").agg(F.avg(F.abs(F.col("d") - F.col("least"))).alias("mdd"))


def sum_of_paths(desire: DataFrame, thresholds: list[int]) -> DataFrame:
    """``threshold, n_cells`` with a score above each."""
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return desire.select("score", each).groupBy("threshold").agg(F.count_if(F.col("score") > F.col("threshold")).alias("n_cells"))


def accuracy(steps: DataFrame, observed: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``n_steps, n_near, accuracy``: the share of steps (cell_id) within k cells of an observed cell."""
    around = F.explode(grid.offsets(grid.disk_offsets(k))).alias("o")
    seen = observed.select("cell_id").distinct().join(cells.select("cell_id", "q", "r"), "cell_id").select("q", "r", around)
    near = seen.select((F.col("q") + F.col("o.dq")).alias("q"), (F.col("r") + F.col("o.dr")).alias("r")).distinct()
    ids = cells.join(near, ["q", "r"], "left_semi").select("cell_id", F.lit(1).alias("hit"))
    n, hits = F.count("*"), F.coalesce(F.sum("hit"), F.lit(0))
    return steps.join(ids, "cell_id", "left").agg(n.alias("n_steps"), hits.cast("long").alias("n_near"), (hits / F.greatest(n, F.lit(1))).alias("accuracy"))
