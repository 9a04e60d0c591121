"""Who walks where: roles, origin-destination pairs, apportionment, waves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexflow.functions.grid import grid_distance
from hexflow.params import IMPASSABLE


def origins(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("type").isin("origin", "dual") & (F.col("weight") > 0))


def destinations(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("type").isin("destination", "dual") & (F.col("weight") > 0))


#: Blocks that destinations are dealt into for the pairing.
OD_BLOCKS = 16


def od_matrix(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """``origin, dest, grid_dist`` of all pairs of different cells.

    Every pair is the result.  Destinations are dealt into blocks, each origin goes to every block, and the
    pairs come from an equi-join on the block, so nothing is broadcast unless Spark knows it to be small.
    """
    at = cells.select("cell_id", "q", "r")
    o = origins(nodes).join(at, "cell_id").select(F.col("cell_id").alias("origin"), F.col("q").alias("q0"), F.col("r").alias("r0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OD_BLOCKS - 1).cast("long"))).alias("block"))
    d = destinations(nodes).join(at, "cell_id").select(F.col("cell_id").alias("dest"), F.col("q").alias("q1"), F.col("r").alias("r1"), F.pmod(F.xxhash64("cell_id"), F.lit(OD_BLOCKS)).alias("block"))
    return o.join(d, "block").where("origin <> dest").select("origin", "dest", grid_distance("q0", "r0", "q1", "r1").alias("grid_dist"))


def reachable_od(nodes: DataFrame, cells: DataFrame, gradients: DataFrame) -> DataFrame:
    """``origin, origin_ord, dest, dest_ord, weight, origin_weight, dist8`` of pairs with a finite distance."""
    open_ = cells.where(F.col("friction") < IMPASSABLE).select("cell_id")
    o = origins(nodes).join(open_, "cell_id", "left_semi").select(F.col("cell_id").alias("origin"), F.col("node_ord").alias("origin_ord"), F.col("weight").alias("origin_weight"))
    d = destinations(nodes).select(F.col("cell_id").alias("dest"), F.col("node_ord").alias("dest_ord"), "weight")
    g = gradients.select("dest", F.col("cell_id").alias("origin"), "dist8")
    return g.join(o, "origin").join(d, "dest").where("origin <> dest").select("origin", "origin_ord", "dest", "dest_ord", "weight", "origin_weight", "dist8")


def apportion(pairs: DataFrame, agents_per_weight_unit: float = 100) -> DataFrame:
    """``origin, origin_ord, dest, dest_ord, weight, total_volume, assigned``: largest remainders per origin.

    A window's group is one origin's destinations, a list that a person placed.
    """
    volume = F.greatest(F.lit(1), F.floor(F.col("origin_weight") * agents_per_weight_unit + 0.5)).cast("int")
    w = Window.partitionBy("origin")
    quota = F.col("weight").cast("double") / F.sum("weight").over(w).cast("double") * F.col("total_volume")
    out = pairs.withColumn("total_volume", volume).withColumn("quota", quota).withColumn("whole", F.floor("quota"))
    left = F.col("total_volume") - F.sum("whole").over(w)
    turn = F.row_number().over(w.orderBy(F.desc(F.col("quota") - F.col("whole")), F.desc("weight"), "dest_ord"))
    out = out.withColumn("left", left).withColumn("turn", turn)
    return out.select("origin", "origin_ord", "dest", "dest_ord", "weight", "total_volume", (F.col("whole") + (F.col("turn") <= F.col("left")).cast("int")).cast("int").alias("assigned"))


def check_plan(plan: DataFrame, gradients: DataFrame) -> DataFrame:
    """The plan, if every pair has a finite distance; else an error names how many have none."""
    lost = plan.join(gradients.select("dest", F.col("cell_id").alias("origin")), ["dest", "origin"], "left_anti").count()
    if lost:
        raise ValueError(f"{lost} pairs of the plan have no path")
    return plan


def wave_count(agents: int, agents_per_weight_unit: float = 100) -> int:
    if agents <= 1:
        return 1
    per_wave = min(agents, max(1, math.floor(4 * 100 / agents_per_weight_unit + 0.5)))
    return max(1, min(16, -(-agents // per_wave)))


def wave_split(plan: DataFrame, waves: int) -> DataFrame:
    """``wave, origin, dest, agents``: each pair's agents over the waves, the remainder in the first ones."""
    out = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))).alias("wave"))
    agents = F.floor(F.col("assigned") / waves) + (F.col("wave") < F.col("assigned") % waves).cast("int")
    return out.withColumn("agents", agents.cast("int")).where("agents > 0").select("wave", "origin", "origin_ord", "dest", "dest_ord", "agents")


def max_ticks(grid_dist, n_cells):
    """Ticks that a walk may take."""
    return F.least(F.lit(5000), F.greatest(F.lit(64), 8 * grid_dist + 32), 2 * F.ceil(F.sqrt(n_cells * math.pi))).cast("int")
