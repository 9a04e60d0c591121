"""One step of one agent, declaratively: candidates, cone, score and choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.functions.grid import angle_diff
from hexflow.functions.hashing import first_uniform, fnv1a
from hexflow.params import FOOTPRINT_GAIN, W_THETA, SimulationParams


def candidates(agents: DataFrame, visible: DataFrame, state: DataFrame, gradients: DataFrame) -> DataFrame:
    """``agent, curr, dest, heading, g_curr`` and ``view``: the visible cells with friction, affordance, footprints and distance ``g``, by dst_ord.

    ``state`` has cell_id, friction, affordance, footprints.  A view is put together once for a cell and destination,
    whatever agents stand there, and an agent stays one row.
    """
    gradients = gradients.hint("merge")  # Parquet packs fields so well that a million rows look small
    here = gradients.select("dest", F.col("cell_id").alias("curr"), (F.col("dist8") / 8.0).alias("g_curr"))
    there = gradients.select("dest", F.col("cell_id").alias("dst"), (F.col("dist8") / 8.0).alias("g"))
    # no size is known of what a flood gives, which is many times its cells: it must not be broadcast
    seen = visible.select(F.col("src").alias("curr"), "dst", "dst_ord", "bearing").hint("merge").join(state.select(F.col("cell_id").alias("dst"), "friction", "affordance", "footprints"), "dst")
    cell = F.struct("dst_ord", "dst", F.col("bearing").cast("double").alias("bearing"), "friction", "affordance", F.col("footprints").cast("double").alias("footprints"), "g")
    views = seen.join(there, "dst").groupBy("dest", "curr").agg(F.sort_array(F.collect_list(cell)).alias("view"))
    return agents.join(views.join(here, ["dest", "curr"]), ["dest", "curr"]).select("agent", "curr", "dest", "heading", "g_curr", "view")


def _cone(cands: DataFrame, params: SimulationParams) -> DataFrame:
    """The agents with ``_in``, the candidates within the cone (all, if it is empty)."""
    inside = F.filter("view", lambda c: _angle(c) <= params.field_of_view / 2)
    return cands.withColumn("_in", inside).withColumn("_in", F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.col("view")))


def _angle(c):
    return angle_diff(c["bearing"], F.col("heading").cast("double"))


def scored(cands: DataFrame, params: SimulationParams) -> DataFrame:
    """The agents with the candidates within the cone (all, if it is empty) as ``among``: dst_ord, dst, friction, g, score."""

    def score(c):
        affordance = c["affordance"] + FOOTPRINT_GAIN * F.log1p(c["footprints"])
        cost = c["friction"] + c["g"] - F.col("g_curr")
        return params.affordance_weight * affordance - params.distance_penalty * cost - W_THETA * _angle(c) / 180.0

    known = lambda c: F.struct(*(c[x].alias(x) for x in ("dst_ord", "dst", "friction", "g")), score(c).alias("score"))
    return _cone(cands, params).select("agent", "curr", F.transform("_in", known).alias("among"))


def best_step(cands: DataFrame, params: SimulationParams) -> DataFrame:
    """``agent, next, score``: the greatest score, ties to the smaller cell."""
    best = F.array_max(F.transform("among", lambda c: F.struct(F.round(c["score"], 9).alias("score"), (-c["dst"]).alias("dst"))))
    return scored(cands, params).select("agent", best.alias("_b")).select("agent", (-F.col("_b.dst")).alias("next"), F.round("_b.score", 6).alias("score"))


#: What a rule takes the least of: the distance from the goal, or the cost of the jump.
LEAST = {"basic": lambda c: c["g"], "path": lambda c: c["friction"] + c["g"]}


def rule_step(cands: DataFrame, params: SimulationParams, rule: str) -> DataFrame:
    """``agent, next`` by one of the simpler choice rules: basic (nearest the goal), path (least cost of the jump), weighted."""
    if rule == "weighted":
        return best_step(cands, params).select("agent", "next")
    return rule_steps(cands, params, [rule]).withColumnRenamed(rule, "next")


def rule_steps(cands: DataFrame, params: SimulationParams, rules: list[str]) -> DataFrame:
    """``agent`` and a column a rule (of LEAST) with its next cell: the views are gone through once, and an agent is one row throughout."""
    least = lambda order: F.array_min(F.transform("_in", lambda c: F.struct(order(c).alias("c"), c["dst"].alias("dst"))))["dst"]
    return _cone(cands, params).select("agent", *[least(LEAST[r]).alias(r) for r in rules])


def softmax_step(cands: DataFrame, params: SimulationParams) -> DataFrame:
    """``agent, next, uniform``: one seeded draw over exp(score / temperature) in the order of dst_ord."""
    uniform = first_uniform(fnv1a(F.concat_ws(":", "agent", F.col("curr").cast("string"))))
    out = scored(cands, params).withColumn("uniform", uniform).withColumn("_top", F.array_max(F.transform("among", lambda c: c["score"])))
    out = out.withColumn("_p", F.transform("among", lambda c: F.struct(c["dst"].alias("dst"), F.exp((c["score"] - F.col("_top")) / params.temperature).alias("p"))))
    out = out.withColumn("_all", F.aggregate("_p", F.lit(0.0), lambda s, c: s + c["p"]))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("long").alias("hit"))

    def add(s, c):
        cum = s["cum"] + c["p"]
        return F.struct(cum.alias("cum"), F.coalesce(s["hit"], F.when(F.col("uniform") * F.col("_all") <= cum, c["dst"])).alias("hit"))

    hit = F.aggregate("_p", start, add)["hit"]
    return out.select("agent", F.coalesce(hit, F.element_at("_p", -1)["dst"]).alias("next"), "uniform")


def fallback_step(agents: DataFrame, cells: DataFrame, gradients: DataFrame, rings: int = 3) -> DataFrame:
    """``agent, next`` for agents with nothing in view: the passable cell of least distance in the first ring that has one."""
    from hexflow.functions.grid import disk_offsets, grid_distance, offsets

    around = F.explode(offsets([o for o in disk_offsets(rings) if o != (0, 0)])).alias("o")
    at = cells.select(F.col("cell_id").alias("curr"), "q", "r")
    near = agents.join(at, "curr").select("agent", "dest", "q", "r", around)
    near = near.select("agent", "dest", (F.col("q") + F.col("o.dq")).alias("q"), (F.col("r") + F.col("o.dr")).alias("r"), grid_distance(F.lit(0), F.lit(0), F.col("o.dq"), F.col("o.dr")).alias("ring"))
    known = near.join(cells.where("friction < 999999").select("cell_id", "q", "r", "ord"), ["q", "r"]).join(gradients, ["dest", "cell_id"])
    return known.groupBy("agent").agg(F.min_by("cell_id", F.struct("ring", "dist8", "ord")).alias("next"))
