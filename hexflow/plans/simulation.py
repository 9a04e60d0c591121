"""One run: rest, fields, plan, waves, wear and what is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from hexflow.operators import graph, plan, report, walk, wear
from hexflow.params import SimulationParams


@dataclass
class Run:
    """``contrib`` (dest, cell_id, n), ``desire`` (cell_id, score), the cells afterwards, and destinations that nobody reaches."""

    contrib: DataFrame
    desire: DataFrame
    cells: DataFrame
    unreachable: DataFrame

    def peak(self) -> DataFrame:
        return report.peak_flow(self.desire)

    def flow(self) -> DataFrame:
        return report.flow(self.desire)


def run(cells: DataFrame, nodes: DataFrame, params: SimulationParams | None = None, waves: int | None = None) -> Run:
    """``cells`` has cell_id, q, r, ord, friction, affordance; wear follows only if the parameters ask for it."""
    params = params or SimulationParams()
    rested = wear.decay(cells).checkpoint()
    dests = plan.destinations(nodes).selectExpr("cell_id as dest")
    contrib = walk.simulate(rested, nodes, params, waves).checkpoint()
    desire = walk.desire(contrib)
    after = wear.wear(rested, desire) if params.emergent_wear else rested
    return Run(contrib, desire, after, graph.unreachable(dests, graph.gradient(rested, dests)))


def missing_fields(dests: DataFrame, gradients: DataFrame, cells: DataFrame) -> DataFrame:
    """The fields with those added that some destination still lacks."""
    lost = dests.select("dest").distinct().join(gradients.select("dest").distinct(), "dest", "left_anti")
    return gradients.unionByName(graph.gradient(cells, lost))
