"""From features to the state of every cell of an area."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from hexflow.operators import edits, friction, graph, raster


@dataclass
class Mapping:
    """Lazy tables of one area; ``state`` has cell_id, q, r, ord, friction, affordance."""

    layers: DataFrame
    corridor: DataFrame
    state: DataFrame

    def adjacency(self) -> DataFrame:
        return graph.passable_adjacency(self.state)

    def visibility(self, depth: int) -> DataFrame:
        return graph.visibility(self.state, depth)


def build(features: DataFrame, cells: DataFrame, edit_cells: DataFrame | None = None, spacing: float = 1.0) -> Mapping:
    """Scan, merge, both spreadings, assembly, and painted surfaces on top.

    ``cells`` has cell_id, q, r, ord; ``edit_cells`` cell_id, edit_id, draw_order, surface_class.
    """
    hits, corridor = raster.fast_scan(features, cells, spacing)
    layers = friction.merge_layers(hits)
    ground = friction.ground(layers)
    mapped = cells.join(ground, "cell_id", "left")  # null where nothing lies: such cells get no halo
    halo = friction.barrier_halo(mapped)
    widened = friction.corridor_widening(mapped, corridor, layers)
    state = cells.join(friction.assemble(mapped, halo, widened), "cell_id")
    if edit_cells is not None:
        state = edits.apply_edits(state, edit_cells)
    return Mapping(layers, corridor, state)
