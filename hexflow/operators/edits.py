"""Painted surfaces as a derived view: the last drawn wins, and removing an edit restores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.functions.classify import affordance_of, friction_of, known_class


def last_edit(edit_cells: DataFrame) -> DataFrame:
    """``cell_id, surface_class`` from rows of cell_id, edit_id, draw_order, surface_class."""
    return edit_cells.groupBy("cell_id").agg(F.max_by("surface_class", F.struct("draw_order", "edit_id")).alias("surface_class"))


def apply_edits(cells: DataFrame, edit_cells: DataFrame) -> DataFrame:
    """Cells with the friction and affordance of their last edit."""
    last = last_edit(edit_cells).select("cell_id", known_class(F.col("surface_class")).alias("_c"))
    base = cells if "affordance" in cells.columns else cells.withColumn("affordance", affordance_of(F.col("friction")))
    out = base.join(last, "cell_id", "left").withColumn("_f", friction_of(F.col("_c")))
    out = out.withColumn("affordance", F.when(F.col("_c").isNull(), F.col("affordance")).otherwise(affordance_of(F.col("_f"))))
    return out.withColumn("friction", F.coalesce("_f", "friction")).drop("_f", "_c")


def remove_edits(edits: DataFrame, removed: DataFrame) -> DataFrame:
    """The edits without those whose edit_id is removed."""
    return edits.join(removed.select("edit_id"), "edit_id", "left_anti")


def touched_cells(edit_cells: DataFrame) -> DataFrame:
    return edit_cells.select("cell_id").distinct()
