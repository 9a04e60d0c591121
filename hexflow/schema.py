"""The canonical tables, as DDL, and validation on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame

RINGS = "array<array<struct<x: double, y: double>>>"
TABLES = {
    "cells": "cell_id long, q int, r int, ord int, friction double",
    "features": f"feature_id long, source_layer string, class string, subclass string, brunnel string, foot string, access string, indoor string, surface string, layer string, geom_type string, rings {RINGS}",
    "feature_hits": "cell_id long, layer string, friction double",
    "nodes": "node_ord int, cell_id long, type string, weight int",
    "edits": "edit_id long, draw_order long, surface_class string, q0 int, q1 int, r0 int, r1 int",
    "traces": "user_id long, ts timestamp, step long, cell_id long, kind string",
    "adj": "src long, dst long, w8 int",
    "gradient": "dest long, cell_id long, dist8 int",
    "plan": "origin long, dest long, dest_ord int, weight int, total_volume int, assigned int",
    "desire": "cell_id long, score long",
    "contrib": "dest long, cell_id long, n long",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order, cast to its types; missing columns raise."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(TABLES[table])])
