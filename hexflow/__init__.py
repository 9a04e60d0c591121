"""Pedestrian-flow analytics on hexagonal grids, as Spark jobs."""
