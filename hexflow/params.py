"""Simulation parameters with their limits, and the model's fixed constants."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

# Tier costs and affordances, blur and wear constants.
IMPASSABLE = 999999.0
COSTS = {"PAVEMENT": 1.0, "LIGHT_PARK": 2.5, "HEAVY_GRASS": 4.0, "IMPASSABLE": IMPASSABLE}
AFFORDANCES = {"PAVEMENT": 1.0, "LIGHT_PARK": 0.6, "HEAVY_GRASS": 0.3, "IMPASSABLE": 0.0}
BARRIER_RADIUS, BARRIER_SIGMA, BARRIER_ADD, BARRIER_PENALTY = 2, 1.5, 3.0, 0.4
CORRIDOR_RADIUS, CORRIDOR_SIGMA, CORRIDOR_ADD, CORRIDOR_BOOST = 1, 1.0, 1.5, 0.3
DECAY_RATE, UPDATE_RATE, SOFT_CAP, WEAR_VOLUME = 0.001, 0.005, 0.85, 100.0
MAX_TICKS, TICK_BUFFER, W_THETA, FOOTPRINT_GAIN = 5000, 8, 0.6, 0.05
WEIGHT_SCALE = 8  # shortest paths use eighths of friction as integers


def gaussian(d: float, sigma: float) -> float:
    return math.exp(-0.5 * (d / sigma) ** 2)


@dataclass(frozen=True)
class SimulationParams:
    affordance_weight: float = 1
    distance_penalty: float = 4
    vision_depth: int = 15
    field_of_view: float = 120
    agents_per_weight_unit: float = 100
    temperature: float = 0.5
    stride_resolution: int = 15
    emergent_wear: bool = True
    wave_in_seed: bool = False

    def updated(self, **values) -> SimulationParams:
        """With these values rounded to their step and clamped; what is no number keeps the current one."""
        new = {}
        for f in fields(self):
            if f.name not in values:
                continue
            v = values[f.name]
            if f.name not in LIMITS:
                new[f.name] = bool(v)
            elif isinstance(v, (int, float)) and math.isfinite(v):
                low, high, step = LIMITS[f.name]
                v = min(high, max(low, math.floor(v / step + 0.5) * step))
                new[f.name] = int(v) if isinstance(getattr(self, f.name), int) and v == int(v) else v
        return replace(self, **new)


#: Least, most and step of each parameter.
LIMITS = {
    "affordance_weight": (1, 8, 1),
    "distance_penalty": (1, 8, 1),
    "vision_depth": (5, 30, 5),
    "field_of_view": (30, 360, 30),
    "agents_per_weight_unit": (25, 500, 5),
    "temperature": (0, 2, 0.25),
    "stride_resolution": (0, 15, 1),
}
