"""The walk one agent and one cell at a time, in plain Python, to hold the kernel against."""

from __future__ import annotations

import heapq
import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd

from hexflow.functions.grid import NEIGHBOURS, path_cells
from hexflow.functions.hashing import draw
from hexflow.params import FOOTPRINT_GAIN, IMPASSABLE, W_THETA, SimulationParams

STALLS = 3


def _bearing(dq: int, dr: int) -> float:
    return math.degrees(math.atan2(dq + dr / 2, math.sqrt(3) / 2 * dr)) % 360


class Csr:
    """Edges by source as offsets, for the kernels."""

    def __init__(self, edges: pd.DataFrame):
        self.ids = np.unique(np.concatenate([edges.src.to_numpy(), edges.dst.to_numpy()]))
        src, dst = np.searchsorted(self.ids, edges.src), np.searchsorted(self.ids, edges.dst)
        order = np.lexsort((dst, src))
        self.dst, self.w = dst[order].astype(np.int32), edges.w8.to_numpy()[order].astype(np.int32)
        self.first = np.searchsorted(src[order], np.arange(len(self.ids) + 1))

    def distances(self, target: int) -> np.ndarray:
        """In eighths: what the cells after the target cost, the target itself nothing; -1 where unreachable."""
        dist = np.full(len(self.ids), -1, dtype=np.int64)
        at = int(np.searchsorted(self.ids, target))
        if at == len(self.ids) or self.ids[at] != target:
            return dist
        first, dst, w = self.first.tolist(), self.dst, self.w
        best, heap = {at: 0}, [(0, at)]
        while heap:
            d, u = heapq.heappop(heap)
            if dist[u] >= 0:
                continue
            dist[u] = d
            for v, c in zip(dst[first[u] : first[u + 1]].tolist(), w[first[u] : first[u + 1]].tolist(), strict=True):
                if dist[v] < 0 and d + c < best.get(v, 1 << 62):
                    best[v] = d + c
                    heapq.heappush(heap, (d + c, v))
        return dist


@dataclass
class Ground:
    """The passable cells: place, friction, affordance; and where the neighbours of each are."""

    ids: np.ndarray
    q: np.ndarray
    r: np.ndarray
    order: np.ndarray
    friction: np.ndarray
    affordance: np.ndarray
    csr: Csr

    @classmethod
    def of(cls, cells: pd.DataFrame) -> Ground:
        cells = cells[cells.friction < IMPASSABLE].sort_values("cell_id")
        at = {(q, r): i for i, (q, r) in enumerate(zip(cells.q.tolist(), cells.r.tolist(), strict=True))}
        ids, w8 = cells.cell_id.to_numpy(), np.floor(8 * cells.friction.to_numpy() + 0.5).astype(int)
        edges = [(ids[i], ids[j], w8[j]) for (q, r), i in at.items() for dq, dr in NEIGHBOURS if (j := at.get((q + dq, r + dr))) is not None]
        csr = Csr(pd.DataFrame(edges or np.zeros((0, 3), int), columns=["src", "dst", "w8"]))
        return cls(ids, cells.q.to_numpy(), cells.r.to_numpy(), cells.ord.to_numpy(), cells.friction.to_numpy(float), cells.affordance.to_numpy(float), csr)

    def __post_init__(self):
        self.at = {(int(q), int(r)): i for i, (q, r) in enumerate(zip(self.q, self.r, strict=True))}
        self.near = [[j for dq, dr in NEIGHBOURS if (j := self.at.get((q + dq, r + dr))) is not None] for q, r in zip(self.q.tolist(), self.r.tolist(), strict=True)]
        for own in self.near:
            own.sort(key=lambda j: self.order[j])
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def distances(self, dest: int) -> np.ndarray:
        """Distance in friction units, infinite where unreachable."""
        out = np.full(len(self.ids), np.inf)
        i = int(np.searchsorted(self.ids, dest))
        if i < len(self.ids) and self.ids[i] == dest:
            out[i] = 0.0
        d = self.csr.distances(dest)
        known = np.searchsorted(self.ids, self.csr.ids)
        out[known[d >= 0]] = d[d >= 0] / 8.0
        return out

    def visible(self, i: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells within ``depth`` steps over passable cells, in order, and their whole-degree bearings."""
        if i not in self.seen:
            hops, queue = {i: 0}, deque([i])
            while queue:
                u = queue.popleft()
                if hops[u] < depth:
                    for v in self.near[u]:
                        if v not in hops:
                            hops[v] = hops[u] + 1
                            queue.append(v)
            del hops[i]
            found = np.array(sorted(hops, key=lambda j: self.order[j]), dtype=int)
            deg = [math.floor(_bearing(int(self.q[j] - self.q[i]), int(self.r[j] - self.r[i])) + 0.5) for j in found]
            self.seen[i] = found, np.array(deg, dtype=float)
        return self.seen[i]

    def bearing(self, i: int, j: int, depth: int) -> float:
        found, deg = self.visible(i, depth)
        at = np.flatnonzero(found == j)
        return float(deg[at[0]]) if len(at) else _bearing(int(self.q[j] - self.q[i]), int(self.r[j] - self.r[i]))

    def line(self, i: int, j: int) -> list[int]:
        """The straight line if passable, else a shortest way around, else only i."""
        straight = [self.at.get(c) for c in path_cells(int(self.q[i]), int(self.r[i]), int(self.q[j]), int(self.r[j]))]
        if None not in straight:
            return straight
        before, queue = {i: None}, deque([i])
        while queue:
            u = queue.popleft()
            if u == j:
                out = [u]
                while before[out[-1]] is not None:
                    out.append(before[out[-1]])
                return out[::-1]
            for v in self.near[u]:
                if v not in before:
                    before[v] = u
                    queue.append(v)
        return [i]


def walk(ground: Ground, p: SimulationParams, origin: int, dest: int, agent: str, far: np.ndarray, footprints: np.ndarray, ticks: int, od: dict[int, int]) -> list[int]:
    """Places of the cells that one agent enters, its origin first.

    ``od`` has the grid distances to the destination from the plan's origins (by place); it is read
    only while standing on one.
    """
    at, goal = origin, dest
    down = [j for j in ground.near[at] if far[j] < far[at]]
    heading = ground.bearing(at, min(down, key=lambda j: far[j]), p.vision_depth) if down else ground.bearing(at, goal, p.vision_depth)
    visited, stalls, left = [at], 0, 0
    boost = FOOTPRINT_GAIN * np.log1p(footprints)
    for _ in range(ticks):
        left = od.get(at, left) if at != goal else left
        if left <= 1:
            if at != goal:
                visited.append(goal)
            break
        chosen = choose(ground, p, at, agent, heading, far, boost)
        if chosen is None or chosen == at:
            stalls += 1
            if stalls >= STALLS:
                break
            continue
        stalls, last = 0, at
        for cell in ground.line(at, chosen)[1:]:
            visited.append(cell)
            last = cell
            if cell == goal:
                break
        if last == goal:
            break
        heading, at = ground.bearing(at, chosen, p.vision_depth), last
    return visited


def choose(ground: Ground, p: SimulationParams, at: int, agent: str, heading: float, far: np.ndarray, boost: np.ndarray) -> int | None:
    found, deg = ground.visible(at, p.vision_depth)
    if not len(found):
        return fallback(ground, at, far)
    angle = np.abs((deg - heading + 540) % 360 - 180)
    cone = angle <= p.field_of_view / 2
    if cone.any():
        found, angle = found[cone], angle[cone]
    cost = ground.friction[found] + far[found] - far[at]
    score = p.affordance_weight * (ground.affordance[found] + boost[found]) - p.distance_penalty * cost - W_THETA * angle / 180
    if p.temperature > 0:
        weight = np.exp((score - score.max()) / p.temperature)
        total = np.cumsum(weight)
        hit = np.flatnonzero(draw(f"{agent}:{ground.ids[at]}") * total[-1] <= total)
        return int(found[hit[0] if len(hit) else -1])
    best = np.flatnonzero(score == score.max())
    return int(found[best].min())  # places ascend with the ids


def fallback(ground: Ground, at: int, far: np.ndarray) -> int | None:
    q, r = int(ground.q[at]), int(ground.r[at])
    for ring in (1, 2, 3):
        near = [j for dq in range(-ring, ring + 1) for dr in range(max(-ring, -dq - ring), min(ring, -dq + ring) + 1) if (dq, dr) != (0, 0) and (j := ground.at.get((q + dq, r + dr))) is not None]
        near = [j for j in near if np.isfinite(far[j])]
        if near:
            return min(near, key=lambda j: (far[j], ground.order[j]))
    return None


def simulate(cells: pd.DataFrame, plan: list[tuple[int, int, int, int, int]], p: SimulationParams, waves: int) -> dict[tuple[int, int], int]:
    """Visits by (dest, cell); ``plan`` has origin, dest, assigned, grid distance and ticks of each pair."""
    ground = Ground.of(cells)
    at = {c: i for i, c in enumerate(ground.ids.tolist())}
    visits: dict[tuple[int, int], int] = {}
    for wave in range(waves):
        footprints = np.zeros(len(ground.ids))
        for (_, cell), n in visits.items():
            footprints[at[cell]] += n
        new: list[tuple[int, int]] = []
        for origin, dest, assigned, _, ticks in plan:
            od = {at[o]: g for o, d, _, g, _ in plan if d == dest}
            for i in range(assigned // waves + (wave < assigned % waves)):
                seen = walk(ground, p, at[origin], at[dest], f"{origin}:{dest}:{i}" + (f":{wave}" if p.wave_in_seed else ""), ground.distances(dest), footprints, ticks, od)
                new += [(dest, int(ground.ids[x])) for x in seen]
        for key in new:
            visits[key] = visits.get(key, 0) + 1
    return visits
