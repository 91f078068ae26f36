"""k-means of many tables at once (G8 / G9): all reference draws of one k in the same jobs.

The points (``draw``: which table a point is of, ``x``: array of doubles) are packed into blocks once.  Every step
is one job over the points of all draws: a task keeps, per draw, what it needs of its points (the least sampling
keys, or counts and sums per centre), so what is shuffled and what reaches the driver are draws x k rows,
however many points there are.  The number of jobs does not depend on the number of draws.

The start is k-means|| (weighted samples far from what is chosen already, two rounds, then k-means++ on
the weighted candidates), the iteration Lloyd's; a draw whose centres have come to rest keeps them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 2  # of k-means||
OVERSAMPLE = 2  # candidates per round, as a multiple of k
BLOCK = 1 << 20  # distances that a task holds at once
BLOCK_POINTS = 4096


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres."""
    return ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)


def in_blocks(tables: DataFrame) -> DataFrame:
    """Points (draw, x) as blocks (draw, d, points): matrices of up to ``BLOCK_POINTS`` points as bytes, which later
    passes read without taking each point apart."""
    def pack(frames):
        held: dict = {}

        def row(draw):
            x = np.concatenate(held.pop(draw))
            return pd.DataFrame({"draw": [draw], "d": [x.shape[1]], "points": [x.tobytes()]})

        for pdf in frames:
            for draw, part in pdf.groupby("draw", sort=True):
                held.setdefault(int(draw), []).append(np.stack(part["x"].to_list()))
                if sum(map(len, held[int(draw)])) >= BLOCK_POINTS:
                    yield row(int(draw))
        for draw in sorted(held):
            yield row(draw)

    return tables.mapInPandas(pack, "draw int, d int, points binary")


def _points(frames, width: int):
    """The points of a task's blocks, a bounded number at a time, and a number that is the block's own."""
    for pdf in frames:
        for draw, d, raw in zip(pdf["draw"], pdf["d"], pdf["points"]):
            x = np.frombuffer(raw, np.float64).reshape(-1, d)
            step = max(1, BLOCK // max(1, width * d))
            for at in range(0, len(x), step):
                yield int(draw), x[at:at + step], zlib.crc32(raw) + at


def _far_points(blocks: DataFrame, chosen: dict[int, np.ndarray], n: int, seed: int) -> dict[int, np.ndarray]:
    """Per draw, n points drawn without replacement, with chances in proportion to their squared distance to the
    nearest chosen point (all alike where nothing is chosen): those with the least of exponential keys."""
    shared = blocks.sparkSession.sparkContext.broadcast(chosen)

    def per_task(frames):
        held: dict = {}
        for draw, x, own in _points(frames, max([1, *map(len, shared.value.values())])):
            far = distances(x, shared.value[draw]).min(axis=1) if draw in shared.value else np.ones(len(x))
            cost = np.full(len(x), np.inf)
            np.divide(np.random.default_rng([seed, draw, own]).exponential(size=len(x)), far, out=cost, where=far > 0)
            old_cost, old_x = held.get(draw, (np.empty(0), x[:0]))
            cost, x = np.concatenate([old_cost, cost]), np.concatenate([old_x, x])
            first = np.argsort(cost, kind="stable")[:n]
            held[draw] = cost[first], x[first]
        for draw, (cost, x) in held.items():
            far = np.isfinite(cost)
            if far.any():
                yield pd.DataFrame({"draw": draw, "cost": cost[far], "x": list(x[far])})

    tops = blocks.mapInPandas(per_task, "draw int, cost double, x array<double>")
    place = F.row_number().over(Window.partitionBy("draw").orderBy("cost"))  # n rows per draw and task
    rows = tops.withColumn("place", place).where(F.col("place") <= n).collect()  # n per draw
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["cost"]):
        out.setdefault(r["draw"], []).append(r["x"])
    return {d: np.array(x) for d, x in out.items()}


def _sums(blocks: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per draw: points and sum of points of each centre's cell, and the sum of squared distances."""
    shared = blocks.sparkSession.sparkContext.broadcast(centers)

    def per_task(frames):
        total: dict = {}  # draw -> per centre: points, squared distances, sum of points
        for draw, x, _ in _points(frames, max([1, *map(len, shared.value.values())])):
            d = distances(x, shared.value[draw])
            near = d.argmin(axis=1)
            own = np.column_stack([np.ones(len(x)), d[np.arange(len(x)), near], x])
            k = len(shared.value[draw])
            total[draw] = total.get(draw, 0) + np.stack([np.bincount(near, own[:, j], minlength=k) for j in range(own.shape[1])], axis=1)
        for draw, t in total.items():
            c, j = np.nonzero(np.broadcast_to(t[:, :1] > 0, t.shape))
            yield pd.DataFrame({"draw": draw, "c": c, "j": j, "v": t[c, j]})

    sums = blocks.mapInPandas(per_task, "draw int, c int, j int, v double").groupBy("draw", "c", "j").agg(F.sum("v").alias("v"))
    found = {d: np.zeros((len(c), c.shape[1] + 2)) for d, c in centers.items()}
    for r in sums.collect():  # draws x k x (d + 2) numbers
        found[r["draw"]][r["c"], r["j"]] = r["v"]
    return {d: (t[:, 0], t[:, 2:], float(t[:, 1].sum())) for d, t in found.items()}


def plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ and a few rounds of Lloyd on few weighted points; fewer distinct points give fewer centres."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        chance = distances(points, np.array(chosen)).min(axis=1) * weights
        if not chance.sum() > 0:
            break
        chosen.append(points[rng.choice(len(points), p=chance / chance.sum())])
    centers = np.array(chosen)
    for _ in range(30):
        near = distances(points, centers).argmin(axis=1)
        for c in range(len(centers)):
            if weights[near == c].sum() > 0:
                centers[c] = np.average(points[near == c], axis=0, weights=weights[near == c])
    return centers


def batched_kmeans(blocks: DataFrame, k: int, seed: int = 42, max_iter: int = 20, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Per draw of ``blocks`` (``in_blocks`` of points): its centres (k x d) and its inertia against them.

    Points must not be null and of one length; a draw without points has no entry, one of fewer than k distinct
    points fewer centres.  Centres are draws x k x d numbers on the driver.  Samples depend on what a block
    holds, so a lost task draws the same ones again where the blocks are a stored table.
    """
    candidates = _far_points(blocks, {}, 1, seed)
    for r in range(ROUNDS):
        more = _far_points(blocks, candidates, OVERSAMPLE * k, seed + r + 1)
        candidates = {d: np.concatenate([c, more[d]]) if d in more else c for d, c in candidates.items()}
    if not candidates:
        return {}
    weights = _sums(blocks, candidates)
    centers = {d: plus_plus(c, np.maximum(weights[d][0], 1e-9), k, seed + d) for d, c in candidates.items()}
    moving = set(centers)
    for _ in range(max_iter):
        if not moving:
            break
        now = {d: centers[d] for d in sorted(moving)}
        for d, (n, s, _) in _sums(blocks.where(F.col("draw").isin(list(now))), now).items():
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centers[d])
            if (((new - centers[d]) ** 2).sum(axis=1) <= tol * tol).all():
                moving.discard(d)
            centers[d] = new
    return {d: (centers[d], w) for d, (_, _, w) in _sums(blocks, centers).items()}
