"""Deterministic graph layouts as expressions, and organic trees per key."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.plans.lineage import numbered, numbered_within, scalar

GOLDEN = math.pi * (3.0 - math.sqrt(5.0))


def sphere_point(i: Column, n: Column, radius: Column) -> tuple[Column, Column, Column]:
    """Point ``i`` of ``n`` on a golden-angle sphere; a single one is the pole."""
    y = 1 - i / F.greatest(F.lit(1), n - 1) * 2
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    one = n <= 1
    return F.when(one, 0.0).otherwise(radius * flat * F.cos(GOLDEN * i)), F.when(one, 0.0).otherwise(radius * y), F.when(one, radius).otherwise(radius * flat * F.sin(GOLDEN * i))


def ring_point(i: Column, n: Column, inner: Column, outer: Column) -> tuple[Column, Column]:
    """Point ``i`` of ``n`` in a flat ring; a single one is midway out."""
    r = inner + i * (outer - inner) / F.greatest(F.lit(1), n - 1)
    return F.when(n <= 1, (inner + outer) / 2).otherwise(r * F.cos(GOLDEN * i)), F.when(n <= 1, 0.0).otherwise(r * F.sin(GOLDEN * i))


def funnel(nodes: DataFrame, levels: dict[str, int], layer_gap: float = 10.0, spacing: float = 0.5, sizes: dict[int, float] | None = None, default_level: int = 0, default_size: float = 1.0, order: Sequence[str] = ("id",)) -> DataFrame:
    """(id, x, y, z): a golden spiral for each level, at the level's height."""
    level = F.lit(default_level)
    for kind, at in levels.items():
        level = F.when(F.col("kind") == kind, at).otherwise(level)
    size = F.lit(default_size)
    for at, s in (sizes or {}).items():
        size = F.when(F.col("level") == at, s).otherwise(size)
    rows = numbered_within(nodes.withColumn("level", level), ["level"], [*map(F.asc, order)], "rn", "n").withColumn("i", (F.col("rn") - 1).cast("double"))
    radius = F.greatest(F.lit(4.0), F.lit(spacing) * size * F.sqrt("n"))
    r = radius * F.sqrt(F.col("i") / F.greatest(F.lit(1), F.col("n") - 1))
    return rows.select("id", (r * F.cos(GOLDEN * F.col("i"))).alias("x"), (r * F.sin(GOLDEN * F.col("i"))).alias("y"), (F.col("level") * layer_gap).cast("double").alias("z"))


def allium(nodes: DataFrame, edges: DataFrame, stem: float = 8.0, head: float = 2.0, orbit: float = 0.8, inner: float = 8.0, outer: float = 20.0, root_kind: str = "module", contains: str = "CONTAINS") -> DataFrame:
    """(id, x, y, z): roots in a ring, children on a sphere over their root, grandchildren
    around their parent, the rest on a small sphere. Slots go by id; of several places the
    deepest, then that of the largest root, holds."""
    inside = edges.where(F.col("rel") == contains).select("src", "dst").distinct()
    ids = nodes.select("id", "kind")
    roots = ids.where(F.col("kind") == root_kind).select("id")
    if roots.isEmpty():
        roots = ids.join(inside.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id")
    n = scalar(roots, F.count("*").alias("n"))
    ringed = numbered(roots, [F.asc("id")], "rn").crossJoin(n)
    x, y = ring_point((F.col("rn") - 1).cast("double"), F.col("n"), F.lit(inner), F.greatest(F.lit(outer), inner + F.sqrt("n") * 4))
    base = ringed.select("id", x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("depth"), F.col("id").alias("root"))

    def around(parents: DataFrame, radius0: float, growth: float, lift: float | None, depth: int) -> DataFrame:
        kids = parents.select(F.col("id").alias("src"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "root").join(inside, "src").join(ids.select(F.col("id").alias("dst")), "dst")
        placed = numbered_within(kids, ["root", "src"], [F.asc("dst")], "nth", "size").withColumn("i", (F.col("nth") - 1).cast("double"))
        dx, dy, dz = sphere_point(F.col("i"), F.col("size"), F.lit(radius0) + F.sqrt("size") * growth)
        height = F.lit(lift) if lift is not None else F.col("pz")
        return placed.select(F.col("dst").alias("id"), (F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y"), (height + dz).alias("z"), F.lit(depth).alias("depth"), "root")

    heads = around(base, head, 0.4, stem, 1)
    tips = around(heads, orbit, 0.15, None, 2)
    best = base.unionByName(heads).unionByName(tips).groupBy("id").agg(F.max(F.struct("depth", "root", "x", "y", "z")).alias("at"))
    placed = best.select("id", *(F.col(f"at.{c}").alias(c) for c in "xyz"))
    orphans = ids.join(placed.select("id"), "id", "left_anti").select("id")
    m = scalar(orphans, F.count("*").alias("n"))
    ox, oy, oz = sphere_point((F.col("rn") - 1).cast("double"), F.col("n"), F.lit(3.0))
    return placed.unionByName(numbered(orphans, [F.asc("id")], "rn").crossJoin(m).select("id", ox.alias("x"), oy.alias("y"), (oz + 3.0).alias("z")))


def seed_of(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=4).digest(), "big")


SKELETON = "tree_key string, idx int, parent int, x double, y double, z double, radius double"


def grow(points: DataFrame, step: float = 0.5, reach: float = 6.0, kill: float = 1.0, rounds: int = 200, exponent: float = 2.2, tip_radius: float = 0.02) -> DataFrame:
    """A skeleton for each tree_key whose branches grow towards its points (x, y, z).

    Space colonisation is sequential, so a tree is grown by one task; its radii follow
    the pipe rule from the tips down. A node's radius to the ``exponent`` is the sum of
    its children's.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["tree_key"].iloc[0]
        rng = np.random.default_rng(seed_of(key))
        goals = pdf.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
        nodes, parents = [np.zeros(3)], [-1]
        for _ in range(rounds):
            if not len(goals):
                break
            at = np.array(nodes)
            gap = np.linalg.norm(goals[:, None] - at[None], axis=2)
            near = gap.argmin(1)
            pulled = gap.min(1) <= reach
            if not pulled.any():
                # nothing in reach: the tip nearest to a goal grows towards it
                g = int(gap.min(1).argmin())
                pulled[g] = True
            grown = False
            for i in np.unique(near[pulled]):
                way = goals[pulled & (near == i)] - at[i]
                way = (way / np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-9)).mean(0) + rng.normal(0, 0.05, 3)
                new = at[i] + step * way / max(np.linalg.norm(way), 1e-9)
                if np.linalg.norm(np.array(nodes) - new, axis=1).min() > step / 10:
                    nodes.append(new)
                    parents.append(int(i))
                    grown = True
            goals = goals[np.linalg.norm(goals[:, None] - np.array(nodes)[None], axis=2).min(1) > kill]
            if not grown:
                break
        load = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            load[i] = load[i] or tip_radius**exponent
            if parents[i] >= 0:
                load[parents[i]] += load[i]
        xyz = np.array(nodes)
        return pd.DataFrame({"tree_key": key, "idx": range(len(nodes)), "parent": parents, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "radius": load ** (1 / exponent)})

    return points.groupBy("tree_key").applyInPandas(one, SKELETON)


def root_to_tip_paths(skeleton: DataFrame) -> DataFrame:
    """(tree_key, tip, path): node indexes from the root to each tip."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(pdf["idx"], pdf["parent"], strict=True))
        tips = sorted(set(parent) - set(parent.values()))
        paths = []
        for t in tips:
            path = [t]
            while parent[path[-1]] >= 0:
                path.append(parent[path[-1]])
            paths.append([int(i) for i in reversed(path)])
        return pd.DataFrame({"tree_key": pdf["tree_key"].iloc[0], "tip": tips, "path": paths})

    return skeleton.groupBy("tree_key").applyInPandas(one, "tree_key string, tip int, path array<int>")


def nearest_node(leaves: DataFrame, skeleton: DataFrame) -> DataFrame:
    """(tree_key, leaf, idx, distance): the skeleton node nearest to each leaf of its tree."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"tree_key": pd.Series(dtype=object), "leaf": pd.Series(dtype=object), "idx": pd.Series(dtype="int32"), "distance": pd.Series(dtype="float64")})
        at = right.sort_values("idx")
        own, found, far = at[["x", "y", "z"]].to_numpy(float), [], []
        for p in left[["x", "y", "z"]].to_numpy(float):
            d = np.linalg.norm(own - p, axis=1)
            found.append(int(at["idx"].iloc[int(d.argmin())]))
            far.append(float(d.min()))
        return pd.DataFrame({"tree_key": left["tree_key"], "leaf": left["leaf"], "idx": found, "distance": far})

    return leaves.groupBy("tree_key").cogroup(skeleton.groupBy("tree_key")).applyInPandas(one, "tree_key string, leaf string, idx int, distance double")


def limb_paths(skeleton: DataFrame) -> DataFrame:
    """(tree_key, start, path): stretches between forks; each begins at its fork."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        children: dict[int, list[int]] = {}
        for i, p in zip(pdf["idx"], pdf["parent"], strict=True):
            children.setdefault(int(p), []).append(int(i))
        starts, paths, todo = [], [], [(-1, r) for r in children.get(-1, [])]
        while todo:
            fork, at = todo.pop()
            path = [at] if fork < 0 else [fork, at]
            while len(kids := children.get(path[-1], [])) == 1:
                path.append(kids[0])
            todo += [(path[-1], k) for k in kids]
            starts.append(path[0])
            paths.append(path)
        return pd.DataFrame({"tree_key": pdf["tree_key"].iloc[0], "start": starts, "path": paths})

    return skeleton.groupBy("tree_key").applyInPandas(one, "tree_key string, start int, path array<int>")


def _spline(points: np.ndarray, steps: int) -> np.ndarray:
    """Catmull-Rom curve through ``points``, which stay on it."""
    if len(points) < 3:
        return points
    p = np.vstack([2 * points[0] - points[1], points, 2 * points[-1] - points[-2]])
    t = np.linspace(0, 1, steps, endpoint=False)[:, None]
    out = [0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t**2 + (3 * b - a - 3 * c + d) * t**3) for a, b, c, d in zip(p, p[1:], p[2:], p[3:], strict=False)]
    return np.vstack([*out, points[-1:]])


def smooth_paths(skeleton: DataFrame, steps: int = 4) -> DataFrame:
    """(tree_key, tip, i, x, y, z): splines along the paths from the root to each tip."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parent, at = dict(zip(pdf["idx"], pdf["parent"], strict=True)), pdf.set_index("idx")[["x", "y", "z"]]
        parts = []
        for tip in sorted(set(parent) - set(parent.values())):
            path = [tip]
            while parent[path[-1]] >= 0:
                path.append(parent[path[-1]])
            curve = _spline(at.loc[path[::-1]].to_numpy(float), steps)
            parts.append(pd.DataFrame({"tree_key": pdf["tree_key"].iloc[0], "tip": int(tip), "i": range(len(curve)), "x": curve[:, 0], "y": curve[:, 1], "z": curve[:, 2]}))
        return pd.concat(parts)

    return skeleton.groupBy("tree_key").applyInPandas(one, "tree_key string, tip int, i int, x double, y double, z double")


def crown_spacing(points: DataFrame, probes: int = 512) -> DataFrame:
    """(tree_key, spacing): median distance of a point to its nearest one, from evenly spaced probes."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
        some = np.unique(np.linspace(0, len(p) - 1, min(probes, len(p))).round().astype(int))
        near = []
        for i in some:
            d = np.linalg.norm(p - p[i], axis=1)
            d[i] = np.inf
            near.append(d.min())
        return pd.DataFrame({"tree_key": [pdf["tree_key"].iloc[0]], "spacing": [float(np.median(near)) if len(p) > 1 else 0.0]})

    return points.groupBy("tree_key").applyInPandas(one, "tree_key string, spacing double")


def frame(points: DataFrame) -> DataFrame:
    """The box around all points: its centre and radius."""
    lo = {c: F.min(c) for c in "xyz"}
    hi = {c: F.max(c) for c in "xyz"}
    half = [(hi[c] - lo[c]) / 2 for c in "xyz"]
    return points.agg(*(((hi[c] + lo[c]) / 2).alias(f"c{c}") for c in "xyz"), F.sqrt(half[0] * half[0] + half[1] * half[1] + half[2] * half[2]).alias("radius"))
