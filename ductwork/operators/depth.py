"""Depth profiles: the cheapest depths along each chain of crossing zones, by a dynamic program per chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductwork.rules import DEPTH

#: Cost of a bend, the pull of every metre towards the normal depth, and the part of the steepest slope that is used.
BEND, PULL = 1.0, 0.001
SLOPE = DEPTH["max_slope"] * 0.998


def allowed_ranges(floor: float, crossings: list[tuple[float, float, float]], height: float, deepest: float = 10.0) -> list[tuple[float, float]]:
    """Depths of a pipe's top that clear all crossings (top, height, clearance): above or below each, at least at the floor."""
    ranges = [(floor, deepest)]
    for top, own, clear in crossings:
        free = [(-1.0, top - clear - height), (top + own + clear, deepest)]
        ranges = [(max(a, c), min(b, d)) for a, b in ranges for c, d in free if max(a, c) <= min(b, d) + 1e-12]
    return ranges


def k_depth(h: np.ndarray | float) -> np.ndarray | float:
    """Cost factor of a depth: every metre off the normal one adds k_per_m."""
    return 1 + DEPTH["k_per_m"] * np.abs(h - DEPTH["normal_m"])


def candidates(zones: pd.DataFrame) -> list[np.ndarray]:
    """Per zone: the ends of its ranges, the normal depth, and what slopes from other zones' ends reach."""
    ends = [sorted({v for lo, hi in r for v in (lo, hi)} | {DEPTH["normal_m"]}) for r in zones.ranges]
    mid = ((zones.lo + zones.hi) / 2).to_numpy()
    out = []
    for i, own in enumerate(zones.ranges):
        deepest = max(hi for _, hi in own) if own else 0.0
        near = [j for j in range(len(mid)) if j != i and SLOPE * abs(mid[i] - mid[j]) <= deepest + 1]  # from farther away every depth can be reached
        more = {e + s * SLOPE * abs(mid[i] - mid[j]) for j in near for e in ends[j] for s in (-1, 1)}
        out.append(np.array(sorted(v for v in set(ends[i]) | more if any(lo - 1e-9 <= v <= hi + 1e-9 for lo, hi in own))))
    return out


def solve_chain(zones: pd.DataFrame) -> pd.DataFrame:
    """zone_no, depth, cost of one chain, in order; depth is null if no profile keeps the slope. zones: zone_no, lo, hi, price, ranges."""
    zones = zones.sort_values("zone_no").reset_index(drop=True)
    zones["ranges"] = [[(r["lo"], r["hi"]) if isinstance(r, dict) else tuple(r) for r in own] for own in zones["ranges"]]
    own = candidates(zones)
    length = (zones.hi - zones.lo).to_numpy()
    best, back = [], []
    for i, h in enumerate(own):
        here = length[i] * zones.price[i] * k_depth(h) + PULL * length[i] * np.abs(h - DEPTH["normal_m"])
        if i == 0:
            best.append(here)
            back.append(np.zeros(len(h), int))
            continue
        gap = zones.lo[i] - zones.hi[i - 1]
        change = np.abs(h[None, :] - own[i - 1][:, None])
        step = gap * zones.price[i] * (k_depth(h)[None, :] + k_depth(own[i - 1])[:, None]) / 2 + np.where(change > 1e-9, 2 * BEND, 0)
        total = np.where(change <= SLOPE * gap + 1e-9, best[i - 1][:, None] + step, np.inf)
        if not total.size or not np.isfinite(total).any():
            return pd.DataFrame({"zone_no": zones.zone_no, "depth": np.nan, "cost": np.nan})
        back.append(total.argmin(0))
        best.append(total.min(0) + here)
    if not len(own) or not best[-1].size:
        return pd.DataFrame({"zone_no": zones.zone_no, "depth": np.nan, "cost": np.nan})
    at, picked = int(best[-1].argmin()), []
    for i in range(len(own) - 1, -1, -1):
        picked.append(own[i][at])
        at = int(back[i][at])
    return pd.DataFrame({"zone_no": zones.zone_no, "depth": picked[::-1], "cost": float(best[-1].min())})


def profiles(zones: DataFrame) -> DataFrame:
    """chain_id, zone_no, depth, cost for all chains. zones: chain_id, zone_no, lo, hi (stations), price, ranges (array of struct(lo, hi)).

    A chain runs between two chambers, so it is small; chains spread over the cluster."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve_chain(pdf)
        out.insert(0, "chain_id", pdf.chain_id.iloc[0])
        return out

    return zones.groupBy("chain_id").applyInPandas(solve, "chain_id string, zone_no long, depth double, cost double")


def cheapest_states(rows: DataFrame, key: str, order: str, costs: list[Column], switch: int) -> DataFrame:
    """Least total cost per key of choosing a state at every step, where a change of state costs `switch`: key, total.

    The min-plus recurrence runs over the key's ordered steps in one expression."""
    steps = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.array(*costs).alias("c")))).alias("steps"))
    first = F.array(*[F.lit(0).cast("long") for _ in costs])
    step = lambda acc, s: F.transform(s["c"], lambda c, i: c + F.least(F.get(acc, i), F.array_min(acc) + switch))
    return steps.select(key, F.array_min(F.aggregate("steps", first, step)).alias("total"))


def bends(profile: DataFrame) -> DataFrame:
    """chain_id, n_bends: how often a depth profile changes its slope. profile: chain_id, at, depth; of a station's depths the largest counts.

    Slopes are compared by cross products, so whole numbers stay exact; a null station or depth takes no part."""
    order = Window.partitionBy("chain_id").orderBy("at")
    stations = profile.where("at is not null and depth is not null").groupBy("chain_id", "at").agg(F.max("depth").alias("depth"))
    steps = stations.select("chain_id", "at", "depth", (F.col("at") - F.lag("at").over(order)).alias("run"), (F.col("depth") - F.lag("depth").over(order)).alias("fall"))
    bent = steps.withColumn("run0", F.lag("run").over(order)).withColumn("fall0", F.lag("fall").over(order))
    return bent.groupBy("chain_id").agg(F.count_if(F.abs(F.col("fall") * F.col("run0") - F.col("fall0") * F.col("run")) > 1e-9).alias("n_bends"))
