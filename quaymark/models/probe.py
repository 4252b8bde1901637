"""Which columns carry a target: forest importances of every group in the same job.

A group is an instrument, feature set and task. Its trees are dealt out in chunks, so (group, chunk) pairs run side by
side and the driver loops over nothing. A group's rows are one calendar at most (a row per day), which one task holds
easily. Trees grow level by level on binned columns; variance is the impurity, which for a 0/1 target is half of Gini's.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config

TREES = 200
DEPTH = 6
LEAST = 5
BINS = 64
#: Trees of a group that one task grows.
CHUNK = 25


def binned(values: np.ndarray) -> np.ndarray:
    """Each column as quantile bin numbers."""
    shares = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(values, shares, axis=0)
    return np.stack([np.searchsorted(np.unique(edges[:, j]), values[:, j], "left") for j in range(values.shape[1])], 1)


def tree_gains(codes: np.ndarray, target: np.ndarray, rng: np.random.Generator, tried: int) -> np.ndarray:
    """One tree on a bootstrap sample: the share of all impurity decrease that each column brought.

    Where a split tries some columns only, the cells of the others are not counted.
    """
    n, width = codes.shape
    weight = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
    rows = np.flatnonzero(weight)
    codes, weight, target = codes[rows], weight[rows], target[rows]
    node, nodes, gains = np.zeros(len(rows), np.int64), 1, np.zeros(width)
    for _ in range(DEPTH):
        columns, own = np.broadcast_to(np.arange(width), (nodes, width)), codes
        if tried < width:
            drawn = rng.random((nodes, width)).argsort(1).argsort(1) < tried
            columns = drawn.nonzero()[1].reshape(nodes, tried)
            own = np.take_along_axis(codes, columns[node], 1)
        cell = ((node[:, None] * tried + np.arange(tried)) * BINS + own).ravel()
        counts, sums = (
            np.bincount(cell, np.repeat(v, tried), nodes * tried * BINS).reshape(nodes, tried, BINS)
            for v in (weight, weight * target)
        )
        count, total = counts.cumsum(2), sums.cumsum(2)
        every, whole = count[:, :, -1:], total[:, :, -1:]
        fits = (count >= LEAST) & (every - count >= LEAST)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = total**2 / count + (whole - total) ** 2 / (every - count) - whole**2 / every
        gain = np.where(fits, gain, 0.0).reshape(nodes, -1)
        best = gain.argmax(1)
        value = gain[np.arange(nodes), best]
        split = value > 1e-15
        if not split.any():
            break
        feature, cut = columns[np.arange(nodes), best // BINS], best % BINS
        np.add.at(gains, feature[split], value[split])
        stays = split[node]
        codes, weight, target, node = codes[stays], weight[stays], target[stays], node[stays]
        above = codes[np.arange(len(node)), feature[node]] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + above
        nodes = 2 * int(split.sum())
    return gains / gains.sum() if gains.sum() else gains


def importances(rows: DataFrame, *keys: str, vector: str = "x", target: str = "y", trees: int = TREES) -> DataFrame:
    """(keys, place, importance): mean share of every position of ``vector``; all positions tried at a split for
    ``task = 'regression'``, as many as the root of their number otherwise."""
    chunks = -(-trees // CHUNK)
    dealt = rows.select(*keys, "date", vector, target, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))
    at = (*keys, "_chunk")

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        names, chunk = dict(zip(at, key)), int(key[-1])
        codes = binned(np.stack(group[vector].to_numpy()))
        wanted = group[target].to_numpy(float)
        width = codes.shape[1]
        tried = width if names.get("task") == "regression" else max(1, int(np.sqrt(width)))
        share, count = np.zeros(width), min(CHUNK, trees - chunk * CHUNK)
        for t in range(count):
            rng = np.random.default_rng([config.RANDOM_SEED, chunk * CHUNK + t])
            share += tree_gains(codes, wanted - wanted.mean(), rng, tried)
        out = pd.DataFrame({"place": np.arange(width, dtype=np.int32), "share": share})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "place", "share"]]

    kinds = dict(rows.dtypes)
    form = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["place int", "share double"])
    grown = dealt.groupBy(*at).applyInPandas(grow, form)
    return grown.groupBy(*keys, "place").agg((F.sum("share") / trees).alias("importance"))


def best_places(found: DataFrame, *keys: str, top: int = config.TOP_FEATURES) -> DataFrame:
    """(keys, places): the positions of the ``top`` importances, the greatest first; the earlier one wins a tie."""
    order = Window.partitionBy(*keys).orderBy(F.desc("importance"), "place")
    ranked = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top)
    listed = F.sort_array(F.collect_list(F.struct("_rank", "place")))
    return ranked.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.col("_l.place").alias("places"))


def at_places(vector: Column, places: Column) -> Column:
    return F.transform(places, lambda k: F.get(vector, k))


