"""Bounded heaps over arrays: the first k of each group, in one call for many groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A group's candidates from many tasks are first merged in so many parts.
PARTS = 32


class Heaps:
    """The k highest of each group; equal scores by ascending id, null ids last."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.floor = np.full(groups, np.iinfo(np.int64).min)  # of a full group, its last score

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        near = score >= self.floor[group]
        if not near.any():
            return
        group, score, ids, null = (np.concatenate([a, b[near]]) for a, b in ((self.group, group), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, group))
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        kept = order[place < self.k]
        self.group, self.score, self.id, self.null = group[kept], score[kept], ids[kept], null[kept]
        full = order[place == self.k - 1]
        self.floor[group[full]] = score[full]


def merged(candidates: DataFrame, group: list[str], k: int, part) -> DataFrame:
    """The first k of each group by score and id, with rank; part: a column that divides a group's candidates, so that
    no task sorts all of a group's at once."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = candidates.withColumn("_part", F.pmod(part, F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k).drop("_part")
