"""Filling fixed-capacity containers with items of varying length.

Rows are dealt by a seeded hash of their ids into groups of bounded expected size; each group is packed on its own by
first-fit decreasing, where a tournament tree over the containers' free space finds the leftmost
container with room in logarithmic time. Only (id, size) is shuffled. With groups of tens of
thousands of items the at most one badly filled container per group doesn't count.

Defined results
---------------
* An item larger than the capacity is cut into full pieces, each alone in its container, and a
  rest that is packed like any other item. No other item is cut.
* Items of size 0 (null or empty texts) take no space; they stand in a group's first container.
* Repeated rows are items of their own. A capacity that is null or below 1 takes no items.
* Ties in size are broken by id, then piece.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expected items per group.
GROUP_ITEMS = 20_000
SEED = 20240229


class Tournament:
    """Free space of containers as leaves of a winner tree."""

    def __init__(self, capacity: int, containers: int):
        self.leaves = 1 << max(0, containers - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the leftmost container with room and return its number."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        out = at - self.leaves
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return out


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size; sizes must be at most the capacity and come in falling order."""
    if not sizes:
        return []
    tree = Tournament(capacity, min(len(sizes), 2 * sum(sizes) // capacity + 2))
    return [tree.place(s) for s in sizes]


def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, window, group = int(pdf["capacity"].iloc[0]), pdf["window_id"].iloc[0], int(pdf["grp"].iloc[0])
    pdf = pdf.sort_values(["n_tokens", "item"], ascending=[False, True], kind="stable")
    rest, full = [], []
    for item, n in zip(pdf["item"].tolist(), pdf["n_tokens"].tolist()):
        whole = n // capacity if n > capacity else 0
        full += [(item, k, k * capacity, capacity) for k in range(whole)]
        if n - whole * capacity or not n:
            rest.append((item, whole, whole * capacity, n - whole * capacity))
    rest.sort(key=lambda x: -x[3])
    bins = first_fit_decreasing([x[3] for x in rest], capacity)
    used = max(bins, default=-1) + 1
    rows = [(b, *x) for b, x in zip(bins, rest)] + [(used + i, *x) for i, x in enumerate(full)]
    out = pd.DataFrame(rows, columns=["container_id", "item", "piece_no", "token_start", "n_tokens"])
    out["container_id"] += group << 32
    out.insert(0, "window_id", window)
    out.insert(1, "capacity_tokens", capacity)
    return out


def pack(sizes: DataFrame, id_col: str, capacities: list[tuple[int, int]], n_items: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pack (id, n_tokens) rows for each (window_id, capacity) of a short list of windows.

    ``n_items`` sizes the groups. A container's id is unique within its window.
    """
    groups = max(1, -(-n_items // group_items))
    kind = sizes.schema[id_col].dataType.simpleString()
    windows = [(w, c) for w, c in capacities if c is not None and c >= 1]
    if not windows:
        windows, sizes = [(0, 1)], sizes.where(F.lit(False))
    each = F.array(*[F.struct(F.lit(int(w)).alias("window_id"), F.lit(int(c)).alias("capacity")) for w, c in windows])
    items = sizes.select(F.col(id_col).alias("item"), "n_tokens", F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col), F.lit(groups)), F.lit(groups)).alias("grp"))  # by id, so that a task that runs again deals alike
    items = items.select("item", "n_tokens", "grp", F.inline(each))
    out = items.groupBy("window_id", "grp").applyInPandas(
        lambda pdf: pack_group(pdf), f"window_id int, capacity_tokens int, container_id long, item {kind}, piece_no int, token_start long, n_tokens long"
    )
    return out.withColumnRenamed("item", id_col)


def fill(packed: DataFrame) -> DataFrame:
    """Per window: containers used, the least number that could do, and the share of space used."""
    return (
        packed.groupBy("window_id", "capacity_tokens", "container_id")
        .agg(F.sum("n_tokens").alias("n"))
        .groupBy("window_id", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
        .withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )
