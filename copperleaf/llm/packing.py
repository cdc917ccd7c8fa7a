"""Problem 7: items into containers of fixed capacity.

Linear grouping. Large sizes are cut into groups of equally many items and rounded up to the greatest size of
their group; the linear program over configurations of those few sizes is solved by column generation, and its
rounded-down solution, completed by greedy configurations, says how often each configuration is used. Actual
items then take the places of their group by their number within it, which is arithmetic and no search. Small
items go by best fit into the room that is left, in independent blocks of containers.

Only two things reach the driver: the number of items of each size (at most ``capacity`` numbers) and sums.
The room left is found per container; a block holds at most BLOCK containers and about BLOCK_ITEMS items.

Results for odd input: sizes null or negative count as 0; items of size 0 take no room and are spread over the
containers; an item larger than the capacity is split into full containers and a rest that is packed as an
item; repeated keys are items of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperleaf.session import materialize

GROUPS = 40
#: Items of at most this share of the capacity are small.
SMALL = 1 / 10
BLOCK = 2_000
BLOCK_ITEMS = 50_000
#: Items of a group are numbered within buckets of about so many.
BUCKET_ITEMS = 20_000


def group_sizes(counts: np.ndarray, least: int, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Of the items larger than ``least``: the greatest size and the number of items of each group, sizes ascending.

    ``counts[s]`` is the number of items of size s. Equal sizes stay together, so a group can be larger than its share.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > least]
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = counts[sizes]
    share = (np.cumsum(n) - n) * groups // n.sum()
    last = np.append(np.flatnonzero(share[1:] != share[:-1]), len(sizes) - 1)
    return sizes[last], np.diff(np.cumsum(n)[last], prepend=0)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest worth: at most ``most`` of each size, together at most the capacity."""
    value, taken = np.zeros(capacity + 1), []
    for s, w, m in zip(sizes.tolist(), worth.tolist(), most.tolist()):
        how = np.zeros(capacity + 1, np.int64)
        base = value.copy()
        if w > 0:
            for k in range(1, min(m, capacity // s) + 1):
                better = base[: capacity + 1 - k * s] + k * w
                at = np.flatnonzero(better > value[k * s :] + 1e-12)
                value[k * s + at], how[k * s + at] = better[at], k
        taken.append(how)
    room, out = int(value.argmax()), np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = taken[i][room]
        room -= out[i] * int(sizes[i])
    return out


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, *, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """(times, items of each size) that hold ``need`` items of each size in nearly as few containers as can be."""
    k = len(sizes)
    if not k:
        return []
    columns = [np.eye(k, dtype=np.int64)[i] * max(1, capacity // int(sizes[i])) for i in range(k)]
    basis = np.array(columns, float).T
    x = need / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        new = _best_configuration(sizes, worth, np.full(k, capacity), capacity)
        if worth @ new < 1 + 1e-6:
            break
        direction = np.linalg.solve(basis, new.astype(float))
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        basis[:, out], columns[out] = new, new
    plan = [(int(t), c) for t, c in zip(np.floor(x + 1e-9), columns) if t >= 1]
    left = need - sum((t * c for t, c in plan), np.zeros(k, np.int64))
    if (left < 0).any():  # more places than items: take the rest off the plan
        plan, left = [], need.copy()
        for t, c in zip(np.floor(x + 1e-9).astype(np.int64), columns):
            some = c > 0
            t = int(min(t, (left[some] // c[some]).min())) if some.any() else 0
            if t:
                plan.append((t, c))
                left = left - t * c
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        one = np.zeros(k, np.int64)
        one[largest] = 1
        most = left - one
        more = _best_configuration(sizes, sizes.astype(float), most, capacity - int(sizes[largest]))
        c = one + more
        times = int((left[c > 0] // c[c > 0]).min())
        plan.append((times, c))
        left = left - times * c
    return plan


def _best_fit(room: list[tuple[int, int]], sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Of each size, largest first, the container: the fullest that still takes it, else a new one (-1, -2, ...)."""
    room = sorted(room)
    out, new = [], 0
    for s in sizes:
        at = bisect_left(room, (s, -(2**62)))
        if at < len(room):
            left, container = room.pop(at)
        else:
            new += 1
            left, container = capacity, -new
        out.append(container)
        if left > s:
            insort(room, (left - s, container))
    return out, new


def pack(items: DataFrame, key: str, size: str, capacity: int, *, groups: int = GROUPS) -> DataFrame:
    """(key, piece, start, size, sequence_id, position) of every item.

    ``piece`` counts the parts of a split item, ``start`` is where a part starts in the item, ``position`` where
    it lies in its container. Other columns don't come out.
    """
    k = F.col(f"`{key}`")
    rows = items.select(k.alias("__k"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("__s"))
    cut = F.floor((F.greatest(F.col("__s"), F.lit(1)) - 1) / capacity)  # the last part's number
    parts = rows.select("__k", "__s", F.explode(F.sequence(F.lit(0), cut)).alias("piece"))
    parts = parts.select(
        "__k", F.col("piece").cast("long"), (F.col("piece") * capacity).alias("start"),
        F.least(F.col("__s") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n"),
    )
    parts = materialize(parts, "parts")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in parts.groupBy("n").count().collect():  # at most capacity + 1 rows
        counts[n] = c
    least = int(capacity * SMALL)
    top, need = group_sizes(counts, least, groups)
    plan = configurations(top, need, capacity)
    main = sum(t for t, _ in plan)
    placed = _place(parts.where(F.col("n") > least), top, plan, int(need.max()) if len(need) else 0)
    placed = materialize(placed, "placed") if main else placed
    small = parts.where((F.col("n") > 0) & (F.col("n") <= least))
    n_small, sum_small = int(counts[1 : least + 1].sum()), int((counts[1 : least + 1] * np.arange(1, least + 1)).sum())
    blocks = max(1, -(-max(main, sum_small // capacity) // BLOCK), -(-n_small // BLOCK_ITEMS))
    filled = _fill(placed, small, capacity, main, blocks)
    none = parts.where(F.col("n") == 0).withColumn("sequence_id", F.pmod(F.xxhash64("__k"), F.lit(max(1, main))).cast("long"))
    everything = placed.unionByName(filled).unionByName(none)
    w = Window.partitionBy("sequence_id").orderBy("__k", "piece", "start", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = everything.where("n > 0").withColumn("position", F.sum("n").over(w) - F.col("n"))
    return sized.unionByName(everything.where("n = 0").withColumn("position", F.lit(0).cast("long"))).select(
        F.col("__k").alias(key), "piece", "start", F.col("n").alias("n_tokens"), "sequence_id", "position"
    )


def _place(large: DataFrame, top: np.ndarray, plan: list[tuple[int, np.ndarray]], most: int) -> DataFrame:
    """Gives each large item, by its number within its group, a place of the plan."""
    spark = large.sparkSession
    if not plan:
        return large.withColumn("sequence_id", F.lit(0).cast("long"))
    group = F.size(F.filter(F.array(*[F.lit(int(t)) for t in top]), lambda t: t < F.col("n")))
    buckets = -(-most // BUCKET_ITEMS)
    rows = large.withColumn("__g", group).withColumn("__b", F.pmod(F.xxhash64("__k", "piece"), F.lit(buckets)).cast("int"))
    each = rows.groupBy("__g", "__b").count()
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("__g", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__g", "__b").orderBy("__k", "piece", "start", "n")
    numbered = rows.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, ["__g", "__b"])
    numbered = numbered.withColumn("__r", F.col("__r") + F.col("__before")).drop("__b", "__before")
    # per group: from which number on a configuration's places are, how many a container has, its first container
    first, start, ranges = 0, np.zeros(len(top), np.int64), []
    for times, c in plan:
        for g in np.flatnonzero(c).tolist():
            ranges.append((g, int(start[g]), int(start[g] + times * c[g]), int(c[g]), first))
            start[g] += times * c[g]
        first += times
    table = spark.createDataFrame(ranges, "__g int, __from long, __to long, __each long, __first long")
    at = F.col("__r")
    return (
        numbered.join(F.broadcast(table), "__g")  # at most groups x configurations rows, both parameters
        .where((at >= F.col("__from")) & (at < F.col("__to")))
        .select("__k", "piece", "start", "n", (F.col("__first") + F.floor((at - F.col("__from")) / F.col("__each"))).cast("long").alias("sequence_id"))
    )


def _fill(placed: DataFrame, small: DataFrame, capacity: int, main: int, blocks: int) -> DataFrame:
    """Best fit of the small items into what is left, block by block."""
    room = placed.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("n")).alias("n")).where("n > 0")
    kind = small.schema["__k"].dataType.simpleString()
    left = room.select(
        (F.col("sequence_id") % blocks).cast("int").alias("block"), F.col("sequence_id").alias("container"), F.lit(None).cast(kind).alias("__k"),
        F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.col("n"),
    )
    todo = small.select(
        F.pmod(F.xxhash64("__k", "piece"), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("long").alias("container"), "__k", "piece", "start", "n"
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        has = pdf["container"].notna()
        room = list(zip(pdf.loc[has, "n"].tolist(), pdf.loc[has, "container"].astype("int64").tolist()))
        items = pdf[~has].sort_values(["n", "__k", "piece"], ascending=[False, True, True], kind="stable")
        where, _ = _best_fit(room, items["n"].tolist(), capacity)
        block = int(pdf["block"].iloc[0])
        items = items.assign(sequence_id=[c if c >= 0 else main + block + blocks * (-c - 1) for c in where])
        return items[["__k", "piece", "start", "n", "sequence_id"]].astype({"sequence_id": "int64"})

    return left.unionByName(todo).groupBy("block").applyInPandas(fit, f"__k {kind}, piece long, start long, n long, sequence_id long")


def check_report(packed: DataFrame, key: str, capacity: int) -> DataFrame:
    """One row on the result of ``pack`` with different keys: documents, containers above capacity, items up to capacity
    that are split, pieces that overlap or leave a gap in their container, items whose pieces don't follow each other."""
    by_container = Window.partitionBy("sequence_id").orderBy("position", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    by_item = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    off = lambda at, w: (F.col(at) != F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).cast("long")
    rows = packed.withColumn("overlapping", F.when(F.col("n_tokens") > 0, off("position", by_container)).otherwise(0)).withColumn("gap", off("start", by_item))
    items = rows.groupBy(key).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("size"))
    split = items.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(((F.col("pieces") > 1) & (F.col("size") <= capacity)).cast("long")), F.lit(0)).alias("split_small"))
    full = rows.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n")).agg(F.coalesce(F.sum((F.col("n") > capacity).cast("long")), F.lit(0)).alias("overfull"))
    other = rows.agg(F.coalesce(F.sum("overlapping"), F.lit(0)).alias("overlapping"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps"))
    return split.crossJoin(full).crossJoin(other).select("documents", "overfull", "split_small", "overlapping", "gaps")  # one row each


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers used, the fewest that the total size allows, and the share of room used."""
    total = packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return total.select(
        "sequences", "tokens", F.ceil(F.col("tokens") / capacity).cast("long").alias("fewest"),
        F.coalesce(F.try_divide(F.col("tokens"), F.col("sequences") * capacity), F.lit(0.0)).alias("fill"),
    )
