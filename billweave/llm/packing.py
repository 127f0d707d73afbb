"""Problem 8: documents into containers of fixed token capacity.

Items larger than the capacity are cut into full containers and one rest; nothing else is
split. The rests and all other items are dealt by a hash of their row into groups of bounded
expected size, and each group is packed on its own by multiway differencing: every item starts
as a partial partition of k windows, the two partial partitions with the widest spread are
merged with opposing order, until one is left. If its fullest window exceeds the capacity, k
rises and the group is packed again. k starts at the least number of windows that could do.

Defined results: null and empty texts are items of size 0 and get a container too; repeated
rows are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.encoding import is_long, long_texts, numbered, token_counts
from billweave.llm.tokens import default_path
from billweave.runtime import materialize

CAPACITY = 4096
GROUP_ITEMS = 2000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each item by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):  # sums are kept in falling order, least 0
        sums[i] = np.zeros(k, dtype=np.int64)
        sums[i][0] = size
        heap.append((-int(size), i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        sums[node] = total
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(total[0]), node))
        node += 1
    place: dict[int, np.ndarray] = {node - 1: np.arange(k)}
    for up in range(len(merges) - 1, -1, -1):
        a, b, order = merges[up]
        windows = place.pop(n + up)
        of_a = np.empty(k, dtype=np.int64)
        of_a[order] = windows
        place[a], place[b] = of_a, of_a[::-1]
    return np.array([place[i][0] for i in range(n)], dtype=np.int64)


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of items that all fit the capacity, and how many windows there are."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        windows = differencing(sizes, k)
        over = int(np.bincount(windows, weights=sizes, minlength=k).max()) - capacity
        if over <= 0:
            return windows, k
        k += max(1, k * over // (8 * capacity))


def fill_containers(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """(key, piece_no, first_token, tokens, container) of every item or piece of an item."""
    path = path or default_path()
    rows = numbered(docs, key, text)
    short = rows.filter(~is_long()).select("row", "key", token_counts(path)("text").alias("n"))
    long = long_texts(rows.filter(is_long()), lambda e, ids: (len(ids),), "n int", path)
    sized = materialize(short.unionByName(long))  # the ids of the containers depend on the number of rows
    of_key = sized.schema["key"].dataType
    groups = max(1, -(-sized.count() // group_items))
    full = F.expr(f"int(n div {capacity})")
    rest = F.expr(f"n % {capacity}")
    pieces = sized.filter(F.col("n") > capacity)
    own = pieces.select("key", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no")).select(
        "key",
        "piece_no",
        (F.col("piece_no") * capacity).alias("first_token"),
        F.lit(capacity).alias("tokens"),
        F.concat_ws("-", F.lit("own"), "row", "piece_no").alias("container"),
    )
    split = F.col("n") > capacity
    open_items = sized.filter(~(split & (rest == 0))).select(
        F.col("key").cast("string").alias("key"),
        "row",
        F.when(split, full).otherwise(0).alias("piece_no"),
        F.when(split, full * capacity).otherwise(0).alias("first_token"),
        F.when(split, rest).otherwise(F.col("n")).cast("int").alias("tokens"),
        F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"),
    )

    def pack_group(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "row"], ascending=[False, True])
        windows, _ = pack(items["tokens"].to_numpy(np.int64), capacity)
        group = items["group"].iloc[0]
        return items[["key", "piece_no", "first_token", "tokens"]].assign(container=[f"mix-{group}-{w}" for w in windows])

    schema = "key string, piece_no int, first_token int, tokens int, container string"
    # the sizes are few bytes but much work: a stated number of tasks, each of a few groups
    dealt = open_items.repartition(-(-groups // 4), "group")
    mixed = dealt.groupBy("group").applyInPandas(pack_group, schema).withColumn("key", F.col("key").cast(of_key))
    return mixed.unionByName(own).withColumnRenamed("key", key)
