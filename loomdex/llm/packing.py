"""Filling containers of a fixed capacity with texts sized in tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048

#: Mean number of texts in a randomised group: bounds the memory of a task. Of a group at most one container is left half empty.
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container, place in it and offset in it of each item; sizes from 1 to capacity.

    Largest items first, of equal ones the earlier first, each into the first container that still holds it. That container is found
    in a tournament tree whose leaves are the free room of the containers and whose inner nodes are the most room below them.
    """
    n = len(sizes)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    leaves = 1 << max(1, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    filled, offset, place = [0] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
    container = np.zeros(n, np.int64)
    order = np.argsort(-np.asarray(sizes), kind="stable")
    for i, s in zip(order.tolist(), np.asarray(sizes)[order].tolist()):
        node = 1
        while node < leaves:
            node += node
            if room[node] < s:
                node += 1
        c = node - leaves
        container[i], place[i], offset[i] = c, filled[c], capacity - room[node]
        filled[c] += 1
        room[node] -= s
        while node > 1:
            node >>= 1
            left, right = room[node + node], room[node + node + 1]
            most = left if left >= right else right
            if room[node] == most:
                break
            room[node] = most
    return container, place, offset


def pack(sized: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 0, n_items: int | None = None) -> DataFrame:
    """Containers for items (id, n_tokens): container string, place int, offset int, id, piece int, token_start long, n_tokens int.

    An item that exceeds the capacity is cut into pieces of the whole capacity, which fill containers of their own, and a rest that is
    packed like any item; no other item is cut. Items without tokens, or of null size, take no place. Repeated rows are items of their
    own. n_items: number of rows, where it is known without computing the sizes. Groups are drawn by hash of the id, the row and the seed, so
    that they have like numbers of items even where ids are null or repeat; the row is its place in the splits of the input, which a task
    that is run again finds unchanged.
    """
    kind = sized.schema[id_col].dataType.simpleString()
    items = sized.select(F.col(id_col).cast("string").alias("id"), F.col("n_tokens").cast("bigint").alias("n"))
    groups = max(1, -(-(items.count() if n_items is None else n_items) // group_items))
    items = items.withColumn("row", F.monotonically_increasing_id()).filter("n > 0").withColumn("grp", F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "n", "row"], kind="stable")  # ids are text here, so that null ids stay null
        ids, n, g = pdf["id"].to_numpy(), pdf["n"].to_numpy(np.int64), int(pdf["grp"].iloc[0])
        full, rest = n // capacity, n % capacity
        # whole pieces: one container each
        who = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
        some = np.flatnonzero(rest)
        container, place, offset = first_fit_decreasing(rest[some], capacity)
        used = int(container.max()) + 1 if len(some) else 0
        c = np.concatenate([used + np.arange(len(who)), container])
        return pd.DataFrame(
            {
                "container": [f"{g}-{x}" for x in c.tolist()],
                "place": np.concatenate([np.zeros(len(who), np.int64), place]).astype(np.int32),
                "offset": np.concatenate([np.zeros(len(who), np.int64), offset]).astype(np.int32),
                id_col: np.concatenate([ids[who], ids[some]]),
                "piece": np.concatenate([piece, full[some]]).astype(np.int32),
                "token_start": np.concatenate([piece * capacity, full[some] * capacity]),
                "n_tokens": np.concatenate([np.full(len(who), capacity), rest[some]]).astype(np.int32),
            }
        )

    return items.groupBy("grp").applyInPandas(one, f"container string, place int, offset int, `{id_col}` string, piece int, token_start bigint, n_tokens int").withColumn(id_col, F.col(id_col).cast(kind))


def faults(packed: DataFrame, sized: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row of counts, all zero for a right packing but n_ids: n_ids placed, overfull containers, gaps (pieces that don't begin where the one
    before them ends, in their container or in their item), cut items that would have fitted whole, and ids with lost or added tokens."""
    held = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("last"), F.max("place").alias("p"), F.count("*").alias("k"), F.min("offset").alias("o"))
    a = held.agg(F.count_if(F.col("n") > capacity).alias("overfull"), F.count_if((F.col("last") != F.col("n")) | (F.col("o") != 0) | (F.col("p") + 1 != F.col("k"))).alias("gaps"))
    whole = sized.select(F.col(id_col).alias("i"), F.coalesce("n_tokens", F.lit(0)).alias("n")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("long") * (F.col("n") > 0).cast("long")).alias("k"))
    got = packed.select(F.col(id_col).alias("i"), "n_tokens").groupBy("i").agg(F.sum("n_tokens").alias("m"), F.count("*").alias("pieces"))
    both = whole.join(got, whole["i"].eqNullSafe(got["i"]), "full_outer").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("pieces", F.lit(0)).alias("pieces"))
    b = both.agg(F.count_if(F.col("pieces") > 0).alias("n_ids"), F.count_if(F.col("n") != F.col("m")).alias("lost"), F.count_if(F.col("pieces") > F.col("k")).alias("cut"))
    return b.join(F.broadcast(a)).select("n_ids", "overfull", "gaps", "cut", "lost")  # one row each


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_tokens, least (containers that any packing needs), fill (share of the room that is used)."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens")).select(
        "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least"), F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill")
    )
