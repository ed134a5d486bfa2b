"""Per-key totals by dense accumulator arrays.

Each split of the input, as it is scanned, encodes its keys with numpy and counts them with bincount and scatter-adds; no row is shuffled.
What a split sends is its sorted distinct keys with an accumulator each. The keys of all splits make the dictionary, which is cut into
blocks of at most `block_keys` consecutive distinct keys, so an accumulator array has a fixed size whatever the number of rows. The
pieces of a block are summed in two steps (by block and salt, then by block): no task ever receives the rows of a key, only at most one
array piece per split. Distinct members are counted the same way over the distinct (key, member) pairs, which no hot key can unbalance,
and only if they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.session import written

#: Measures of a key; each is one accumulator.
MEASURES = ("n_rows", "n_members", "total")

_ARRAYS = "keys array<long>, n_rows array<long>, n_members array<long>, total array<long>"
_CHUNK = f"block long, kind int, {_ARRAYS}"

#: A split adds up what it holds when it holds so many keys, and sends it if so many are distinct; a piece has at most PIECE keys.
HELD, DISTINCT, PIECE = 2_000_000, 1_000_000, 65_536


def _reduce(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    dictionary, code = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    out = []
    for i in range(1, len(MEASURES) + 1):
        acc = np.zeros(len(dictionary), np.int64)
        np.add.at(acc, code, np.concatenate([p[i] for p in parts]))
        out.append(acc)
    return (dictionary, *out)


def _pieces(acc: tuple[np.ndarray, ...], null: bool = False) -> pa.RecordBatch:
    n = len(acc[0])
    offsets = pa.array(np.append(np.arange(0, n, PIECE), n).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in acc]
    return pa.RecordBatch.from_arrays([pa.array([null] * (len(offsets) - 1)), *lists], ["of_null", "keys", *MEASURES])


def _split_counter(members: bool):
    """One pass over a split of (key, weight), or, if members, of distinct (key): pieces of (sorted keys, accumulators); those of the null key apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        held_rows, of_null = 0, np.zeros(3, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            weight = np.zeros(b.num_rows, np.int64) if members else np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
            if b.column(0).null_count:
                some = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                n = int((~some).sum())
                of_null += [0 if members else n, n if members else 0, int(weight[~some].sum())]
                keys, weight = np.asarray(b.column(0).drop_null().to_numpy(zero_copy_only=False), np.int64), weight[some]
            else:
                keys = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
            if not len(keys):
                continue
            dictionary, code = np.unique(keys, return_inverse=True)
            n, total = np.bincount(code, minlength=len(dictionary)), np.zeros(len(dictionary), np.int64)
            np.add.at(total, code, weight)
            none = np.zeros(len(dictionary), np.int64)
            held.append((dictionary, none, n, total) if members else (dictionary, n, none, total))
            held_rows += len(dictionary)
            if held_rows > HELD:
                held = [_reduce(held)]
                if len(held[0][0]) > DISTINCT:
                    yield _pieces(held[0])
                    held = []
                held_rows = len(held[0][0]) if held else 0
        if held:
            yield _pieces(_reduce(held))
        if of_null.any():
            yield _pieces((np.zeros(1, np.int64), *of_null.reshape(3, 1)), True)

    return run


def _to_blocks(bounds: np.ndarray):
    """Pieces cut at the bounds of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(n) for n in ("keys", *MEASURES)]
            for i in range(b.num_rows):
                yield from _chunks(tuple(x[i].values.to_numpy(zero_copy_only=False) for x in lists), bounds)

    return run


def _chunks(acc: tuple[np.ndarray, ...], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = acc[0]
    block = np.searchsorted(bounds, keys, side="right") - 1
    cuts = np.flatnonzero(np.diff(block)) + 1
    starts = np.concatenate([[0], cuts])
    offsets = pa.array(np.concatenate([starts, [len(keys)]]).astype(np.int32))
    ids = block[starts]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in acc]
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.ones(len(ids), np.int32)), *lists], ["block", "kind", "keys", *MEASURES])


def _sum_blocks(final: bool):
    """Sum chunks that come sorted by block and kind: kind 0 is the block's dictionary, the others are added into its arrays."""

    def emit(block, keys, acc):
        if final:
            return pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(a) for a in acc]], ["key", *MEASURES])
        one = pa.array(np.array([0, len(keys)], np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([1], pa.int32()), *[pa.ListArray.from_arrays(one, pa.array(a)) for a in (keys, *acc)]],
            ["block", "kind", "keys", *MEASURES],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, acc = None, None, None
        for b in batches:
            blocks, kinds = b.column("block").to_pylist(), b.column("kind").to_pylist()
            lists = [b.column(n) for n in ("keys", *MEASURES)]
            for i, (blk, kind) in enumerate(zip(blocks, kinds)):
                k = lists[0][i].values.to_numpy(zero_copy_only=False)
                if kind == 0:
                    if now is not None:
                        yield emit(now, keys, acc)
                    now, keys, acc = blk, k, [np.zeros(len(k), np.int64) for _ in MEASURES]
                    continue
                at = np.searchsorted(keys, k)
                for a, col in zip(acc, lists[1:]):
                    a[at] += col[i].values.to_numpy(zero_copy_only=False)
        if now is not None:
            yield emit(now, keys, acc)

    return run


def dense_key_counts(df: DataFrame, key: str, member: str | None = None, weight: str | None = None, block_keys: int = 65536, salts: int = 8) -> DataFrame:
    """Rows, distinct members and total weight of each key, as (key, n_rows, n_members, total), all long.

    A null key is a key (one row, key null) if there are rows with it. A null member adds to the rows and the total, not to the
    members. A null weight counts as zero; of weights below zero too, since they are no frequencies. Every row counts, repeats
    included. Without a member column members are not counted, and 0; without a weight column the totals are 0. An empty input gives no
    rows. Other columns are not read. The splits are counted when this is called: their pieces are a table in the shared folder.
    """
    spark = df.sparkSession
    w = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)) if weight else F.lit(0).cast("long")
    schema = f"of_null boolean, {_ARRAYS}"
    pieces = df.select(F.col(key).cast("long").alias("key"), w.alias("w")).mapInArrow(_split_counter(False), schema)
    if member:
        pairs = df.filter(F.col(member).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(member).cast("long").alias("member")).distinct()
        pieces = pieces.unionByName(pairs.select("key").mapInArrow(_split_counter(True), schema))
    pieces = written(pieces, "pieces")
    total = lambda m: F.coalesce(F.sum(F.element_at(m, 1)), F.lit(0)).alias(m)
    nulls = pieces.filter("of_null").agg(F.count("*").alias("n"), *[total(m) for m in MEASURES]).filter("n > 0").select(F.lit(None).cast("long").alias("key"), *MEASURES)
    pieces = pieces.filter("not of_null")
    # dictionary: distinct keys in order; the first key of each block of `block_keys` is all that leaves the executors
    ordered = pieces.select(F.explode("keys").alias("key")).distinct().repartitionByRange("key").sortWithinPartitions("key")
    coded = ordered.select("key", F.spark_partition_id().alias("p")).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33))
    coded = written(coded, "dictionary")
    heads = coded.filter((F.col("at") % F.lit(block_keys)) == 0).select("key").collect()  # one key per block and partition
    bounds = np.array(sorted(r[0] for r in heads), np.int64)
    if not len(bounds):
        return nulls
    spread = spark.sparkContext.broadcast(bounds)  # a key per 65,536 distinct ones
    counted = pieces.select("keys", *MEASURES).mapInArrow(lambda it: _to_blocks(spread.value)(it), _CHUNK)
    dictionary = (
        coded.groupBy("p", F.floor(F.col("at") / F.lit(block_keys)).alias("b"))
        .agg(F.array_sort(F.collect_list("key")).alias("keys"))
        .mapInArrow(lambda it: _dictionary_rows(spread.value)(it), _CHUNK)
    )
    n = max(1, min(len(bounds), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).unionByName(dictionary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    partial = (
        salted.repartition(n * salts if n > 1 else salts, "block", "salt").sortWithinPartitions("salt", "block", "kind").drop("salt").mapInArrow(_sum_blocks(False), _CHUNK)
    )
    whole = partial.unionByName(dictionary).repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_sum_blocks(True), "key long, n_rows long, n_members long, total long")
    return whole.unionByName(nulls)


def _dictionary_rows(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("keys")
            ids = np.array([np.searchsorted(bounds, col[i].values[0].as_py(), side="right") - 1 for i in range(len(col))], np.int64)
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(col) + 1, np.int32)), pa.array(np.array([], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.zeros(len(ids), np.int32)), col.cast(pa.list_(pa.int64())), empty, empty, empty], ["block", "kind", "keys", *MEASURES])

    return run


def hot_keys(counts: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys, not null, that hold more than `share` of all rows; there are fewer than 1/share of them."""
    counts = written(counts, "key-counts")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0  # one number
    return counts.filter(F.col("key").isNotNull() & (F.col("n_rows") > F.lit(total * share)))
