"""Which values of list columns do several nodes hold? A filter of bounded size answers.

Each task sends a value once, with one or two of the nodes that hold it, to the
value's bucket, so a value that a third of all rows hold is two entries a task.
Buckets answer with their part of a bitmap, which has eight to sixteen bits for
each value sent, 2^FILTER at most whatever the input: 64 MB are broadcast. A value
that passes by chance is one row too many in a later join and changes no result;
beyond the bound such rows become more, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_dropped
from . import kernels as K

#: Entries that a task holds before it sends them on, and entries meant for a bucket.
HELD, BUCKET = 1_000_000, 100_000
FILTER = 29


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each; a null list has none."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), lengths)


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """Rows of one bucket each, with lists of what goes there."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[cuts, len(bucket)].astype(np.int32))
    return pa.array(bucket[cuts].astype(np.int32)), [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]


def in_lots(batches: Iterator[pa.RecordBatch], take: Callable, send: Callable) -> Iterator[pa.RecordBatch]:
    """Columns that `take` makes of batches, sent in lots of about HELD entries."""
    lots, size = [], 0
    for batch in batches:
        lots.append(take(batch))
        size += len(lots[-1][0])
        if size >= HELD:
            yield send(*(np.concatenate(c) for c in zip(*lots)))
            lots, size = [], 0
    if size:
        yield send(*(np.concatenate(c) for c in zip(*lots)))


def _ends(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, each with its smallest and largest value."""
    if not len(key):
        return key, value, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[cuts], np.minimum.reduceat(value, cuts), np.maximum.reduceat(value, cuts)


def _send(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def take(batch):
        values, row = flat(batch.column(1))
        nodes = batch.column(0).flatten() if pa.types.is_list(batch.column(0).type) else batch.column(0)
        nodes = nodes.to_numpy() if len(nodes) == len(values) and nodes is not batch.column(0) else nodes.to_numpy()[row]
        return values.view(np.uint64), (nodes & 0xFFFFFFFF).astype(np.uint32)

    def send(values, node):
        key, low, high = _ends(values, node)
        more = low != high
        key, node = np.r_[key, key[more]], np.r_[low, high[more]]
        bucket, (k, v) = dealt(bucket_of(key, bits), K.signed(key), node.view(np.int32))
        return pa.RecordBatch.from_arrays([bucket, k, v], names=["bucket", "keys", "nodes"])

    return in_lots(batches, take, send)


def _part(bits: int, filter_bits: int, alone: bool, table: pa.Table) -> pa.Table:
    """A bucket's part of the filter: the bits of values that two nodes hold, or of all."""
    keys, nodes = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "nodes"))
    key, low, high = _ends(keys.view(np.uint64), nodes.view(np.uint32))
    part = np.zeros(1 << (filter_bits - bits), bool)
    part[bucket_of(key[alone | (low != high)], filter_bits) & (len(part) - 1)] = True
    return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "part": pa.array([np.packbits(part).tobytes()], pa.binary())})


def _power(n: float) -> int:
    return max(1, int(np.ceil(np.log2(max(2.0, n)))))


class Shared:
    """The filter: which of some values may several nodes hold?"""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def keeps(self, values: np.ndarray) -> np.ndarray:
        """Indexes of the values that pass."""
        i = bucket_of(values, self.bits)
        return np.flatnonzero((self.words[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1)


def bucket_bits(total: int) -> int:
    return min(20, _power(total / BUCKET))


def shared_values(rows: DataFrame, node: str, values: str, total: int, alone: bool = False) -> Shared:
    """The filter over the `total` values in the list column of rows; values are 64-bit hashes, nodes too. With `alone`, values of one node pass, too."""
    bits = bucket_bits(total)
    filter_bits = max(bits + 3, min(FILTER, _power(total) + 3))
    sent = rows.select(node, values).mapInArrow(lambda it: _send(bits, it), "bucket int, keys array<long>, nodes array<int>")
    parts = sent.groupBy("bucket").applyInArrow(lambda t: _part(bits, filter_bits, alone, t), "bucket int, part binary")
    words, size = np.zeros(1 << (filter_bits - 3), np.uint8), 1 << (filter_bits - bits - 3)
    with shuffles_dropped(rows.sparkSession):
        got = parts.select("*").collect()
    for r in got:
        words[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(r.part, np.uint8)
    return Shared(filter_bits, words)


def sum_of_sizes(rows: DataFrame, values: str) -> int:
    return rows.agg(F.coalesce(F.sum(F.size(values)), F.lit(0))).first()[0]
