"""Packing documents into fixed-length sequences with bounded memory.

Every partition keeps a fixed number of open windows. A document longer than a
window first fills whole windows; what is left goes to the open window that it
fills best (the least room that is enough). When none has room, a new window is
opened while fewer than ``open_windows`` are open; after that the fullest one
is emitted. If its room exceeds ``slack``, it is first topped up with the
beginning of the document, so no emitted window is emptier than ``slack``.

Finally the leftovers are merged: the windows that are still open at the end of
a partition are laid end to end over all partitions (exclusive sums of one
number per partition) and cut at multiples of the length. Only the last merged
sequence can be short. A task holds at most ``open_windows`` windows.

Defined results: a null text is an empty one and consists of the end id; null
ids and repeated rows are packed like any row; an empty table gives no rows;
further columns of the input are ignored; texts are read whole, and one longer
than a window is cut, never dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, exclusive_offsets, written
from .tokens import tokenizer

#: sequence ids of merged leftovers begin here; those of a partition's own windows are far below
MERGED = 1 << 61


class OpenWindows:
    """Best-fit placement into at most ``limit`` open windows.

    ``add`` yields finished windows, each a list of (piece, start, length);
    a piece is any value that stands for a document."""

    def __init__(self, length: int, limit: int, slack: int):
        self.length, self.limit, self.slack = length, limit, slack
        self.room: list[tuple[int, int]] = []  # (free places, window), ascending
        self.windows: dict[int, list[tuple]] = {}
        self.made = 0

    def add(self, piece, n: int):
        start = 0
        while n - start >= self.length:
            yield [(piece, start, self.length)]
            start += self.length
        while start < n:
            need = n - start
            k = bisect_left(self.room, (need, -1))
            if k == len(self.room) and len(self.room) >= self.limit:
                free, window = self.room[0]  # the fullest
                if free <= self.slack:
                    del self.room[0]
                    yield self.windows.pop(window)
                    continue
                k, need = 0, free
            if k < len(self.room):
                free, window = self.room.pop(k)
            else:
                free, window = self.length, self.made
                self.made += 1
                self.windows[window] = []
            self.windows[window].append((piece, start, need))
            start += need
            if free == need:
                yield self.windows.pop(window)
            else:
                insort(self.room, (free - need, window))

    def rest(self):
        """The windows still open, fullest first: (finished within ``slack``, window)."""
        for free, window in self.room:
            yield free <= self.slack, self.windows[window]
        self.room, self.windows = [], {}


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2,
         open_windows: int = 64, slack: int = 64) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id, offset. ``path`` names the tokenizer file."""
    import pyarrow as pa

    batches_of(df.sparkSession, 500)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [T.StructField("id", rows.schema["id"].dataType)] + [
        T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
                                         ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()),
                                         ("offset", T.LongType()), ("part", T.IntegerType()), ("tail", T.LongType()))]

    def run(batches):
        part, sequence, tail = TaskContext.get().partitionId(), 0, 0
        open_ones, encode, out, ready = OpenWindows(length, open_windows, slack), tokenizer(path), [], 0

        def emit(window, merged):
            nonlocal sequence, tail, ready
            offset = 0
            for (doc_id, ids), start, n in window:
                out.append((doc_id, start, n, ids[start:start + n].tobytes(), len(ids), (part << 32) + sequence, offset, part,
                            tail if merged else None))
                offset, tail = offset + n, tail + n * merged
            sequence, ready = sequence + (not merged), ready + offset

        def flush():
            nonlocal out, ready
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            out, ready = [], 0
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        types = None
        for batch in batches:
            types = types or [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                              pa.int64(), pa.int32(), pa.int64()]
            for doc in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist(), end_id)):
                for window in open_ones.add(doc, len(doc[1])):
                    emit(window, False)
                if ready > 1 << 20:
                    yield flush()
        for finished, window in open_ones.rest():
            emit(window, not finished)
        if out:
            yield flush()

    pieces = written(rows.mapInArrow(run, T.StructType(fields)))
    # one row per partition
    totals = pieces.where("tail IS NOT NULL").groupBy("part").agg(F.sum("length").alias("tokens"))
    offsets = exclusive_offsets(totals, "part", base="tokens").withColumnRenamed("part", "_part")
    lost = pieces.where("tail IS NOT NULL").join(F.broadcast(offsets), F.col("part") == F.col("_part"))
    lost = (lost.withColumn("at", F.col("base") + F.col("tail"))
            .withColumn("k", F.explode(F.expr(f"sequence(at div {length}, (at + length - 1) div {length})")))
            .withColumn("lo", F.greatest("at", F.col("k") * length))
            .withColumn("n", F.least(F.col("at") + F.col("length"), (F.col("k") + 1) * length) - F.col("lo"))
            .withColumn("skip", F.col("lo") - F.col("at")))
    merged = lost.select("id", (F.col("start") + F.col("skip")).alias("start"), F.col("n").alias("length"),
                         F.expr("substring(ids, int(4 * skip + 1), int(4 * n))").alias("ids"), "doc_tokens",
                         (F.col("k") + MERGED).alias("sequence_id"), (F.col("lo") - F.col("k") * length).alias("offset"))
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return (pieces.where("tail IS NULL").select(*names).unionByName(merged.select(*names))
            .withColumnRenamed("id", id_col))


def decode(ids: bytes) -> np.ndarray:
    """The token ids of a piece."""
    return np.frombuffer(ids, "<u4")
