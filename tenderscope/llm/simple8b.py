"""Token ids on disk in Simple-8b, a word-aligned code.

*Word.* 64 bits: a 4-bit selector above 60 data bits that hold 60, 30, 20, 15,
12, 10, 8, 7, 6, 5, 4, 3 or 2 ids of 1 to 30 bits, first id lowest. Each word
takes as many of the next ids as fit.
*Escapes.* An id of 2**30 or more is stored as 0; its place and value stand in
the block's escape list.
*Block.* Whole documents, together ``block_ids`` ids or the one longer document:
header (magic, counts of documents, ids, words, escapes), the documents' lengths
as uint32, escape places and values, words. A block decodes by itself, in one
vectorised pass over its selectors.
*Shard.* The blocks of one range of document ids, in ascending order. Blocks are
rows (shard, block, first_id_at, n_ids, doc_ids, payload) of a Parquet table, so
that the commit protocol of Spark's writer covers lost executors and any
Spark-readable store can hold them; ``first_id_at`` is the block's offset in the
shard, and the exclusive sums of the shards' totals give the offset in the corpus.

Defined results: a null text has only the end id; null document ids come first;
rows with equal ids stand in the order of a hash of their text; an empty table
gives an empty file; further columns of the input are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, exclusive_offsets, shuffle_width
from .tokens import tokenizer

MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIIII")
#: ids per word of each selector, and their bits
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2], np.int64)
BITS = 60 // COUNTS
ESCAPE = 1 << 30


def pack_words(ids: np.ndarray) -> np.ndarray:
    """uint64 words of ids below 2**30."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # take[i]: the selector of a word that begins at id i, the one with most ids
    take = np.full(n, len(COUNTS) - 1, np.int64)
    for s in range(len(COUNTS) - 2, -1, -1):
        wide = np.concatenate(([0], np.cumsum(ids >> np.uint32(BITS[s]) > 0)))
        stop = np.minimum(np.arange(n) + COUNTS[s], n)  # places behind the last id are empty
        take[wide[stop] == wide[:-1]] = s
    step, starts, i = COUNTS[take].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    selector = take[starts]
    padded = np.concatenate((ids.astype(np.uint64), np.zeros(60, np.uint64)))
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        words[at] |= np.bitwise_or.reduce(padded[starts[at][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(words) else counts
    out = np.zeros(int(counts.sum()), np.uint32)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        values = (words[at][:, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
        out[first[at][:, None] + np.arange(COUNTS[s])] = values
    return out[:n]


def encode_block(documents: list[np.ndarray]) -> bytes:
    lengths = np.array([len(d) for d in documents], "<u4")
    ids = np.concatenate([*documents, np.zeros(0, np.uint32)]).astype(np.uint32)
    escaped = np.flatnonzero(ids >= ESCAPE)
    words = pack_words(np.where(ids < ESCAPE, ids, 0).astype(np.uint32))
    return b"".join((HEADER.pack(MAGIC, len(documents), len(ids), len(words), len(escaped)), lengths.tobytes(),
                     escaped.astype("<u4").tobytes(), ids[escaped].astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of the documents)."""
    magic, n_docs, n_ids, n_words, n_escapes = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    numbers = np.frombuffer(payload, "<u4", n_docs + 2 * n_escapes, HEADER.size)
    words = np.frombuffer(payload, "<u8", n_words, HEADER.size + 4 * len(numbers))
    ids = unpack_words(words, n_ids)
    ids[numbers[n_docs:n_docs + n_escapes]] = numbers[n_docs + n_escapes:]
    return ids, numbers[:n_docs]


def write_tokens(df: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                 block_ids: int = 1 << 16) -> None:
    """Encode every text with the tokenizer file at ``path`` and write the blocks to ``out``."""
    import pyarrow as pa

    spark = df.sparkSession
    batches_of(spark, 500)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the row number lets equal rows spread over partitions
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("_tie")]
    rows = (rows.withColumn("_tie", F.monotonically_increasing_id())
            .repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("id", "text"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
                           T.StructField("first_id_at", T.LongType()), T.StructField("n_ids", T.LongType()),
                           T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])

    def run(batches):
        shard, block, at, held, encode = TaskContext.get().partitionId(), 0, 0, [], tokenizer(path)

        def flush(id_kind):
            nonlocal block, at, held
            n = sum(len(ids) for _, ids in held)
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([at], pa.int64()),
                       pa.array([n], pa.int64()), pa.array([[d for d, _ in held]], pa.list_(id_kind)),
                       pa.array([encode_block([ids for _, ids in held])], pa.binary())]
            block, at, held = block + 1, at + n, []
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        size = 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for doc_id, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist(), end_id)):
                if held and size + len(ids) > block_ids:
                    yield flush(kind)
                    size = 0
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield flush(kind)

    rows.mapInArrow(run, schema).write.mode("overwrite").option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the file: id, shard, start, n_tokens, ids (little-endian uint32)."""
    import pyarrow as pa

    blocks = spark.read.parquet(out)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # one row per shard
    bases = exclusive_offsets(totals, "shard", base="ids").withColumnRenamed("shard", "_shard")
    schema = T.StructType([T.StructField("id", blocks.schema["doc_ids"].dataType.elementType),
                           T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = decode_block(batch.column("payload")[row].as_py())
                lengths = lengths.astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[row].values, pa.array(np.full(len(lengths), batch.column("shard")[row].as_py(), np.int32)),
                    pa.array(starts + batch.column("first_id_at")[row].as_py()), pa.array(lengths),
                    pa.array([raw[4 * s:4 * (s + n)] for s, n in zip(starts, lengths)], pa.binary())], names=schema.names)

    batches_of(spark, 500)
    docs = blocks.select("shard", "first_id_at", "doc_ids", "payload").mapInArrow(run, schema)
    return (docs.join(F.broadcast(bases), F.col("shard") == F.col("_shard"))
            .select(F.col("id").alias(id_col), "shard", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids"))
