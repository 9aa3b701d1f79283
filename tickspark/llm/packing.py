"""Operator 9. Concatenate and cut.

Pass one puts documents in (doc_id, text hash) order over range partitions, encodes each once and
writes ids with the tokens before it in its partition. The partitions' totals, one row each, give
every partition's place in the stream of all ids. Pass two adds the two and cuts at multiples of the
window; a piece that starts or ends at a cut inside its document is that window's boundary record.
Every sequence but the last is full, so padding is less than one window over all.

Cases: a null or empty text holds the end id alone; rows that share a doc_id are packed each for
itself, ordered by their text's hash; rows that repeat both are told apart by their place in the
input alone, so that any number of them can be dealt over partitions; a null doc_id comes first; an
empty table gives no pieces; a text longer than a window is cut into as many pieces as it fills, and
texts are encoded in slices of a bounded size. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tickspark.llm.common import in_blocks, text_of, work_dir, written
from tickspark.llm.tokens import BLOCK_BYTES, encoder, release, with_end

WINDOW = 4096


def _encode(path: str, drops_space: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(path, drops_space), TaskContext.get().partitionId(), 0
        for block in in_blocks(batches, "text", BLOCK_BYTES):
            n, ids = with_end(*enc.encode(block.column("text")), end_id)
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), block.column("doc_id"), pa.array(ends - n), pa.array(n), runs(pa.py_buffer(ids), np.concatenate(([0], np.cumsum(n))))], names=["part", "doc_id", "local_start", "doc_tokens", "ids"])
            start = int(ends[-1])

    return run


def runs(data: pa.Buffer, places: np.ndarray) -> pa.Array:
    """Byte strings between places, counted in ids of four bytes, of one buffer; nothing is copied."""
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((4 * places).astype(np.int32)), data])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in in_blocks(batches, "ids", BLOCK_BYTES):
            at, n, ids = block.column("at").to_numpy(), block.column("doc_tokens").to_numpy(), block.column("ids")
            first = at // window
            pieces = (at + n - 1) // window - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(sequence * window, at[doc])  # places in the stream of all ids
            length = np.minimum((sequence + 1) * window, at[doc] + n[doc]) - begin
            # ids of a block lie one after another, and so do its pieces
            start = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset] // 4
            places = start + np.concatenate(([0], np.cumsum(length)))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(doc)), pa.array(begin - at[doc]), pa.array(length), pa.array(n[doc]), pa.array(sequence), pa.array(begin - sequence * window), pa.array(length < n[doc]), runs(ids.buffers()[2], places)],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, drops_space: bool = True, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset, boundary, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("nth"))
    ordered = rows.repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth").select("doc_id", "text")
    coded = written(ordered.mapInArrow(_encode(tokenizer, drops_space, end_id), "part int, doc_id long, local_start long, doc_tokens long, ids binary"), work_dir(spark, "pack"))
    before, total = [], 0
    for part, n in sorted((r.part, r.n) for r in coded.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()):  # a row per partition
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))  # a row per partition
    placed = coded.join(starts, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("at"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(window), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary")
