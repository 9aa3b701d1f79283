"""Operator 1. Token ids in a content-addressed store.

Rolling hashes over the id stream of each document cut it into chunks; a chunk is stored once, under
the digest of its bytes. A recipe per document lists its chunks, in ascending doc_id order over the
shards of the recipe table; a manifest holds each shard's Merkle root over those of its documents, so
lost, added or altered recipes are seen as well as altered chunks.

Files of a store, all Parquet in the shared folder:
  chunks/    digest, width (bytes of an id), n, uses (in recipes), payload: little-endian unsigned ids
  recipes/   shard, place, doc_id, local_start, n_tokens, digests, lengths, root: the Merkle root of its digests
  manifest/  shard, n_docs, n_tokens, root: the Merkle root of the shard's document roots, in place order

Cases: a null text is empty and holds the end id alone; rows that share a doc_id are documents of
their own, ordered by their text's hash; a null doc_id comes first; an empty table gives an empty
store; rows that repeat id and text are told apart by their place in the input alone; a very long text
is cut into as many chunks as it needs. Only the id and text columns are read, so other columns can't
clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tickspark.llm.common import in_blocks, join_split, remove, text_of, written
from tickspark.llm.crc import combine_shift, crc_of_parts
from tickspark.llm.tokens import BLOCK_BYTES, encoder, release, with_end

#: Ids of a chunk: least, most, and the mask whose zero bits make a cut (one in 256 places).
LEAST, MOST, MASK = 64, 1024, np.uint32(0xFF000000)
#: Ids that the rolling hash covers; fewer than LEAST, so that a chunk's cuts depend on its document alone.
SPAN = 16


def rolling(ids: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the SPAN ids that end at each place, in four doublings."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h >> np.uint64(32)).astype(np.uint32)
    step = 1
    while step < SPAN:
        back = np.zeros_like(h)
        back[step:] = h[:-step]
        h = h + (back << np.uint32(2 * step) | back >> np.uint32(32 - 2 * step))
        step *= 2
    return h


def cuts(marks: Sequence[int], n: int) -> list[int]:
    """Ends of chunks of a document of n ids; marks: places after which content says to cut."""
    out, start, at = [], 0, 0
    while n - start > LEAST:
        at = bisect_left(marks, start + LEAST, at)
        end = min(int(marks[at]) if at < len(marks) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """A Merkle tree that takes leaves one by one and holds one node per level: the published tree hash of RFC 6962, over blake2b.

    Leaves and inner nodes are told apart by a first byte; the root of no leaves is the hash of nothing.
    """

    def __init__(self) -> None:
        self.peaks: list[tuple[int, bytes]] = []  # roots of full subtrees, higher ones first

    def add(self, leaf: bytes) -> None:
        level, node = 0, _hash(b"\0" + leaf)
        while self.peaks and self.peaks[-1][0] == level:
            node = _hash(b"\1" + self.peaks.pop()[1] + node)
            level += 1
        self.peaks.append((level, node))

    def root(self) -> bytes:
        if not self.peaks:
            return _hash(b"")
        node = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            node = _hash(b"\1" + left + node)
        return node


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a Tree of all the leaves, level by level: a node without a neighbour goes up as it is."""
    nodes = [_hash(b"\0" + x) for x in leaves]
    while len(nodes) > 1:
        odd = nodes[-1:] if len(nodes) % 2 else []
        nodes = [_hash(b"\1" + a + b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)] + odd
    return nodes[0] if nodes else _hash(b"")


def _chunk(path: str, drops_space: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, drops_space)
        for block in in_blocks(batches, "text", BLOCK_BYTES):
            n, ids = with_end(*enc.encode(block.column("text")), end_id)
            marks = np.flatnonzero((rolling(ids) & MASK) == 0) + 1
            stops = np.cumsum(n)
            lo, hi = np.searchsorted(marks, stops - n + 1), np.searchsorted(marks, stops, side="right")
            bases = stops - n
            ends = [cuts((marks[a:b] - base).tolist(), size) for base, size, a, b in zip(bases.tolist(), n.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            lists = np.concatenate(([0], np.cumsum([len(x) for x in ends])))  # chunks before each document
            lengths = np.diff(np.fromiter((e for x in ends for e in x), np.int64, lists[-1]) + np.repeat(bases, np.diff(lists)), prepend=0)
            widths = np.where(np.maximum.reduceat(ids, bases) < 1 << 16, 2, 4)
            # payloads lie one after another in one buffer, and so do the documents
            data = ids.astype("<u2").tobytes() if widths.max() == 2 else b"".join(ids[a:b].astype(f"<u{w}").tobytes() for a, b, w in zip(bases, stops, widths, strict=True))
            places = np.concatenate(([0], np.cumsum(lengths * np.repeat(widths, np.diff(lists)))))
            view = memoryview(data)
            digests = [_hash(view[a:b]) for a, b in pairwise(places.tolist())]
            roots = [merkle(digests[a:b]) for a, b in pairwise(lists.tolist())]
            offsets = pa.array(lists, pa.int32())
            payloads = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])
            lists_of = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(digests, pa.binary()), pa.array(lengths, pa.int32()), payloads)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("tie"), pa.array(n, pa.int64()), *lists_of, pa.array(roots, pa.binary()), pa.array(widths, pa.int32())],
                names=["doc_id", "tie", "n_tokens", "digests", "lengths", "payloads", "root", "width"],
            )

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a shard and sums the tokens before each."""
    shard, place, start = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        ends = start + np.cumsum(n)
        names = ["doc_id", "n_tokens", "digests", "lengths", "root"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), shard, np.int32)), pa.array(np.arange(place, place + len(n), dtype=np.int64)), pa.array(ends - n), *(b.column(x) for x in names)], names=["shard", "place", "local_start", *names]
        )
        place += len(n)
        start = int(ends[-1]) if len(n) else start


def _shard_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Merkle root over a shard's document roots, in place order, and what it counts."""
    shard, n_docs, n_tokens, tree = None, 0, 0, Tree()
    out = []
    for b in batches:
        for s, n, root in zip(*(b.column(x).to_pylist() for x in ("shard", "n_tokens", "root")), strict=True):
            if s != shard:
                if shard is not None:
                    out.append((shard, n_docs, n_tokens, tree.root()))
                shard, n_docs, n_tokens, tree = s, 0, 0, Tree()
            n_docs, n_tokens = n_docs + 1, n_tokens + n
            tree.add(root)
    if shard is not None:
        out.append((shard, n_docs, n_tokens, tree.root()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "n_docs", "n_tokens", "root"])


RECIPE = "shard int, place long, local_start long, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary"


def shard_summary(recipes: DataFrame) -> DataFrame:
    """shard, n_docs, n_tokens, root of recipes, from their rows in place order."""
    return recipes.select("shard", "place", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "place").drop("place").mapInArrow(_shard_roots, "shard int, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, store: str, tokenizer: str, drops_space: bool = True, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs once and writes the store. Steps are tables, so a lost executor repeats its own tasks only."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"))
    cut = rows.mapInArrow(_chunk(tokenizer, drops_space, end_id), "doc_id long, tie long, n_tokens long, digests array<binary>, lengths array<int>, payloads array<binary>, root binary, width int")
    cut = written(cut, f"{store}/staging")
    parts = cut.select("width", F.explode(F.arrays_zip("digests", "lengths", "payloads")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"), "width", F.col("c.payloads").alias("payload"))
    parts.groupBy("digest").agg(F.first("width").alias("width"), F.first("n").alias("n"), F.count("*").alias("uses"), F.first("payload").alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/chunks")
    placed = cut.select("doc_id", "tie", F.monotonically_increasing_id().alias("nth"), "n_tokens", "digests", "lengths", "root").repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth").mapInArrow(_place, RECIPE)
    recipes = written(placed, f"{store}/recipes")
    remove(spark, f"{store}/staging")
    written(shard_summary(recipes), f"{store}/manifest")


def shard_starts(spark: SparkSession, store: str) -> DataFrame:
    """Tokens before each shard: one row per shard, so the driver gets as many rows as there were partitions."""
    start, out = 0, []
    for shard, n in sorted((r.shard, r.n_tokens) for r in spark.read.parquet(f"{store}/manifest").select("shard", "n_tokens").collect()):
        out.append((shard, start))
        start += n
    return spark.createDataFrame(out, "shard int, shard_start long")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks each chunk against its digest; n and the crc32 of its ids as 32-bit integers come from its bytes."""
    release()
    for b in batches:
        payloads, digests = (b.column(x).to_numpy(zero_copy_only=False).tolist() for x in ("payload", "digest"))
        good = [_hash(p) == d for p, d in zip(payloads, digests, strict=True)]
        wide = [np.frombuffer(p, f"<u{w}").astype("<u4").tobytes() for p, w in zip(payloads, b.column("width").to_numpy().tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("uses"), pa.array([len(x) // 4 for x in wide], pa.int64()), pa.array(crc_of_parts(wide)), pa.array(good)], names=["digest", "uses", "n", "crc", "good"])


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a recipe, with the ids after it; whether digests still give the root."""
    for b in batches:
        digests, lengths = b.column("digests").flatten(), b.column("lengths").flatten().to_numpy().astype(np.int64)
        sizes = pc.list_value_length(b.column("digests")).to_numpy().astype(np.int64)
        stops = np.cumsum(sizes)
        leaves, places = digests.to_numpy(zero_copy_only=False).tolist(), [0, *stops.tolist()]
        good = np.array([merkle(leaves[x:y]) == r for (x, y), r in zip(pairwise(places), b.column("root").to_pylist(), strict=True)], bool)
        take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        ends = np.cumsum(lengths)
        after = np.append(0, ends)[np.repeat(stops, sizes)] - ends
        columns = [b.column(x).take(take) for x in ("shard", "place", "local_start", "doc_id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(sizes, sizes)), digests, pa.array(after), pa.array(np.repeat(good, sizes))], names=["shard", "place", "local_start", "doc_id", "n_chunks", "digest", "after", "root_good"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        moved = combine_shift(b.column("crc").to_numpy(), b.column("after").to_numpy() * 4)
        names = ["shard", "place", "local_start", "doc_id", "n_chunks", "n", "good"]
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(moved.astype(np.int64))], names=[*names, "crc"])


def read_digests(spark: SparkSession, store: str, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of each document, from the files of a store.

    Every chunk file is read whole and checked against its digest, every recipe against its Merkle
    root, every shard's recipes against the manifest's counts and root. A document's crc32 is the exact
    combination of its chunks' (crc32 is linear), so chunks that a third of all documents share aren't
    copied out again. path: a folder for what is known of the chunks.
    """
    facts = written(spark.read.parquet(f"{store}/chunks").mapInArrow(_facts, "digest binary, uses long, n long, crc long, good boolean"), path)
    uses = spark.read.schema(RECIPE).parquet(f"{store}/recipes").mapInArrow(_unfold, "shard int, place long, local_start long, doc_id long, n_chunks long, digest binary, after long, root_good boolean")
    both = join_split(uses, facts, "digest", "uses", facts.agg(F.sum("uses")).first()[0] or 0).withColumn("good", F.col("good") & F.col("root_good"))
    moved = both.mapInArrow(_shifted, "shard int, place long, local_start long, doc_id long, n_chunks long, n long, good boolean, crc long")
    docs = moved.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("local_start").alias("local_start"), F.sum("n").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"),
        (F.bool_and("good") & (F.count("*") == F.first("n_chunks"))).alias("whole"),  # a chunk that the store lacks isn't in the join
    )
    starts = F.broadcast(shard_starts(spark, store))  # a row per shard
    good = F.broadcast(verify(spark, store))  # a row per shard
    out = docs.join(starts, "shard").join(good, "shard")
    return out.select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", (F.col("whole") & F.col("good")).alias("verified"))


def reconstruct(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, ids: the whole id streams, joined again from recipes and chunks. The most frequent chunks, of MOST ids at most, are broadcast."""
    chunks = spark.read.parquet(f"{store}/chunks").drop("n")
    uses = spark.read.schema(RECIPE).parquet(f"{store}/recipes").select("shard", "place", "doc_id", "local_start", F.posexplode("digests").alias("at", "digest"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in sorted(parts, key=lambda p: p["at"])), f"<u{parts[0]['width']}").tolist() for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    both = join_split(uses, chunks, "digest", "uses", chunks.agg(F.sum("uses")).first()[0] or 0)
    docs = both.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("local_start").alias("local_start"), F.collect_list(F.struct("at", "width", "payload")).alias("parts"))
    return docs.join(F.broadcast(shard_starts(spark, store)), "shard").select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "parts").mapInArrow(widen, "doc_id long, start long, ids array<long>")


def verify(spark: SparkSession, store: str) -> DataFrame:
    """shard, good: whether the recipes of a shard still give its manifest's counts and root."""
    now = shard_summary(spark.read.schema(RECIPE).parquet(f"{store}/recipes"))
    then = spark.read.parquet(f"{store}/manifest").select("shard", *(F.col(x).alias(f"was_{x}") for x in ("n_docs", "n_tokens", "root")))
    same = (F.col("n_docs") == F.col("was_n_docs")) & (F.col("n_tokens") == F.col("was_n_tokens")) & (F.col("root") == F.col("was_root"))
    return now.join(then, "shard", "full").select("shard", F.coalesce(same, F.lit(False)).alias("good"))
