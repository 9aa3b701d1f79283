"""Operator 10. Near duplicates by HyperMinHash.

1. Every document becomes its set of distinct 5-word shingles (64-bit hashes). Equal sets are one
   node from here on, under a 128-bit digest, however many copies there are.
2. A node's sketch has 256 registers of leading zeros and mantissa; bands of registers (empty ones
   filled from others) put nodes into buckets. The threshold sizes the bands: 32 of 8 at 0.85, 42 of
   6 at 0.80. A pair at the threshold shares no band with probability 4e-5 at 0.85 and 3e-6 at 0.80,
   a more similar one less.
3. Star links: each bucket's least node is tried with every other one, a number of pairs linear in
   the bucket. Pairs pass the collision-corrected Jaccard estimate, then the exact test on full sets.
4. Buckets whose remaining nodes lie in several components by then are compared in blocks of about
   BLOCK nodes and SIDE_BYTES a side at most: nodes of the bucket's largest component only against the others, and no pair
   within a component, since it can't change the result. A pair that shares several bands is tried
   in the first. So no link is lost to a cap, and a group of near copies costs its size, not its
   square.
5. Components by star contraction; a component is named by its least doc_id.

Cases: null, empty and blank texts have an empty set and stay alone; fewer than five words are one
shingle; rows that repeat a doc_id are rows of the result each, and where rows tie for a group's least
document, those that repeat its id and text too stand for it alike; an empty table gives no rows; a
very long text has as large a set as it needs, which one task holds beside one other. Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import in_blocks, text_of, work_dir, written
from tickspark.llm.components import components
from tickspark.llm.shingles import band_keys, band_rows, densified, likely, registers, shingle_sets

#: op10's.
THRESHOLD = 85
#: Nodes of one side of a block comparison, and bytes of their sets.
BLOCK, SIDE_BYTES = 256, 32_000_000


def _texts(block: pa.RecordBatch) -> list[bytes]:
    return block.column("text").cast(pa.binary()).to_pylist()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in in_blocks(batches, "text", 4_000_000):
        sets = shingle_sets(_texts(block))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        sketches = [registers(s).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("tie"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "tie", "n_shingles", "digest", "sketch"])


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, sketches = b.column("node").to_numpy(), b.column("n").to_numpy(), b.column("sketch").to_pylist()
            for i in range(0, len(ids), 2000):
                keys = band_keys(np.array([densified(np.frombuffer(s, np.uint16)) for s in sketches[i : i + 2000]]), rows)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), pa.array(np.repeat(ids[i : i + 2000], n)), pa.array(np.repeat(sizes[i : i + 2000], n))], names=["key", "band", "node", "n"])

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in in_blocks(batches, "text", 4_000_000):
        yield pa.RecordBatch.from_arrays([block.column("node"), pa.array([s.tobytes() for s in shingle_sets(_texts(block))], pa.binary()), block.column("sketch")], names=["node", "hashes", "sketch"])


def is_link(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """100 * |a and b| >= threshold * |a or b|, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = [np.array([np.frombuffer(x, np.uint16) for x in b.column(c).to_pylist()]) for c in ("sketch_a", "sketch_b")]
            if not len(sketches[0]):
                continue
            keep = np.flatnonzero(likely(*sketches, threshold / 100))
            ha, hb = b.column("hashes_a"), b.column("hashes_b")
            keep = [i for i in keep.tolist() if is_link(np.frombuffer(ha[i].as_py(), np.uint64), np.frombuffer(hb[i].as_py(), np.uint64), threshold)]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def _compare(threshold: int, rows: int):
    """Links between components in one block comparison; its rows are at most 2 * BLOCK or so."""

    def run(group: pa.Table) -> pa.Table:
        node, label, side = (group.column(c).to_numpy() for c in ("node", "label", "side"))
        band = group.column("band")[0].as_py()
        sketch = np.array([np.frombuffer(x, np.uint16) for x in group.column("sketch").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        keys = band_keys(np.array([densified(s) for s in sketch]), rows)[:, :band]
        one_side = side.min() == side.max()
        # components of this comparison: a pair joined here needn't be tried again
        parent = {int(x): int(x) for x in label}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for i in range(len(node)):
            other = (label != label[i]) & (node > node[i] if one_side else side > side[i])
            other &= 100 * np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i])
            j = np.flatnonzero(other)
            if band and len(j):
                j = j[~(keys[j] == keys[i]).any(1)]
            if len(j):
                j = j[likely(sketch[j], sketch[i][None, :], threshold / 100)]
            for k in j.tolist():
                x, y = find(int(label[i])), find(int(label[k]))
                if x != y and is_link(sets[i], sets[k], threshold):
                    parent[max(x, y)] = min(x, y)
                    links.append((int(node[i]), int(node[k])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def groups(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles of every row, and component_id, component_tie: the least document that its links reach."""
    path = work_dir(docs.sparkSession, "neardup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text"))
    sets = written(rows.mapInArrow(_sketch, "doc_id long, tie long, n_shingles long, digest binary, sketch binary"), f"{path}/documents")
    # a node per distinct set, with the document that stands for it
    nodes = sets.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("who"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    nodes = written(nodes.select("digest", "who.doc_id", "who.tie", "sketch", "n", F.monotonically_increasing_id().alias("node")), f"{path}/nodes")

    width = band_rows(threshold / 100)
    bands = written(nodes.select("node", "n", "sketch").mapInArrow(_bands(width), "key long, band int, node long, n long"), f"{path}/bands")
    shared = written(bands.groupBy("key", "band").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1").select("key", "band", "pivot"), f"{path}/buckets")
    members = written(bands.join(shared, ["key", "band"]).where("node <> pivot"), f"{path}/members")

    wanted = members.select("node").union(shared.select(F.col("pivot").alias("node"))).distinct()
    wanted = nodes.join(wanted, "node").select("node", F.col("doc_id").alias("rep_id"), F.col("tie").alias("rep_tie"), "sketch")
    same = rows.doc_id.eqNullSafe(wanted.rep_id) & (rows.tie == wanted.rep_tie)
    # rows that repeat both id and text would stand twice for their node
    full = rows.join(wanted, same).select("node", "sketch", "text").mapInArrow(_hashes, "node long, hashes binary, sketch binary").dropDuplicates(["node"])
    full = written(full, f"{path}/sets")

    def side(name: str) -> DataFrame:
        return full.select(F.col("node").alias(name), F.col("hashes").alias(f"hashes_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    stars = members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tried = stars.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sketch_a", "sketch_b", "hashes_a", "hashes_b")
    links = written(tried.mapInArrow(_confirm(threshold), "a long, b long"), f"{path}/stars")
    labels = written(components(links), f"{path}/labels")

    # what stars leave open: buckets whose nodes beside the pivot lie in several components
    placed = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("key", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    placed = written(placed, f"{path}/placed")
    sizes = placed.groupBy("key", "band", "label").agg(F.count("*").alias("m"), F.sum(8 * F.col("n")).alias("bytes"))
    sizes = sizes.groupBy("key", "band").agg(F.max(F.struct("m", "label", "bytes")).alias("top"), F.sum("m").alias("m"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels")).where("labels > 1")
    parts = lambda m, held: F.greatest(F.ceil(m / block), F.ceil(held / SIDE_BYTES)).cast("int")
    sizes = sizes.select("key", "band", F.col("top.label").alias("top"), parts(F.col("m") - F.col("top.m"), F.col("bytes") - F.col("top.bytes")).alias("few"), parts(F.col("top.m"), F.col("top.bytes")).alias("many"))
    spread = placed.join(sizes, ["key", "band"])
    at = F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("top"), F.col("many")).otherwise(F.col("few"))).cast("int")
    spread = spread.withColumn("at", at)
    # blocks of the largest component are numbered from -1 down; every block pair is named by its two numbers
    pairs = F.when(
        F.col("label") == F.col("top"), F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda k: F.struct((-1 - F.col("at")).alias("i"), k.alias("j"), F.lit(0).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda k: F.struct(F.least(k, "at").alias("i"), F.greatest(k, "at").alias("j"), (F.col("at") > k).cast("int").alias("side"))),
            F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda k: F.struct((-1 - k).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"))),
        )
    )
    spread = spread.select("key", "band", "node", "label", F.explode(pairs).alias("p")).select("key", "band", "node", "label", "p.i", "p.j", "p.side")
    compared = spread.join(full, "node").groupBy("key", "band", "i", "j").applyInArrow(_compare(threshold, width), "a long, b long")
    more = written(compared.distinct(), f"{path}/more")
    if not more.isEmpty():
        labels = written(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more)), f"{path}/relabelled")

    linked = labels.join(nodes.select(F.col("node").alias("id"), "digest", F.struct("doc_id", "tie").alias("who")), "id")
    least = linked.groupBy("label").agg(F.min("who").alias("least"))
    linked = linked.join(least, "label").select("digest", "least")
    alone = nodes.select("digest", F.struct("doc_id", "tie").alias("own"))
    found = written(alone.join(linked, "digest", "left").select("digest", F.coalesce("least", "own").alias("least")), f"{path}/found")
    out = sets.select("doc_id", "tie", "n_shingles", "digest").join(found, "digest", "left")
    least = F.coalesce("least", F.struct("doc_id", "tie"))
    return out.select("doc_id", "tie", "n_shingles", least["doc_id"].alias("component_id"), least["tie"].alias("component_tie"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    found = groups(docs, threshold, block, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, that stand for their group: least doc_id, then least text hash."""
    found = groups(docs, threshold, block, id_col, text_col)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("tie") == F.col("component_tie"))).select("doc_id", "tie").distinct()
    return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay.doc_id) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == stay.tie), "left_semi")
