"""Operator 4. Token counts through a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens), where tokenizer is the digest of the
tokenizer's file and digest that of a normalised text. Digests are held against the cache first;
only distinct texts without a stored count are then moved, encoded once and appended; every document
gets its count by a join on digests, in which the most frequent ones are broadcast.

The byte-level tokenizer keeps every character, so its normalised content is the text itself, null
as empty: any further folding could change a count. Cases: repeated rows count once and get equal
results; an empty table returns no rows and appends nothing; an append that a lost executor repeats,
or two runs that append the same digest, leave equal rows, which the read folds into one; a very long
text is one text like any other, and texts are encoded in blocks of a bounded size. Only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import exists, in_blocks, join_split, text_of, work_dir, written
from tickspark.llm.tokens import BLOCK_BYTES, encoder, version_digest

#: Missing digests that may be broadcast (some 50 MB); more are joined by shuffling.
SENT = 500_000
CACHE = "tokenizer string, digest binary, n_tokens long"


def _count(path: str, drops_space: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, drops_space)
        for block in in_blocks(batches, "text", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([block.column("digest"), pa.array(enc.count(block.column("text")))], names=["digest", "n_tokens"])

    return run


def stored(spark, cache: str, version: str) -> DataFrame:
    table = spark.read.schema(CACHE).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], CACHE)
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, drops_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; cache: folder of the cache table in a shared store."""
    spark, version = docs.sparkSession, version_digest(tokenizer)
    digest = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    path = work_dir(spark, "counts")
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes")), f"{path}/rows")
    distinct = rows.groupBy("digest").agg(F.count("*").alias("uses"))
    misses = written(distinct.join(stored(spark, cache, version), "digest", "left_anti").select("digest"), f"{path}/misses") if exists(spark, cache) else None
    # texts move only if their digest is missing
    texts = docs.select(digest.alias("digest"), text_of(text_col).alias("text"))
    n = None if misses is None else misses.count()
    if n is not None and n <= SENT:
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")  # at most SENT digests of 32 bytes
    if n != 0:
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n is not None and n > SENT:
            texts = texts.join(misses, "digest", "left_semi")
        new = texts.mapInArrow(_count(tokenizer, drops_space), "digest binary, n_tokens long")
        new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache)
    # a digest that a third of all rows share isn't dealt to one task
    facts = written(stored(spark, cache, version).join(distinct, "digest"), f"{path}/facts")
    return join_split(rows, facts, "digest", "uses", rows.count()).select("doc_id", "n_bytes", "n_tokens")
