"""Operator 6. Exact deduplication as a stateful stream, in DataFrame operations alone.

A first pass writes a key per row: doc_id, the SHA-256 of its normalised text, and its content
locator (file and row in it). Key files are a stream: micro-batches of FILES files update state
keyed by digest in RocksDB, which lies on disk and never expires; it retains the least doc_id with
its locator, and the group's size. A sink keeps each batch's changed states under its epoch, so a
repeated batch writes the same folder again, and a later run over more key files goes on from the
checkpoint.

Hits are then checked against full bytes: texts of groups of two or more are fetched by locator and
compared with that of the row that stays; a large group is dealt over many tasks, each with a copy of
that text, and the most frequent digests get their verdict by broadcast. Rows that share a digest but not the text are grouped
again by text, so a digest's collision never drops a document.

Texts are equal when they are after each run of ASCII white space becomes one space. Cases: null
counts as empty; a null doc_id is least; of rows that repeat id and text, the least locator stays
where one row must (keep_first), and all show kept; an empty table gives no rows; a very long text is
one text like any other. Other columns of the input aren't touched, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import SPACE, join_split, text_of, work_dir, written

#: Key files of a micro-batch.
FILES = 64
#: Rows of a group that are held against one copy of the text that stays.
SHARED = 64
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each state partition reserves 4 MB of disk for its manifest, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
KEYS = "doc_id long, sha binary, digest binary, file string, row long"


def normalised(column: Column) -> Column:
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), SPACE, " ")


def located(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs with the columns of its file and its row in it; a frame that isn't read from files is written first."""
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"])
    except AnalysisException:
        docs = written(docs, work_dir(docs.sparkSession, "located"))
        meta = docs.metadataColumn("_metadata")
    return docs, meta["file_path"], meta["row_index"]


def stream_states(spark: SparkSession, keys: str, states: str, checkpoint: str, files: int = FILES) -> None:
    """Runs the stream over what is new among the key files; states gets a folder of changed states per epoch."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", files).parquet(keys)
        state = stream.groupBy("digest").agg(F.min(F.struct("doc_id", "file", "row")).alias("keeper"), F.count("*").alias("group_size"))

        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{states}/epoch={epoch}")

        state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_states(spark: SparkSession, states: str) -> DataFrame:
    """digest, keeper, group_size: of each digest, the last epoch's."""
    table = spark.read.schema("digest binary, keeper struct<doc_id: long, file: string, row: long>, group_size long, epoch int").parquet(states)
    return table.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "epoch").alias("s")).select("digest", "s.keeper", "s.group_size")


def _verdicts(docs: DataFrame, file: Column, row: Column, path: str, id_col: str, text_col: str, digest_bytes: int, files: int) -> DataFrame:
    """Of each row: its key, keep_id, keep_file, keep_row and group_size."""
    spark = docs.sparkSession
    sha = F.unhex(F.sha2(normalised(docs[text_col]).cast("binary"), 256))
    keys = docs.select(docs[id_col].cast("long").alias("doc_id"), sha.alias("sha"), file.alias("file"), row.alias("row"))
    keys = written(keys.select("doc_id", "sha", F.substring("sha", 1, digest_bytes).alias("digest"), "file", "row"), f"{path}/keys")
    if keys.isEmpty():
        return keys.select("*", F.lit(None).cast("long").alias("keep_id"), F.lit("").alias("keep_file"), F.lit(0).cast("long").alias("keep_row"), F.lit(0).cast("long").alias("group_size"))
    stream_states(spark, f"{path}/keys", f"{path}/states", f"{path}/checkpoint", files)
    states = written(latest_states(spark, f"{path}/states"), f"{path}/latest")
    total = keys.count()
    judged = join_split(keys, states, "digest", "group_size", total).select("doc_id", "sha", "digest", "file", "row", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.file").alias("keep_file"), F.col("keeper.row").alias("keep_row"), "group_size")

    # full bytes of every hit against those of the row that stays, which is copied once for each SHARED rows of its group
    copies = F.ceil(F.col("group_size") / SHARED).cast("int")
    hits = judged.where("group_size > 1").select("digest", F.col("file").alias("at_file"), F.col("row").alias("at_row"), ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("stays"), copies.alias("copies"))
    texts = docs.select(file.alias("file"), row.alias("row"), docs[text_col].alias("text")).join(hits, (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row")))
    texts = written(texts.select("digest", "file", "row", "stays", "copies", normalised(F.col("text")).alias("text")), f"{path}/hits")
    stay = texts.where("stays").select("digest", F.col("text").alias("stay_text"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("share"))
    others = texts.where("not stays").withColumn("share", F.pmod(F.xxhash64("file", "row"), F.col("copies")).cast("int"))
    differ = others.join(stay, ["digest", "share"]).where("text <> stay_text").select("digest").distinct()
    differ = written(differ, f"{path}/differ")
    if differ.isEmpty():
        return judged
    torn = texts.join(differ, "digest", "left_semi").join(keys.select("doc_id", "file", "row"), ["file", "row"])
    apart = torn.groupBy("digest", "text").agg(F.min(F.struct("doc_id", "file", "row")).alias("new"), F.count("*").alias("new_size"))
    fixed = torn.join(apart, ["digest", "text"]).select("file", "row", "new", "new_size")
    return judged.join(fixed, ["file", "row"], "left").select(
        "doc_id", "sha", "digest", "file", "row", *(F.when(F.col("new_size").isNull(), F.col(was)).otherwise(F.col(now)).alias(was) for was, now in (("keep_id", "new.doc_id"), ("keep_file", "new.file"), ("keep_row", "new.row"), ("group_size", "new_size")))
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, files: int = FILES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. digest_bytes: how much of the SHA-256 keys the state."""
    path = work_dir(docs.sparkSession, "dedup")
    judged = _verdicts(*located(docs), path, id_col, text_col, digest_bytes, files)
    return judged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: int = FILES) -> DataFrame:
    """The rows of docs, columns as they are, that stay: one of each group of equal texts."""
    columns, path = docs.columns, work_dir(docs.sparkSession, "dedup")
    docs, file, row = located(docs)
    stay = _verdicts(docs, file, row, path, id_col, text_col, 32, files).where((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).select(F.col("file").alias("at_file"), F.col("row").alias("at_row"))
    return docs.join(stay, (file == stay.at_file) & (row == stay.at_row), "left_semi").select(*(docs[c] for c in columns))
