"""Token counts of flat token files by a separator scan.

A flat file is token ids one after another, two bytes each, little-endian, with the end-of-document id after
each document and no index. Files are cut into blocks by byte range; each block finds the end-of-document
ids in one vectorised comparison, and documents that cross blocks are stitched by a prefix scan over the
blocks: how many documents ended before a block, and how many tokens are open at its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import freed_shuffles, staging_path

#: Bytes of a record in the file of ids: the id, whether it is null, and the end marker.
RECORD = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u2")])
#: Files up to so many bytes are read whole by Spark, from any store that it reads; larger ones range by range.
WHOLE_FILE = 64 << 20


def write_flat(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, end: int, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the texts' tokens below ``path``/kind=tokens and, in the same order, their ids below kind=ids.

    Both files of a part come from one task, sorted by id. Spark's own writer writes the bytes, the end
    marker being its line separator, so the files go to any store that Spark writes to and a lost task
    leaves nothing behind. Null texts are documents without tokens. Ids below 65,536 only.
    """
    import tiktoken

    if end >= 1 << 16 or len(ranks) >= 1 << 16:
        raise ValueError("two bytes hold ids below 65536")
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = slim.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=dict(shared.value), special_tokens={})
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            tokens = [np.array(encoding.encode_ordinary(t.as_py()), dtype="<u2").tobytes() for t in batch.column("text")]
            names = [int(i or 0).to_bytes(8, "little", signed=True) + bytes([i is None]) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(["ids"] * len(ids) + ["tokens"] * len(ids)), pa.array(ids * 2, type=pa.int64()), pa.array(names + tokens, type=pa.binary())], names=["kind", "doc_id", "value"])

    rows = slim.mapInArrow(run, "kind string, doc_id bigint, value binary").sortWithinPartitions("kind", "doc_id", "value")
    marker = end.to_bytes(2, "little").decode("latin-1")
    with freed_shuffles(docs.sparkSession):
        rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", marker).text(path)


def _blocks(spark: SparkSession, path: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """path, block, start, stop and raw (the bytes) of byte ranges: of small files, which Spark reads, and of large ones, whose
    bytes are left to the task that scans a range."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    count = F.floor((F.col("length") - 1) / block_bytes)
    start = F.col("block") * block_bytes

    def cut(some: DataFrame, *content: str) -> DataFrame:
        blocks = some.select("path", "length", *content, F.explode(F.sequence(F.lit(0).cast("bigint"), count)).alias("block"))
        raw = F.expr(f"substring(content, CAST(block * {block_bytes} + 1 AS INT), {block_bytes})") if content else F.lit(None).cast("binary")
        return blocks.select("path", "block", start.alias("start"), F.least(F.col("length"), start + block_bytes).alias("stop"), raw.alias("raw"))

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    large = cut(files.filter(F.col("length") > WHOLE_FILE)).repartition(tasks, "path", "block")
    return cut(files.filter(F.col("length") <= WHOLE_FILE), "content"), large


def _bytes_of(row) -> bytes:
    if row.raw is not None:
        return bytes(row.raw)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(row.path)
    with store.open_input_file(name) as f:
        return f.read_at(row.stop - row.start, row.start)


def _scanned(spark: SparkSession, path: str, block_bytes: int, scan, schema: str) -> DataFrame:
    small, large = _blocks(spark, path, block_bytes)
    return small.mapInPandas(scan, schema).unionByName(large.mapInPandas(scan, schema))


def count_tokens(spark: SparkSession, path: str, end: int, block_bytes: int = 8 << 20) -> DataFrame:
    """path, ordinal (from 0), first_token, n_tokens of every document in the flat files below ``path``.

    ``block_bytes`` is even. Blocks send only where their documents end; a document longer than many blocks
    is open through them. Tokens after a file's last end marker are a document too (a file cut short);
    a file without bytes has none. An odd last byte is not a token.
    """
    if block_bytes % 2:
        raise ValueError("a block holds whole tokens")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                raw = _bytes_of(r)
                tokens = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<u2")
                ends = np.flatnonzero(tokens == end)
                sizes = np.diff(ends, prepend=-1) - 1
                yield pd.DataFrame({"path": [r.path], "block": [r.block], "first": [r.start // 2], "tokens": [len(tokens)], "ended": [len(ends)], "tail": [len(tokens) - (ends[-1] + 1) if len(ends) else len(tokens)], "sizes": [sizes.astype(np.int64)]})

    found = _scanned(spark, path, block_bytes, scan, "path string, block bigint, first bigint, tokens bigint, ended bigint, tail bigint, sizes array<bigint>")
    # The prefix scan: a file's blocks in order, one short row for each.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    group = F.coalesce(F.sum(F.when(F.col("ended") > 0, 1).otherwise(0)).over(before), F.lit(0))
    marked = found.withColumns({"earlier": F.coalesce(F.sum("ended").over(before), F.lit(0)), "run": group})
    # Open at a block's start: the tails of the blocks since the last one in which a document ended.
    since = Window.partitionBy("path", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.last(F.when(F.col("ended") > 0, F.col("tail")), ignorenulls=True).over(before)
    open_ = F.coalesce(F.sum(F.when(F.col("ended") == 0, F.col("tail")).otherwise(0)).over(since), F.lit(0)) + F.coalesce(last_tail, F.lit(0))
    after = Window.partitionBy("path").orderBy(F.col("block").desc())
    marked = marked.withColumns({"open": open_, "last": F.row_number().over(after) == 1})
    ended = marked.select("path", "earlier", "open", "first", F.posexplode("sizes").alias("i", "n"))
    place = Window.partitionBy("path", "first").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ended = ended.withColumn("skipped", F.coalesce(F.sum(F.col("n") + 1).over(place), F.lit(0)))
    closed = ended.select("path", (F.col("earlier") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("first") - F.col("open")).otherwise(F.col("first") + F.col("skipped")).alias("first_token"), (F.col("n") + F.when(F.col("i") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    rest = F.col("tail") + F.when(F.col("ended") == 0, F.col("open")).otherwise(0)
    cut = marked.filter(F.col("last") & (rest > 0)).select("path", (F.col("earlier") + F.col("ended")).alias("ordinal"), (F.col("first") + F.col("tokens") - rest).alias("first_token"), rest.alias("n_tokens"))
    return closed.unionByName(cut)


def read_ids(spark: SparkSession, path: str, block_records: int = 100_000) -> DataFrame:
    """path, ordinal, doc_id from files of ids that write_flat wrote."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                records = np.frombuffer(_bytes_of(r), dtype=RECORD)
                ids = pd.array(records["doc_id"].copy(), dtype="Int64")
                ids[records["null"] == 1] = pd.NA
                yield pd.DataFrame({"path": r.path, "ordinal": r.start // RECORD.itemsize + np.arange(len(records)), "doc_id": ids})

    return _scanned(spark, path, RECORD.itemsize * block_records, read, "path string, ordinal bigint, doc_id bigint")


def part(path: str = "path"):
    """The number of a part file: the same for the tokens and the ids that one task wrote."""
    return F.regexp_extract(path, r"part-(\d+)", 1).cast("int")


def counted_documents(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, end: int, block_bytes: int = 8 << 20) -> DataFrame:
    """Flat files made from ``docs`` in the shared folder, scanned: doc_id, part, ordinal, first_token, n_tokens.

    An empty table gives no rows; rows with the same id are documents of their own.
    """
    spark = docs.sparkSession
    path = staging_path(spark, "flat")
    write_flat(docs, ranks, pattern, end, path)
    schema = "doc_id bigint, part int, ordinal bigint, first_token bigint, n_tokens bigint"
    kinds = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").contains("kind=tokens"))
    if not kinds.select("path").take(1):
        return spark.createDataFrame([], schema)
    counts = count_tokens(spark, f"{path}/kind=tokens", end, block_bytes).withColumn("part", part())
    ids = read_ids(spark, f"{path}/kind=ids").select(part().alias("part"), "ordinal", "doc_id")
    # Both sides grow with the documents, which their plans, made of short lists of files, do not tell.
    return counts.hint("merge").join(ids.hint("merge"), ["part", "ordinal"]).select("doc_id", "part", "ordinal", "first_token", "n_tokens")
