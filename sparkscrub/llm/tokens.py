"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids, stripes read in parallel.

Documents are ranged by id, encoded whole and written one file per range with rows in ascending id. ORC stores the ids
with its integer run-length encoding; the row index and the Bloom filter of doc_id let a reader of few documents skip stripes and row
groups. `start` (tokens of all documents before) is a running total in two steps: the files' sums, then the rows of each file.

A null text is empty and has the end id alone. Null ids come first. Rows that repeat an id stay separate, in the order of their texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, tidy
from .encoder import encoder

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Characters given to the tokenizer at once where texts are needed as Python strings; a longer text goes alone.
BATCH_CHARS = 1 << 20
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def runs(texts: pa.Array, limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about `limit` characters; nulls are empty."""
    batch, size, first = [], 0, 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if batch and size + len(text) > limit:
            yield first, batch
            batch, size, first = [], 0, i
        batch.append(text)
        size += len(text)
    if batch:
        yield first, batch


def encode(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of doc_id, text, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for first, end, data, bounds in slices(batch["text"], BATCH_BYTES):
                flat, cuts, _, _ = model.encode_bytes(data, bounds)
                if end_id is not None:
                    flat, cuts = np.insert(flat, cuts[1:], end_id), cuts + np.arange(len(cuts))
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, end - first), pa.array(np.diff(cuts), pa.int64()), ids],
                                                 names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>")


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID) -> None:
    """Write the ids of all documents in ascending id; one file per range of ids."""
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = encode(ranged, path, end_id).withColumn("file", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    (rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
     .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).option("orc.compress", "zstd").orc(folder))


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; given ids are pushed down, so stripes and row groups without them are skipped by their statistics and filters."""
    schema = "doc_id long, n_tokens long, ids array<int>, file int, row long"
    rows = spark.read.schema(schema).orc(folder)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`rows` with `start`, the tokens of all rows before. One number per file is summed up in order; the rows only within their file.

    `counts` are the same rows with file and n_tokens alone, read without their ids."""
    files = counts.groupBy("file").agg(F.sum("n_tokens").alias("inside"))
    files = files.withColumn("before", F.sum("inside").over(Window.orderBy("file")) - F.col("inside")).select("file", "before")
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("within", within).join(files, "file").withColumn("start", F.col("before") + F.col("within")).drop("within", "before")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, file, row and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(values[a:b].data) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("doc_id", "n_tokens", "file", "row")] + [pa.array(sums, pa.int64())],
                                             names=["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, file int, row long, ids_crc32 long")


def token_table(docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID) -> DataFrame:
    """Write the documents' ids to `folder`, read them back: doc_id, start, n_tokens, ids_crc32."""
    write(docs, folder, path, end_id)
    rows = read(docs.sparkSession, folder)
    return starts(checksums(rows), rows.select("file", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
