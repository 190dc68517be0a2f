"""Token counts by a separator scan over flat, unindexed token files.

A file is nothing but token ids, each document followed by an end-of-document id. Files are cut into blocks of bytes
without regard to documents; each block is read once, and the places of the separators in it are found by a vectorised
comparison. A prefix scan over the blocks of a file (a running sum of separators and a running maximum of their last
place) stitches documents that cross block borders: it gives each block its first document's number and where that
began. A document's count is the distance between its separators.

Defined cases: an empty file has no document; a document without tokens counts 0; ids after the last separator are one
more document, not closed; blocks without a separator only pass on; a null text is encoded as the empty text; very long
texts cross blocks as any do; repeated rows and ids are documents of their own; an empty table gives no files; extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .sstable import CHUNK, default_vocabulary, encoder_for

SEPARATOR = 49407
#: Ids are stored in the first of these that holds them all.
DTYPES = ("<u2", "<u4")
BLOCK_BYTES = 1 << 22


def dtype_for(vocabulary: str, separator: int = SEPARATOR) -> str:
    """The narrowest type that holds every id of the vocabulary, and the separator."""
    from tokenizers import Tokenizer

    most = max(separator, *Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values())
    return next(d for d in DTYPES if most <= np.iinfo(d).max)


def write_flat(docs: DataFrame, folder: str, separator: int = SEPARATOR, dtype: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Encode the texts into one flat file per partition, in row order; (file, bytes, ids) lists each file's documents.

    The strings of special tokens are ordinary text here, so the separator occurs nowhere else. Nothing is shuffled;
    a task that is run again replaces its file by an equal one.
    """
    C.prepare(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    dtype = dtype or dtype_for(vocabulary, separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, most = encoder_for(vocabulary, True), np.iinfo(dtype).max
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, size, ids = f"tokens-{TaskContext.get().partitionId():06d}.bin", 0, []
        with C.new_file(folder, name) as file:
            for batch in itertools.chain([first], batches):
                texts = batch.column(1)
                ids += batch.column(0).to_pylist()
                for a, b in C.chunks(C.text_bytes(texts)[1], CHUNK):
                    flat, offs = encoder.encode(texts.slice(a, b - a))
                    flat[offs[1:] - 1] = separator
                    if flat.max(initial=0) > most:
                        raise ValueError(f"an id beyond {dtype}")
                    file.write(flat.astype(dtype).tobytes())
                    size += len(flat) * np.dtype(dtype).itemsize
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "bytes", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.map_arrow(rows, run, "file string, bytes long, ids array<long>")


def scan(spark: SparkSession, folder: str, files: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPES[0], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, document, start, n_tokens, closed) of every document of the files (file, bytes); start is the place of
    its first id, document its number in the file from 0."""
    C.prepare(spark)
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    spans = files.filter("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("at"), "bytes")
    spans = spans.repartition(C.partitions(spark), "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                fsys, path = C.filesystem(f"{folder}/{name}")
                with fsys.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(step, size - at), at), dtype)
                found = np.flatnonzero(ids == separator) + at // width
                last = int(found[-1]) if len(found) else None
                yield pa.RecordBatch.from_arrays([
                    pa.array([name]), pa.array([at // width], pa.int64()), pa.array([at // width + len(ids)], pa.int64()), pa.array([found], pa.list_(pa.int64())), pa.array([last], pa.int64()),
                ], ["file", "first", "end", "found", "last"])

    blocks = C.materialise(C.map_arrow(spans, run, "file string, first long, end long, found array<long>, last long"), "separators")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("first").rowsBetween(1, Window.unboundedFollowing)
    # the scan over a file's blocks has four numbers a block; the separators themselves stay apart, however large the file
    places = blocks.select("file", "first", F.size("found").alias("n"), "last").select(
        "file", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("number"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"),
        F.count("*").over(after).alias("following"),
    )
    blocks = blocks.join(places, ["file", "first"])
    closed = F.transform("found", lambda p, i: F.struct((F.col("number") + i).alias("document"), F.when(i == 0, F.col("open")).otherwise(F.get("found", i - 1) + 1).alias("start"), p.alias("stop"), F.lit(True).alias("closed")))
    since = F.coalesce(F.col("last") + 1, F.col("open"))
    rest = F.when((F.col("following") == 0) & (since < F.col("end")), F.array(F.struct((F.col("number") + F.size("found")).alias("document"), since.alias("start"), F.col("end").alias("stop"), F.lit(False).alias("closed"))))
    docs = blocks.select("file", F.explode(F.concat(closed, F.coalesce(rest, F.filter(closed, lambda _: F.lit(False))))).alias("d"))
    return docs.select("file", F.col("d.document").alias("document"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.col("d.closed").alias("closed"))


def count_tokens(docs: DataFrame, block_bytes: int = BLOCK_BYTES, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, file, document, start, n_tokens): write flat files, scan them, and name the documents again."""
    spark = docs.sparkSession
    folder = C.shared_path(spark, "flat")
    vocabulary = vocabulary or default_vocabulary()
    dtype = dtype_for(vocabulary)
    files = C.materialise(write_flat(docs, folder, dtype=dtype, vocabulary=vocabulary), "flat-files")
    found = scan(spark, folder, files.select("file", "bytes"), dtype=dtype, block_bytes=block_bytes)
    names = files.select("file", F.posexplode("ids").alias("document", "doc_id")).select("file", F.col("document").cast("long").alias("document"), "doc_id")
    # both sides grow with the documents: neither is to be broadcast, however small its files look
    return names.hint("merge").join(found, ["file", "document"]).select("doc_id", "file", "document", "start", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
