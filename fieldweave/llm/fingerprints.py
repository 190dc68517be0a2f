"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases whose borders depend only on a few neighbouring symbols: runs of a symbol are
collapsed, deterministic coin tossing (Cole and Vishkin 1986; Sahinalp and Vishkin 1994) shrinks each symbol to a
label that differs from its neighbours' labels, and a phrase begins at each local maximum. A phrase's name is a hash
of its symbols; names are the symbols of the next level. So equal substrings get equal names but near their ends,
wherever they stand. A fingerprint is a one-permutation min-hash (Li, Owen and Zhang 2012) of the names of the upper
levels: ``BINS`` values of 16 bits, in hex; its likeness to another estimates the Jaccard similarity of the names.

Defined cases: a null text is the empty text; the empty fingerprint is all zeros and like only to itself; equal texts
have equal fingerprints; very long texts are parsed whole. Documents are ordered by id (null first), then by a hash of
their text; the document after the last is the first, and a single document follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BINS = 128
#: Levels whose names make up the fingerprint; finer ones are shared by all texts of a language. Names of the
#: level after the first count more, as there are fewer of them.
FIRST_LEVEL, COPIES = 2, 3
#: Bytes of text parsed at once.
CHUNK = 1 << 20

_POW = np.array([pow(0x9E3779B97F4A7C15 | 1, i, 1 << 64) for i in range(4096)], np.uint64)


def toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 2 * k + bit k of x, k being the lowest bit in which x differs from the symbol before it."""
    diff = np.empty_like(x)
    diff[1:] = x[1:] ^ x[:-1]
    diff[first] = 1
    low = diff & (~diff + x.dtype.type(1))
    k = np.bitwise_count(low - x.dtype.type(1)).astype(np.uint8)
    bit = ((x & low) != 0).astype(np.uint8)
    return 2 * k + bit


def level(sym: np.ndarray, offs: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, offsets) of the phrases of texts of symbols (neighbours within a text may be equal)."""
    if not len(sym):
        return np.zeros(0, np.uint64), np.zeros_like(offs)
    head = np.zeros(len(sym), bool)
    inner = offs[:-1][np.diff(offs) > 0]
    head[inner] = True
    fresh = head.copy()
    fresh[1:] |= sym[1:] != sym[:-1]
    at = np.flatnonzero(fresh)  # runs
    run = np.diff(np.append(at, len(sym)))
    x, first = sym[at], head[at]
    starts = np.flatnonzero(first)
    label = x
    for _ in range(4 if x.dtype.itemsize > 1 else 3):
        label = toss(label, starts)
    after = np.full(len(label), 255, np.uint8)
    after[:-1] = label[1:]
    after[np.append(starts[1:], len(label)) - 1] = 255
    before = np.full(len(label), 255, np.uint8)
    before[1:] = label[:-1]
    begin = np.flatnonzero(first | ((label > before) & (label > after)))
    size = np.diff(np.append(begin, len(label)))
    with np.errstate(over="ignore"):
        place = np.arange(len(label)) - np.repeat(begin, size)
        value = C.mix(x.astype(np.uint64) + np.uint64(1) + (run.astype(np.uint64) << np.uint64(40 if x.dtype.itemsize == 1 else 1)) * np.uint64(salt * 2 + 1))
        names = C.mix(np.add.reduceat(value * _POW[place % len(_POW)], begin) + np.uint64(salt))
    return names, np.searchsorted(at[begin], offs)


def sketches(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of BINS 16-bit values for each text; 0 stands for an empty bin."""
    n = len(offs) - 1
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    sym, at = data, offs
    active = np.ones(n, bool)  # a text ends with the level at which it is one phrase
    k = 0
    while active.any():
        k += 1
        sym, at = level(sym, at, k)
        if k < FIRST_LEVEL:
            continue
        doc = np.repeat(np.arange(n), np.diff(at))
        use = active[doc]
        for copy in range(COPIES if k > FIRST_LEVEL else 1):
            with np.errstate(over="ignore"):
                h = C.mix(sym[use] + np.uint64(1000 * k + copy))
            np.minimum.at(least, doc[use] * BINS + (h >> np.uint64(57)).astype(np.int64), h & np.uint64((1 << 57) - 1))
        active &= np.diff(at) > 1
    least = least.reshape(n, BINS)
    out = (C.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    out[out == 0] = 1
    out[least == np.iinfo(np.uint64).max] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of each row of a to the same row of b, 0 to 1."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def hexed(a: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in a.astype(">u2")]


def sketch_texts(texts: list[str]) -> np.ndarray:
    """Sketches of texts, parsed in chunks of bounded bytes."""
    data, offs = C.text_bytes(pa.array(texts, pa.large_string()))
    out = [sketches(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in C.chunks(offs, CHUNK)]
    return np.concatenate(out) if out else np.zeros((0, BINS), np.uint16)


def fingerprint(docs: DataFrame) -> DataFrame:
    """The documents with their fingerprint; an extra column of that name is replaced."""
    C.prepare(docs.sparkSession)
    kept = docs.drop("fingerprint")
    schema = T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = hexed(sketch_texts([t or "" for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())], [*b.schema.names, "fingerprint"])

    return C.map_arrow(kept, run, schema)


def borders(quantiles: list[int] | None, known: int, rows: int, n: int) -> list[tuple[bool, int, int]]:
    """Where ranges begin, as (has an id, id, hash of the text). An id that several quantiles meet, and rows without an
    id, get as many ranges as their share asks for, by the hash."""
    def parts(k: int) -> list[int]:
        return [-(1 << 63) + (j << 64) // k for j in range(1, k)]

    out = [(False, 0, t) for t in parts(max(1, round(n * (rows - known) / max(1, rows))))]
    for c in sorted(set(quantiles or [])):
        out += [(True, c, -(1 << 63)), *((True, c, t) for t in parts(quantiles.count(c)))]
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, tie, ghost): the documents in ordered id ranges, each range closed by a copy, marked as
    ghost, of the first document of the range after it. Ranges come from quantiles of the ids; only their borders,
    one row a range, reach the driver. An id of very many rows is cut by their texts."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    cuts = borders(*keyed.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000), F.count("doc_id"), F.count("*")).first(), n)
    # a range holds what comes from its cut on; null ids come before all
    spot = F.lit(0)
    if cuts:
        kind = "struct<known:boolean,id:bigint,tie:bigint>"
        here = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("tie")).cast(kind)
        table = F.array(*(F.struct(*map(F.lit, c)).cast(kind) for c in cuts))
        middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        step = lambda s: F.when(F.get(table, middle(s)) <= here, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
        rounds = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
        spot = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), lambda s, _: F.when(s["lo"] < s["hi"], step(s)).otherwise(s))["lo"]
    keyed = keyed.withColumn("bucket", spot)
    heads = sorted((r["bucket"], r["h"]) for r in keyed.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("h")).collect())
    if not heads:
        return keyed.withColumn("ghost", F.lit(False))
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    marks = spark.createDataFrame([(b, h["doc_id"], h["tie"], before[b]) for b, h in heads], "bucket int, head long, head_tie long, before int")
    same = (keyed["bucket"] == marks["bucket"]) & keyed["doc_id"].eqNullSafe(marks["head"]) & (keyed["tie"] == marks["head_tie"])
    to = F.when(F.col("before").isNull(), F.array(F.struct(keyed["bucket"], F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(keyed["bucket"], F.lit(False).alias("ghost")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"))))
    # marks has one row a range: its size is bounded by the number of partitions
    both = keyed.join(F.broadcast(marks), same, "left").select("doc_id", "text", "tie", F.explode(to).alias("to"))
    return both.select("to.bucket", "doc_id", "text", "tie", "to.ghost")


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to one another and to the next's."""
    spark = docs.sparkSession
    C.prepare(spark)
    # each range is a partition of its own
    ranged = with_next(docs).repartitionById(C.partitions(spark), F.col("bucket")).sortWithinPartitions("bucket", "ghost", "doc_id", "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(held: list[tuple]) -> pa.RecordBatch:
        """held: (doc_id, text) of successive documents and, last, the one after them."""
        ids, texts = [h[0] for h in held[:-1]], [h[1] for h in held]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = sketch_texts(texts), sketch_texts(changed)
        prints = hexed(own[:-1])
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(prints, pa.string()), pa.array(hexed(other), pa.string()),
            pa.array(likeness(own[:-1], other), pa.float64()), pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, closed = 0, None
        for batch in batches:
            for bucket, doc_id, text, _, ghost in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket == closed:  # equal rows share a ghost
                    continue
                held.append((doc_id, text))
                size += len(text)
                if ghost:
                    closed = bucket
                    if len(held) > 1:
                        yield rows(held)
                    held, size = [], 0
                elif size > CHUNK and len(held) > 1:
                    yield rows(held)
                    held, size = held[-1:], len(held[-1][1])

    return C.map_arrow(ranged, run, schema)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
