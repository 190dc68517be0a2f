"""What the operators of this subpackage share: the shared folder, tables cut from their lineage, and
byte-level tokenising of Arrow batches with numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

#: Words: runs of letters, digits and anything outside ASCII, after A-Z are lowered.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tokens: runs of anything but ASCII white space.
SPACE_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_ALNUM = (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90))
_SOLID = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))


# ---------------------------------------------------------------- shared folder and tables


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set a temporary one will do in local mode, as
    in tests; on a cluster other machines would not see it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        given = _own_dirs.get(key) or _own_dirs.setdefault(key, tempfile.mkdtemp(prefix="fieldweave-"))
    return given.rstrip("/")


_own_dirs: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back. Survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            to = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(to, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that very long texts do not pile up in one; and this subpackage's code for the
    workers, wherever they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder URI; a bare path is local."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(uri: str, name: str) -> Iterator:
    """A stream under a private name, moved when it is whole: a task that is run again replaces the file by an equal
    one, and one that fails leaves none."""
    fsys, path = filesystem(uri)
    fsys.create_dir(path, recursive=True)
    private = f"{path}/.{name}-{uuid.uuid4().hex[:8]}"
    try:
        with fsys.open_output_stream(private) as out:
            yield out
        fsys.move(private, f"{path}/{name}")
    except BaseException:
        with contextlib.suppress(OSError):
            fsys.delete_file(private)
        raise


def write_file(uri: str, name: str, chunks: list[bytes]) -> None:
    with new_file(uri, name) as out:
        for c in chunks:
            out.write(c)


def store_arrays(uri: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the header's length, the header (names, types, places), the arrays from multiples of 64 bytes on."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [v.dtype.str, len(v), at]
        at += -(-v.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 8) % 64)
    with new_file(uri, name) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for v in arrays.values():
            out.write(v.tobytes() + bytes(-v.nbytes % 64))


def load_arrays(uri: str) -> tuple[dict[str, np.ndarray], bool]:
    """(arrays, whether they are mapped): mapped in place where the folder is a mounted one, else read into memory."""
    fsys, path = filesystem(uri)
    mapped = os.path.exists(path)
    if mapped:
        with open(path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with fsys.open_input_file(path) as f:
            raw = f.read()
    n = int.from_bytes(raw[:8], "little")
    return {k: np.frombuffer(raw, kind, size, 8 + n + at) for k, (kind, size, at) in json.loads(raw[8 : 8 + n]).items()}, mapped


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow, after which a worker gives back what it no longer needs: workers live on from stage to stage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Hand free memory back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def packed(df: DataFrame) -> Column:
    """All columns of a row as one, so that names added beside it cannot clash; ``select("row.*")`` undoes it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


# ---------------------------------------------------------------- bytes and tokens


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None and len(offs) else np.zeros(0, np.uint8)
    return data, offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def chunks(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, one row at least."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class HashTable:
    """Numbers of distinct 64-bit hashes, by an open-addressed table that is asked for many at once."""

    def __init__(self, hashes: np.ndarray = np.zeros(0, np.uint64)):
        self.count, self.key, self.slot = 0, np.zeros(16, np.uint64), np.full(64, -1, np.int32)
        self.add(hashes)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes that are distinct and not known yet get the next numbers."""
        n = self.count + len(hashes)
        if n > len(self.key):
            self.key = np.concatenate([self.key[: self.count], np.zeros(max(n, 2 * self.count) - self.count, np.uint64)])
        self.key[self.count : n] = hashes
        new = np.arange(self.count, n, dtype=np.int32)
        if 2 * n > len(self.slot):
            self.slot = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32)
            new = np.arange(n, dtype=np.int32)
        self.count = n
        mask = len(self.slot) - 1
        at = (self.key[new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = self.slot[at] < 0
            self.slot[at[free]] = new[free]  # of several for a slot one gets it, the others go on
            left = self.slot[at] != new
            new, at = new[left], (at[left] + 1) & mask

    def find(self, x: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for the unknown."""
        mask = len(self.slot) - 1
        at = (x & np.uint64(mask)).astype(np.int64)
        out = self.slot[at]
        odd = np.flatnonzero((out >= 0) & (self.key[out] != x))
        while len(odd):
            at[odd] = (at[odd] + 1) & mask
            now = self.slot[at[odd]]
            out[odd] = now
            odd = odd[(now >= 0) & (self.key[now] != x[odd])]
        return out


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 20)
        inv = np.uint64(pow(int(_B), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for k, b in (("up", _B), ("down", inv)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Tokens:
    """Tokens of some texts: byte ranges start..end in data, 64-bit hashes, and offsets by text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, words: bool = True, fold: bool = True, cut: np.ndarray | None = None):
        """cut: bytes at which a token begins even if the one before belongs to a token too."""
        raw = data
        self.data = data = _LOWER[data] if fold else data
        solid = (_ALNUM if words else _SOLID)[raw]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        if cut is not None:
            before &= ~cut
            after[:-1] &= ~cut[1:]
        inner = offs[:-1][offs[:-1] < len(data)]
        before[inner] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.offs = np.searchsorted(self.start, offs)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def doc(self) -> np.ndarray:
        """The text's number of each token."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def spelled(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, starts) of some tokens, each followed by a space."""
        size = self.end[which] - self.start[which] + 1
        ends = np.cumsum(size)
        starts = ends - size
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[which] - starts, size)
        out = self.data[np.minimum(place, max(0, len(self.data) - 1))]
        out[ends - 1] = 32
        return out, starts


def tokens(col: pa.Array, words: bool = True, most: int = 1 << 20) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, end row, tokens) of successive runs of texts."""
    data, offs = text_bytes(col)
    for a, b in chunks(offs, most):
        yield a, b, Tokens(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)


def grams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all n-word shingles; a text of fewer words, but not none, has all of them as one."""
    count = np.diff(t.offs)
    doc = t.doc()
    left = t.offs[1:][doc] - np.arange(len(doc))
    with np.errstate(over="ignore"):
        h = np.zeros(len(doc), np.uint64)
        for k in range(n):
            src = np.zeros(len(doc), np.uint64)
            if k < len(doc):
                src[: len(doc) - k] = t.hash[k:]
            h = np.where(left > k, mix(h * np.uint64(3) + src + np.uint64(k + 1)), h)
    keep = (left >= n) | ((count[doc] < n) & (left == count[doc]))
    return h[keep], doc[keep]
