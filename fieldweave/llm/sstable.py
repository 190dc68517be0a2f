"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order. Layout, all integers little-endian:

    block*   zstd frame of entries: varint shared key bytes, varint new key bytes, new key bytes,
             varint token count, the ids as unsigned 32-bit integers
    index    for each block: u16 key length, its first key, u64 place, u32 length
    bloom    bits of a Bloom filter over the keys
    footer   u64 index place, u32 index length, u64 bloom place, u32 bloom length, u32 hashes, u64 documents,
             u64 tokens, 8 bytes magic

Keys order as document ids do: one byte 0 for null or 1, then the id as a big-endian 64-bit integer with its sign
bit flipped. A lookup asks the Bloom filter, binary-searches the sparse index and reads one block. Shards follow one
another in key order, so a document's place among all ids is its shard's base plus its place within.

Defined cases: a null text is encoded as the empty text (just the end id); null ids sort first; repeated ids are kept
side by side, ordered by a hash of their text; a text longer than a block is a block of its own; an empty table gives no
shard; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

END_ID = 1
BLOCK_BYTES = 1 << 17
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"FWSSTAB2"
FOOTER = struct.Struct("<QIQIIQQ8s")
#: Pieces, and ids of theirs, that a worker remembers at most; then it starts anew.
CACHE_WORDS, CACHE_IDS = 1 << 20, 1 << 22
#: Bytes of text encoded at once, and pieces given to the tokenizer at once; an encoding with its offsets takes far more room than its ids.
CHUNK, LEARN_WORDS = 1 << 18, 500
#: Documents read back at once.
ROWS = 1000


_ASCII = [chr(b) if b < 128 else " " for b in range(256)]
_LETTER = np.array([c.isalnum() for c in _ASCII])
_SMALL = np.array([c.isalpha() and c.islower() for c in _ASCII])
_SIGN = np.array([not c.isalnum() and c not in " '" and c.isprintable() for c in _ASCII])


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def mark(key: bytes) -> bytes:
    """What the Bloom filter knows of a key."""
    return hashlib.blake2b(key, digest_size=16).digest()


def bloom_places(marks: bytes, bits: int, hashes: int) -> list[np.ndarray]:
    """For each hash the places of all marks; sums are modulo 2**64."""
    a, b = np.frombuffer(marks, "<u8").reshape(-1, 2).T
    with np.errstate(over="ignore"):
        return [((a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(bits)).astype(np.int64) for i in range(hashes)]


class Writer:
    """Writes documents, given in key order, into the stream of one shard: blocks leave as they fill, so that besides
    the block at hand only the sparse index and 16 bytes a document are held."""

    def __init__(self, out: BinaryIO, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes = out, block_bytes
        self.at = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.marks = bytearray()
        self.packer = zstandard.ZstdCompressor(level=1)
        self._new()

    def _new(self) -> None:
        self.block, self.size, self.last = [], 0, b""

    @property
    def documents(self) -> int:
        return len(self.marks) // 16

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first = key
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        raw = ids.astype("<u4", copy=False).tobytes()
        self.block += [varint(shared) + varint(len(key) - shared) + key[shared:] + varint(len(ids)), raw]
        self.size += len(raw) + len(key)
        self.last = key
        self.marks += mark(key)
        self.tokens += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.packer.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(packed)))
            self.out.write(packed)
            self.at += len(packed)
            self._new()

    def finish(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", a, n) for k, a, n in self.index)
        bits = max(64, -(-BLOOM_BITS * self.documents // 8) * 8)
        bloom = np.zeros(bits // 8, np.uint8)
        for p in bloom_places(bytes(self.marks), bits, BLOOM_HASHES):
            np.bitwise_or.at(bloom, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), BLOOM_HASHES, self.documents, self.tokens, MAGIC)
        for part in (index, bloom.tobytes(), footer):
            self.out.write(part)


class Reader:
    """Opens a shard; reads it through or looks single documents up."""

    def __init__(self, uri: str):
        fsys, path = C.filesystem(uri)
        self.file = fsys.open_input_file(path)
        size = self.file.size()
        ia, il, ba, bl, self.hashes, self.documents, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        raw, at = self.file.read_at(il, ia), 0
        self.index: list[tuple[bytes, int, int]] = []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.index.append((raw[at + 2 : at + 2 + n], *struct.unpack_from("<QI", raw, at + 2 + n)))
            at += 2 + n + 12
        self.bloom = self.file.read_at(bl, ba)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[i]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, at))
        at, key = 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            new, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + new]
            count, at = read_varint(raw, at + new)
            yield key, np.frombuffer(raw, "<u4", count, at)
            at += 4 * count

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        key = key_of(doc_id)
        bits = 8 * len(self.bloom)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for (p,) in bloom_places(mark(key), bits, self.hashes)):
            return []
        i = max(0, bisect.bisect_left(self.index, (key,)) - 1)
        out = []
        while i < len(self.index) and self.index[i][0] <= key:
            out += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return out


class Encoder:
    """Encodes texts piece by piece, each distinct piece once.

    The tokenizer drops ASCII white space and never joins across it, nor across the border between ASCII letters or
    digits and other ASCII signs, but for the apostrophe of a contraction; so a text's ids are its pieces' ids in
    turn. It lowers letters itself. Texts with the sign of a special
    token are cut at white space only, and their letters left alone.
    """

    def __init__(self, vocabulary: str, plain: bool = False):
        """plain: the strings of special tokens are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = plain
        self._forget()

    def _forget(self) -> None:
        self.known, self.used = C.HashTable(), 1
        self.first, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.flat = np.full(1 << 14, END_ID, np.uint32)
        self.size[0] = 1  # piece 0 is the end of a document

    def _ids(self, t: C.Tokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them) of some pieces. A piece of the letters a to z is one word to the tokenizer, which its
        model encodes as it stands; the others go through the whole tokenizer, some hundreds at once, and their ids
        are told apart by where they stand."""
        data, starts = t.spelled(which)
        words = data.tobytes().decode().split(" ")[:-1]
        plain = (np.add.reduceat(~_SMALL[data], starts) == 1).tolist()  # the space alone
        tokenize = self.tokenizer.model.tokenize
        ids = [[x.id for x in tokenize(w)] if p else None for w, p in zip(words, plain)]
        other = [i for i, p in enumerate(plain) if not p]
        for k in range(0, len(other), LEARN_WORDS):
            some = other[k : k + LEARN_WORDS]
            at = np.concatenate(([0], np.cumsum([len(words[i]) + 1 for i in some])))
            e = self.tokenizer.encode(" ".join(words[i] for i in some), add_special_tokens=False)
            found, cuts = e.ids, np.searchsorted([o[0] for o in e.offsets], at).tolist()
            for i, x, y in zip(some, cuts, cuts[1:]):
                ids[i] = found[x:y]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int32, len(ids))

    def _learn(self, t: C.Tokens, which: np.ndarray) -> None:
        ids, size = self._ids(t, which)
        a, b = self.known.count + 1, self.known.count + 1 + len(which)
        if b > len(self.first):
            self.first, self.size = (np.concatenate([x[:a], np.zeros(max(b, 2 * a) - a, np.int32)]) for x in (self.first, self.size))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), self.used), np.uint32)])
        self.size[a:b] = size
        self.first[a:b] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(ids)] = ids
        self.known.add(t.hash[which])
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets), an end id after each text."""
        data, offs = C.text_bytes(texts)
        special = b"<|" in data.tobytes()
        t = C.Tokens(data, offs, words=False, fold=not special, cut=None if special else borders(data))
        if self.known.count > CACHE_WORDS or self.used > CACHE_IDS:
            self._forget()
        piece = self.known.find(t.hash)
        new = np.flatnonzero(piece < 0)
        if len(new):
            self._learn(t, new[np.unique(t.hash[new], return_index=True)[1]])
            piece[new] = self.known.find(t.hash[new])
        which = np.insert(piece + 1, t.offs[1:], 0)
        count = self.size[which].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(count)))
        out = self.flat[np.repeat(self.first[which] - ends[:-1], count) + np.arange(ends[-1])]
        return out, ends[t.offs + np.arange(len(t.offs))]


def borders(data: np.ndarray) -> np.ndarray:
    letter, sign = _LETTER[data], _SIGN[data]
    out = np.zeros(len(data), bool)
    out[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder_for(vocabulary: str, plain: bool = False) -> Encoder:
    """A worker keeps its encoder, and the words it knows, from task to task."""
    if (vocabulary, plain) not in _encoders:
        _encoders[vocabulary, plain] = Encoder(vocabulary, plain)
    return _encoders[vocabulary, plain]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the shards into folder, one a partition of the ids' range, and return (shard, documents, tokens), lazily.

    A task that is run again replaces its shard by an equal one.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        shard = f"shard-{TaskContext.get().partitionId():06d}.sst"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with C.new_file(folder, shard) as file:
            out = Writer(file, block_bytes)
            for batch in itertools.chain([first], batches):
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                for a, b in C.chunks(C.text_bytes(texts)[1], CHUNK):
                    ids, offs = encoder.encode(texts.slice(a, b - a))
                    for i in range(b - a):
                        out.add(key_of(keys[a + i]), ids[offs[i] : offs[i + 1]])
            out.finish()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [out.documents], "tokens": [out.tokens]})

    tied = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", tied.alias("tie")).repartitionByRange(C.partitions(spark), "doc_id", "tie")
    return C.map_arrow(ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "text"), run, "shard string, documents long, tokens long")


def read(spark: SparkSession, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards (name, base), from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = spark.createDataFrame([(s, b) for s, b in shards], "shard string, base long").repartition(max(1, len(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns)):
                found = iter(Reader(f"{folder}/{shard}"))
                while some := list(itertools.islice(found, ROWS)):
                    n = np.array([len(ids) for _, ids in some], np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([id_of(k) for k, _ in some], pa.int64()), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(ids) for _, ids in some], pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    base += int(n.sum())

    return C.map_arrow(rows, run, schema)


def encode_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = C.shared_path(spark, "sstable")
    base, shards = 0, []
    for r in sorted(write(docs, folder, vocabulary).collect()):  # one row a shard
        shards.append((r["shard"], base))
        base += r["tokens"]
    return read(spark, folder, shards)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(C.table(spark, sf_dir, "documents"))
