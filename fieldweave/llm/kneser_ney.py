"""Language-model scoring with an interpolated modified Kneser-Ney n-gram model, of order ``ORDER`` or any from 2 on.

Counting begins with the words. A shard of words (a range of their hashes) numbers its own by how frequent they are, and
a word's number is its place there times the number of shards plus the shard: frequent words have small numbers, which
pack well, without a sort of all. Then it goes down the orders. Each task counts its longest n-grams, by numbers, and
deals them out, packed, by ranges of the hash of their context (their words but the last). A shard's task merges them, writes them as one sorted hash array with
counts into the shared folder, and their contexts as another with, of the n-grams that each begins, the sum of the
counts and how many are 1, 2, and 3 or more; it deals out the n-grams without their first word, whose counts are the
numbers of different words before them. Word pairs are dealt by ranges of their own hash, so that a frequent word is no
hot key; the sums over a word's pairs are dealt out once more, by the word.

A sorted hash array keeps 32 bits of each hash behind an index of its first bits, chosen so that a bucket holds some
``BUCKET`` hashes; so whatever the size, an unknown n-gram is taken for a known one about once in ``2**32 / BUCKET``
look-ups. Numbers are kept in one byte where they are small, or frequent combinations of such. Workers memory-map the
arrays (where the shared folder is not a mounted one they read a shard, use it and drop it). With c the counts of an
order (tokens for the highest, else different words before) and D(1), D(2), D(3+) its discounts from the counts of
counts (Chen and Goodman 1998), h a context and h' the same without its first word:

    p(w | h) = (c(hw) - D(c(hw))) / c(h.) + g(h) p(w | h'),     g(h) = (D1 n1(h) + D2 n2(h) + D3 n3(h)) / c(h.)
    p(w)     = (c(w) - D(c(w))) / c(.) + g0 / (V + 1),          V the known words

and p(w | h) = p(w | h') for contexts never seen. Texts begin with order - 1 start marks, which are no words, and end
with an end token.

Defined cases: a null text is the empty text, and its score that of the end token; very long texts are counted and
scored whole; an empty training set gives the uniform distribution over the end token and the unknown word (score and
base score 0 for N = V = 0); a null id counts as the empty text in the split; repeated rows count and are scored each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Hashes of the start mark, of which no token is counted, and of the end; the number of every unknown word.
START, END, UNKNOWN = np.uint64(1), np.uint64(2), 1 << 62
FOLDS, HELD_OUT = 7, 2
ORDER = 3
#: What a word's row holds besides its tokens: different words before it, and of the pairs it begins: their sum, and
#: how many were counted once, twice, and three times or more.
STATS = ("before", "begun", "once", "twice", "more")
#: n-grams that a task holds before it deals them out; hashes a bucket; characters of text a shard, from which the
#: number of shards follows (but at least the session's partitions).
HELD, BUCKET, SHARD_CHARS = 2_000_000, 8, 1 << 26
TOP = (1 << 63) - 1


def joined(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix(v * np.uint64(0x9DDFEA08EB382D69) + w)


def chained(words: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of words, by numbers; a single word's is its number."""
    out = words[0].astype(np.uint64)
    for w in words[1:]:
        out = joined(out, w.astype(np.uint64))
    return out


def placed(h: np.ndarray) -> np.ndarray:
    """A hash's place in a sorted array: shards are ranges of the hash, places are spread over all 64 bits."""
    with np.errstate(over="ignore"):
        return C.mix(h + np.uint64(0x632BE59BD9B4E019))


def streams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, hashes of their words and, after each text, of the end, offsets) of successive runs of texts."""
    for a, b, t in C.tokens(texts, words=False):
        yield b - a, np.insert(t.hash, t.offs[1:], END), t.offs + np.arange(b - a + 1)


def grams_of(words: np.ndarray, offs: np.ndarray, start: int, order: int) -> list[np.ndarray]:
    """The order - 1 words before each word of some texts, and the word itself, by numbers."""
    at = np.arange(len(words)) - np.repeat(offs[:-1], np.diff(offs))
    out = [words]
    for k in range(1, order):
        v = np.full_like(words, start)
        v[k:] = np.where(at[k:] >= k, words[:-k], start)
        out.insert(0, v)
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def pack(cols: list[np.ndarray]) -> bytes:
    """Hashes plain; other numbers in the fewest of 1, 2, 4 or 8 bytes that hold all but a few, those apart, all first
    bytes before all second ones."""
    out = [np.array([len(cols[0]), len(cols)], "<u8").tobytes()]
    for c in cols:
        if c.dtype == np.uint64:
            out += [b"k", np.array([len(c)], "<u8").tobytes(), c.tobytes()]
        else:
            width = next(w for w in (1, 2, 4, 8) if w == 8 or np.count_nonzero(c >= (1 << 8 * w) - 1) * 8 <= len(c) * w / 2)
            most = (1 << 8 * width) - 1 if width < 8 else TOP
            big = c[c >= most]
            planes = np.minimum(c, most).astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
            out += [str(width).encode(), np.array([len(c), len(big)], "<u8").tobytes(), planes.tobytes(), big.astype("<i8").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    k, at, out = int(np.frombuffer(raw, "<u8", 1, 8)[0]), 16, []
    for _ in range(k):
        kind, at = raw[at : at + 1], at + 1
        (n,) = (int(x) for x in np.frombuffer(raw, "<u8", 1, at))
        if kind == b"k":
            out.append(np.frombuffer(raw, "<u8", n, at + 8))
            at += 8 + 8 * n
        else:
            width = int(kind)
            big = int(np.frombuffer(raw, "<u8", 1, at + 8)[0])
            at += 16
            planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
            c = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)
            if big:
                c[c == ((1 << 8 * width) - 1 if width < 8 else TOP)] = np.frombuffer(raw, "<i8", big, at + width * n)
            at += width * n + 8 * big
            out.append(c)
    return out


def pack_grams(words: list[np.ndarray], c: np.ndarray) -> bytes:
    """n-grams in the order of their first word, which is told by steps."""
    order = np.argsort(words[0], kind="stable")
    return pack([np.diff(words[0][order], prepend=0), *(w[order] for w in words[1:]), c[order]])


def unpack_grams(raw: bytes) -> list[np.ndarray]:
    first, *rest = unpack(raw)
    return [np.cumsum(first), *rest]


def merged(key: np.ndarray, cols: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, their columns (equal for equal keys) and the sums of their numbers."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at], [c[order[at]] for c in cols], [np.add.reduceat(x[order], at) if len(at) else x for x in sums]


def dealt(which: np.ndarray, shards: int, packed) -> tuple[list[int], list[bytes]]:
    """(shards, one pack a shard) of rows, given their shards; packed: packs the rows of some places."""
    which = which.astype(np.int64)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(shards + 1))
    full = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
    return full, [packed(order[cuts[s] : cuts[s + 1]]) for s in full]


def deal_key(words: list[np.ndarray]) -> np.ndarray:
    """By what n-grams are dealt out: their context, pairs by themselves."""
    return chained(words if len(words) == 2 else words[:-1])


OUT = "shard int, kind string, packed binary, meta string"


def told(kind: str, shards: list[int], packs: list[bytes]) -> pa.RecordBatch:
    n = len(shards)
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([kind] * n, pa.string()), pa.array(packs, pa.binary()), pa.array([None] * n, pa.string())], ["shard", "kind", "packed", "meta"])


def noted(meta: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(["meta"]), pa.array([None], pa.binary()), pa.array([json.dumps(meta)])], ["shard", "kind", "packed", "meta"])


def counts_of(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


# ---------------------------------------------------------------- sorted hash arrays


def coded(cols: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of numbers as one byte: the place of a frequent row in a list, or 255 and the row itself apart."""
    key = chained([c.astype(np.uint64) for c in cols])
    u, first, n = np.unique(key, return_index=True, return_counts=True)
    best = np.sort(np.argsort(-n, kind="stable")[:255])
    rows = first[best]
    code = np.minimum(np.searchsorted(u[best], key), max(0, len(best) - 1))
    hit = np.all([c == c[rows[code]] for c in cols], axis=0) if len(key) else np.zeros(0, bool)
    code = np.where(hit, code, 255).astype(np.uint8)
    rest = np.flatnonzero(~hit)
    out = {"code": code, "rest": rest.astype(np.uint32)}
    for k, c in enumerate(cols):
        wide = "<u4" if c.max(initial=0) < 1 << 32 else "<i8"
        out |= {f"often{k}": c[rows].astype("<i8"), f"rest{k}": c[rest].astype(wide)}
    return out


def decoded(a: dict[str, np.ndarray], at: np.ndarray, columns: int) -> list[np.ndarray]:
    code = a["code"][at]
    odd = np.flatnonzero(code == 255)
    place = np.searchsorted(a["rest"], at[odd])
    out = []
    for k in range(columns):
        often = a[f"often{k}"]
        x = often[np.minimum(code, max(0, len(often) - 1))].astype(np.int64) if len(often) else np.zeros(len(at), np.int64)
        x[odd] = a[f"rest{k}"][place]
        out.append(x)
    return out


def store(folder: str, name: str, place: np.ndarray, values: dict[str, np.ndarray]) -> None:
    """A sorted hash array, given its places in order, with what ``coded`` or else makes of its numbers."""
    bits = max(0, int(len(place) // BUCKET).bit_length())
    index = np.searchsorted(place >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(place)])
    C.store_arrays(folder, name, {"bits": np.array([bits], np.int64), "index": index.astype(np.uint32), "hash": (place >> np.uint64(32 - bits)).astype(np.uint32), **values})


def search(a: dict[str, np.ndarray], place: np.ndarray) -> np.ndarray:
    """The rows of some places, -1 for the unknown: binary search within their buckets, of all at once."""
    bits, hashes = int(a["bits"][0]), a["hash"]
    bucket = (place >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(place), np.int64)
    want = (place >> np.uint64(32 - bits)).astype(np.uint32)
    low, high = a["index"][bucket].astype(np.int64), a["index"][bucket + 1].astype(np.int64)
    end = high.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (low < high) & (hashes[np.minimum(mid, len(hashes) - 1)] < want)
        low, high = np.where(less, mid + 1, low), np.where(less, high, np.maximum(mid, low))
    at = np.minimum(low, len(hashes) - 1)
    return np.where((low < end) & (hashes[at] == want), at, -1)


class Model:
    """Reads a model's folder."""

    def __init__(self, folder: str, shards: int, meta: dict):
        self.folder, self.shards, self.meta = folder, shards, meta
        self.maps: dict[str, dict[str, np.ndarray]] = {}

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.maps:
            arrays, mapped = C.load_arrays(f"{self.folder}/{name}")
            if not mapped:
                return arrays
            self.maps[name] = arrays
        return self.maps[name]

    def find(self, kind: str, h: np.ndarray, dealt_by: np.ndarray, columns: int) -> list[np.ndarray]:
        """The numbers of hashes, 0 where one is unknown."""
        place, first, back = np.unique(placed(h), return_index=True, return_inverse=True)
        out = [np.zeros(len(place), np.int64) for _ in range(columns)]
        for s, some in self.by_shard(shard_of(dealt_by[first], self.shards), kind):
            a = self.arrays(f"{kind}-{s:06d}")
            at = search(a, place[some])
            hit = at >= 0
            for o, x in zip(out, decoded(a, at[hit], columns)):
                o[some[hit]] = x
        return [o[back] for o in out]

    def by_shard(self, which: np.ndarray, kind: str) -> Iterator[tuple[int, np.ndarray]]:
        which = which.astype(np.int64)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(self.shards + 1))
        for s in self.meta["stored"][kind]:
            if cuts[s] < cuts[s + 1]:
                yield s, order[cuts[s] : cuts[s + 1]]

    def words(self, h: np.ndarray, told: bool = True) -> list[np.ndarray]:
        """The numbers of words, UNKNOWN for others; told: and their tokens and STATS."""
        u, back = np.unique(h, return_inverse=True)
        place = placed(u)
        out = [np.full(len(u), UNKNOWN), *(np.zeros(len(u), np.int64) for _ in range(1 + len(STATS) if told else 0))]
        for s, some in self.by_shard(shard_of(u, self.shards), "words"):
            a = self.arrays(f"words-{s:06d}")
            at = search(a, place[some])
            some, rank = some[at >= 0], a["rank"][at[at >= 0]].astype(np.int64)
            out[0][some] = rank * self.shards + s
            if told:
                out[1][some] = a["tokens"][rank]
                if s in self.meta["told"]:
                    b = self.arrays(f"stats-{s:06d}")
                    have = rank < len(b["code"])
                    for o, x in zip(out[2:], decoded(b, rank[have], len(STATS))):
                        o[some[have]] = x
        return [o[back] for o in out]


def discounts(n: list[int]) -> list[float]:
    """D(0..3+) from the counts of counts 1 to 4; where these are too few or too odd to tell, the plain 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    if min(n) > 0:
        y = n1 / (n1 + 2 * n2)
        out = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if min(out[1:]) > 0:
            return out
    return [0.0, 0.5, 1.0, 1.5]


# ---------------------------------------------------------------- counting


def by_shard(batches: Iterator[pa.RecordBatch], read, done) -> Iterator[pa.RecordBatch]:
    """Feeds the packs of each shard, which follow one another, to ``done`` together."""
    shard, rows = None, []
    for batch in batches:
        for s, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if s != shard and rows:
                yield from done(shard, [np.concatenate(x) for x in zip(*rows)])
                rows = []
            shard = s
            rows.append(read(raw.as_buffer().to_pybytes()))
    if rows:
        yield from done(shard, [np.concatenate(x) for x in zip(*rows)])


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count the texts of docs and store the model in the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    C.prepare(spark)
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = max(C.partitions(spark), -(-chars // SHARD_CHARS))
    folder = C.shared_path(spark, "lm")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held))
            h, _, (n,) = merged(h, [], [n])
            return told("tokens", *dealt(shard_of(h, shards), shards, lambda at: pack([h[at], n[at]])))

        for batch in batches:
            for _, w, _ in streams(batch.column("text")):
                u, n = np.unique(w, return_counts=True)
                held.append((np.append(u, START), np.append(n, 0)))
                if sum(len(x[0]) for x in held) > HELD:  # bounded memory: a task may deal out more than once
                    yield out()
                    held = []
        if held:
            yield out()

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h, n = cols
            place, _, (n,) = merged(placed(h), [], [n])
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(n), np.uint32)
            rank[order] = np.arange(len(n), dtype=np.uint32)
            store(folder, f"words-{shard:06d}", place, {"rank": rank, "tokens": n[order].astype("<u4" if n.max() < 1 << 32 else "<i8")})
            yield noted({"k": 0, "shard": shard, "tokens": int(n.sum()), "known": int((n > 0).sum())})

        yield from by_shard(batches, unpack, done)

    def longest(model: Model):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Model(folder, shards, model.meta)
            held: list[list[np.ndarray]] = []

            def out() -> pa.RecordBatch:
                *words, c = (np.concatenate(x) for x in zip(*held))
                _, words, (c,) = merged(chained(words), words, [c])
                return told("grams", *dealt(shard_of(deal_key(words), shards), shards, lambda at: pack_grams([w[at] for w in words], c[at])))

            for batch in batches:
                for _, w, offs in streams(batch.column("text")):
                    (number,) = m.words(np.append(w, START), False)
                    grams = grams_of(number[:-1], offs, number[-1], order)
                    _, i, c = np.unique(chained(grams), return_index=True, return_counts=True)
                    held.append([*(g[i] for g in grams), c])
                    if sum(len(x[-1]) for x in held) > HELD:
                        yield out()
                        held = []
            if held:
                yield out()

        return count

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-grams of three words or more."""
        def done(shard: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            *words, c = cols
            k = len(words)
            place, words, (c,) = merged(placed(chained(words)), words, [c])
            store(folder, f"grams{k}-{shard:06d}", place, coded([c]))
            one = np.ones(len(c), np.int64)
            at, _, sums = merged(placed(chained(words[:-1])), [], [c, (c == 1) * one, (c == 2) * one, (c > 2) * one])
            store(folder, f"contexts{k}-{shard:06d}", at, coded(sums))
            short = words[1:]
            _, short, (n,) = merged(chained(short), short, [one])
            yield told("grams", *dealt(shard_of(deal_key(short), shards), shards, lambda at: pack_grams([w[at] for w in short], n[at])))
            yield noted({"k": k, "shard": shard, "of": counts_of(c)})

        yield from by_shard(batches, unpack_grams, done)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            v, w, c = cols
            place, (v, w), (c,) = merged(placed(chained([v, w])), [v, w], [c])
            store(folder, f"grams2-{shard:06d}", place, coded([c]))
            one, zero = np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
            begun = [zero, c, (c == 1) * one, (c == 2) * one, (c > 2) * one]
            number, _, sums = merged(np.concatenate([v, w]), [], [np.concatenate(x) for x in zip(begun, [one, zero, zero, zero, zero])])
            yield told("words", *dealt(number % shards, shards, lambda at: pack([np.diff(number[at] // shards, prepend=0), *(x[at] for x in sums)])))
            yield noted({"k": 2, "shard": shard, "of": counts_of(c)})

        yield from by_shard(batches, unpack_grams, done)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rank, _, sums = merged(cols[0], [], cols[1:])
            every = [np.zeros(int(rank[-1]) + 1, np.int64) for _ in sums]
            for a, x in zip(every, sums):
                a[rank] = x
            C.store_arrays(folder, f"stats-{shard:06d}", coded(every))
            yield noted({"k": 1, "shard": shard, "of": counts_of(every[0]), "before": int(every[0].sum()), "more": int((every[0] > 2).sum())})

        yield from by_shard(batches, unpack_grams, done)

    def shuffled(rows: DataFrame) -> DataFrame:
        return rows.select("shard", "packed").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")

    def notes_of(rows: DataFrame) -> list[dict]:
        return [json.loads(r["meta"]) for r in rows.filter("kind = 'meta'").select("meta").collect()]  # one row a shard

    texts = docs.select("text")
    # what a finished step has shuffled is not read again, and would stand beside all that follows
    was = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        notes = notes_of(C.map_arrow(shuffled(C.map_arrow(texts, tokens, OUT)), vocabulary, OUT))
        meta = {"stored": {"words": sorted(m["shard"] for m in notes)}, "told": set()}
        rows, step = C.map_arrow(texts, longest(Model(folder, shards, meta)), OUT), None
        for k in range(order, 1, -1):
            last, step = step, C.materialise(C.map_arrow(shuffled(rows), longer if k > 2 else pairs, OUT), f"lm-{k}")
            if last is not None:
                C.remove(last)
            notes += notes_of(step)
            rows = step.filter(F.col("kind") == ("grams" if k > 2 else "words"))
        notes += notes_of(C.map_arrow(shuffled(rows), words, OUT))
        C.remove(step)
    finally:
        spark.conf.set(CLEAN_UP, was)

    def total(k: int, what: str):
        found = [m[what] for m in notes if m["k"] == k]
        return [sum(x) for x in zip([0] * 4, *found)] if what == "of" else sum(found)

    shards_of = {k: sorted(m["shard"] for m in notes if m["k"] == k) for k in range(order + 1)}
    meta |= {
        "order": order, "tokens": total(0, "tokens"), "known": total(0, "known"), "before": total(1, "before"), "told": set(shards_of[1]),
        "low": [*total(1, "of")[:2], total(1, "more")], "D": {k: discounts(total(k, "of")) for k in range(1, order + 1)},
    }
    meta["stored"] |= {f"grams{k}": shards_of[k] for k in range(2, order + 1)} | {f"contexts{k}": shards_of[k] for k in range(3, order + 1)}
    return Model(folder, shards, meta)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def log_probabilities(model: Model, hashes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 p(w | h), tokens of w in training) of each word of some texts, whose ends are words."""
    m = model.meta
    number, tokens, *stats = model.words(np.append(hashes, START))
    before, begun, once, twice, more = stats
    grams = grams_of(number[:-1], offs, number[-1], m["order"])
    # of the word before each word, the start mark's at the beginning of a text
    back = grams_of(np.arange(len(hashes)), offs, len(hashes), 2)[0]

    def share(c: np.ndarray, d: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1)

    def left(d: np.ndarray, total: np.ndarray, kinds: list[np.ndarray]) -> np.ndarray:
        return np.where(total > 0, sum(x * y for x, y in zip(d[1:], kinds)) / np.maximum(total, 1), 1.0)

    e = np.array(m["D"][1])
    g0 = float(np.dot(e[1:], m["low"])) / m["before"] if m["before"] else 1.0
    p = share(before[:-1], e, np.array(m["before"])) + g0 / (m["known"] + 1)
    d, pair = np.array(m["D"][2]), chained(grams[-2:])
    (c,) = model.find("grams2", pair, pair, 1)
    p = share(c, d, begun[back]) + left(d, begun[back], [once[back], twice[back], more[back]]) * p
    for k in range(3, m["order"] + 1):
        d, h = np.array(m["D"][k]), chained(grams[-k:-1])
        total, *kinds = model.find(f"contexts{k}", h, h, 4)
        (c,) = model.find(f"grams{k}", joined(h, grams[-1].astype(np.uint64)), h, 1)
        p = share(c, d, total) + left(d, total, kinds) * p
    return np.log10(p), tokens[:-1]


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text."""
    C.prepare(docs.sparkSession)
    folder, shards, meta = model.folder, model.shards, model.meta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(folder, shards, meta)
        low = math.log10(meta["tokens"] + meta["known"] + 1)
        for batch in batches:
            done = 0
            for n, hashes, offs in streams(batch.column("text")):
                p, tokens = log_probabilities(m, hashes, offs)
                sums = [np.add.reduceat(x, offs[:-1]) for x in ((tokens > 0).astype(np.int64), np.log10(tokens + 1.0) - low, p)]
                count = np.diff(offs)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(done, n), batch.column("held_out").slice(done, n), pa.array(count, pa.int64()), pa.array(sums[0], pa.int64()),
                    pa.array(np.full(n, meta["tokens"]), pa.int64()), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64()), pa.array(10 ** (-sums[2] / count), pa.float64()),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
                done += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return C.map_arrow(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    scored = score(docs, train(docs.filter(~held_out)), held_out)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '{C.SPACE_PATTERN}')"


def _discounts(name: str, source: str) -> str:
    parts = ", ".join(f"CAST(count(*) FILTER (WHERE c = {k}) AS DOUBLE) AS n{k}" for k in (1, 2, 3, 4))
    y = "n1 / (n1 + 2 * n2)"
    raw = [f"1 - 2 * {y} * n2 / n1", f"2 - 3 * {y} * n3 / n2", f"3 - 4 * {y} * n4 / n3"]
    usable = "coalesce(least(n1, n2, n3, n4) > 0 AND " + " AND ".join(f"{x} > 0" for x in raw) + ", false)"
    picked = ", ".join(f"CASE WHEN {usable} THEN {x} ELSE {plain} END AS d{k}" for k, x, plain in zip((1, 2, 3), raw, (0.5, 1.0, 1.5)))
    return f"""{name}n AS (SELECT {parts} FROM {source}),
     {name} AS (SELECT {picked} FROM {name}n)"""


def _discount(c: str, of: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 0 WHEN {c} = 1 THEN {of}.d1 WHEN {c} = 2 THEN {of}.d2 ELSE {of}.d3 END"


#: The crc32 of an id's digits modulo 7, by bytes: SQL has none, so it is folded bit by bit.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
       lambda h, b: list_reduce(list_prepend(xor(h, b), [CAST(k AS BIGINT) for k in range(8)]), lambda x, k: xor(x // 2, (x % 2) * 3988292384)))"""


def lm_sql(order: int = ORDER) -> str:
    """The scores as SQL: of each order k the grams g{k}, the contexts h{k} and the discounts d{k}."""
    words = [f"w{i}" for i in range(order)]  # w{order - 1} is the word, the others are before it
    last = words[-1]
    marks = ", ".join(["' start'"] * (order - 1))
    padded = f"list_concat([{marks}], w, [' end'])"
    rows = ", ".join(f"list_extract(x, i + {k}) AS {w}" for k, w in enumerate(words))
    parts = []
    for k in range(order, 0, -1):
        own = ", ".join(words[-k:])
        source = "t WHERE NOT held_out" if k == order else f"g{k + 1}"
        parts.append(f"g{k} AS (SELECT {own}, count(*) AS c FROM {source} GROUP BY {own})")
        parts.append(_discounts(f"d{k}", f"g{k}"))
        if k > 1:
            h = ", ".join(words[-k:-1])
            many = " + ".join(f"count(*) FILTER (WHERE c {which}) * any_value(d{k}.d{j})" for j, which in ((1, "= 1"), (2, "= 2"), (3, "> 2")))
            parts.append(f"h{k} AS (SELECT {h}, CAST(sum(c) AS DOUBLE) AS s, ({many}) / sum(c) AS g FROM g{k}, d{k} GROUP BY {h})")
    p = f"coalesce((greatest(g1.c - ({_discount('g1.c', 'd1')}), 0)) / g0.u, 0) + g0.g / (tot.v + 1)"
    joins = [f"LEFT JOIN g1 ON g1.{last} = t.{last}"]
    for k in range(2, order + 1):
        c = f"coalesce(g{k}.c, 0)"
        p = f"CASE WHEN h{k}.s IS NULL THEN {p} ELSE greatest({c} - ({_discount(c, f'd{k}')}), 0) / h{k}.s + h{k}.g * ({p}) END"
        joins += [f"LEFT JOIN g{k} ON " + " AND ".join(f"g{k}.{w} = t.{w}" for w in words[-k:]), f"LEFT JOIN h{k} ON " + " AND ".join(f"h{k}.{w} = t.{w}" for w in words[-k:-1])]
    crossed = " ".join(f"CROSS JOIN d{k}" for k in range(1, order + 1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS w, xor(CAST({_CRC} AS BIGINT), 4294967295) % 7 = 2 AS held_out FROM documents),
     x AS (SELECT rid, held_out, {padded} AS x FROM d),
     t AS (SELECT rid, held_out, {rows} FROM (SELECT *, unnest(range(1, len(x) - {order - 2})) AS i FROM x)),
     one AS (SELECT {last}, count(*) AS c FROM t WHERE NOT held_out GROUP BY {last}),
     tot AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM one),
     {", ".join(parts)},
     g0 AS (SELECT sum({_discount('c', 'd1')}) / sum(c) AS g, CAST(sum(c) AS DOUBLE) AS u FROM g1, d1),
     s AS (SELECT t.rid, coalesce(one.c, 0) AS c1, log10((coalesce(one.c, 0) + 1) / CAST(tot.n + tot.v + 1 AS DOUBLE)) AS base, log10({p}) AS p
           FROM t CROSS JOIN tot CROSS JOIN g0 {crossed} LEFT JOIN one ON one.{last} = t.{last} {" ".join(joins)})
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c1 > 0) AS n_known, any_value(tot.n) AS train_tokens,
       round(sum(base), 6) AS base_score, round(sum(p), 6) AS score
FROM d JOIN s USING (rid), tot GROUP BY rid, doc_id, held_out
"""


OP7_SQL = lm_sql()
