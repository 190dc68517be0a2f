"""Benchmark decontamination by a generalised suffix automaton over the words of normalised test items.

Training words are streamed through the automaton; it tracks the longest match ending at each word. Words
inside an occurrence of an item's window (``window`` consecutive words, or the whole of a shorter item) are hit.
Before the streaming, a vectorised look at the automaton's first two levels (its words and its word pairs) rules
out every stretch that cannot hold a window; what remains is matched by its exact words, so hashes never decide.

Items: blocks of about ``block_words`` words each become one automaton, in a task each, written as flat arrays into
the shared folder; the driver learns only their names. Workers map a block at a time (read it, where the folder is not
mounted) and match every block against all documents.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no window; items of equal
words are separate items with the same windows, also if they share their id; a null item_id counts as the empty string;
repeated document rows each give a row; very long texts are streamed whole; without items nothing is hit; an empty
table gives no rows; columns of ``scan``'s own names are replaced, ``clean`` keeps every column whatever its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 10
BLOCK_WORDS = 200_000
#: ``clean`` cuts hit spans, and drops documents of which more than this share of the words is hit.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_DOWN = bytes(C._LOWER.tolist())


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_DOWN))


class SuffixAutomaton:
    """Builds a generalised suffix automaton over word lists (Blumer et al. 1985), with the items of each window's state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        number: dict[bytes, int] = {}
        self.ids: dict[tuple[int, ...], list[str]] = {}  # items of equal words are met once
        for i, ws in items:
            self.ids.setdefault(tuple(number.setdefault(w, len(number)) for w in ws), []).append(i)
        for ws in self.ids:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.words = list(number)
        self.found: dict[tuple[int, int], set[int]] = {}
        self.sizes: set[int] = set()
        for k, ws in enumerate(self.ids):
            m = min(window, len(ws))
            if m:
                self.sizes.add(m)
                state = 0
                for i, w in enumerate(ws):  # every prefix of an item is a match of its own length
                    state = self.next[state][w]
                    if i + 1 >= m:
                        at = state
                        while self.len[self.link[at]] >= m:
                            at = self.link[at]
                        self.found.setdefault((at, m), set()).add(k)

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = len(self.next)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def arrays(self) -> dict[str, np.ndarray]:
        """The automaton as flat arrays: words and their hashes, known pairs, edges, links, windows and item ids."""
        h = hashes(self.words)
        order = np.argsort(h)
        if (np.diff(h[order].astype(object)) == 0).any():
            raise ValueError("two words of one hash in a block: choose other blocks")
        rank = np.empty(len(h), np.uint64)
        rank[order] = np.arange(len(h), dtype=np.uint64)
        pairs = sorted({p for ws in self.ids for p in zip(ws, ws[1:])})
        a, b = (h[np.array([p[i] for p in pairs], np.int64)] for i in (0, 1))
        edge = np.array([s << 32 | int(rank[w]) for s, d in enumerate(self.next) for w in d], np.uint64)
        to = np.array([t for d in self.next for t in d.values()], np.int32)
        by = np.argsort(edge)
        keys = sorted(self.found)
        spelled = [self.words[i] for i in order]
        ids = [[i.encode() for i in x] for x in self.ids.values()]
        return {
            "hash": h[order], "spelling": np.frombuffer(b"".join(spelled), np.uint8), "spelt": np.cumsum([0, *map(len, spelled)]),
            "pairs": np.sort(pair(a, b)), "edge": edge[by], "to": to[by], "link": np.array(self.link, np.int32), "length": np.array(self.len, np.int32),
            "window": np.array([s << 32 | m for s, m in keys], np.uint64), "found": np.array([k for x in keys for k in sorted(self.found[x])], np.int32), "found_at": np.cumsum([0, *(len(self.found[x]) for x in keys)]),
            "sizes": np.array(sorted(self.sizes), np.int64), "items": np.cumsum([0, *map(len, ids)]), "ids": np.frombuffer(b"".join(i for x in ids for i in x), np.uint8), "id_at": np.cumsum([0, *(len(i) for x in ids for i in x)]),
        }


class Automaton:
    """Streams words through the flat arrays of an automaton, where they lie."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.least = int(self.sizes[0]) if len(self.sizes) else 0
        self.every = self.sizes.tolist()

    def _place(self, keys: np.ndarray, key: int) -> int:
        at = int(np.searchsorted(keys, np.uint64(key)))
        return at if at < len(keys) and int(keys[at]) == key else -1

    def numbers(self, t: C.Tokens, x: int, y: int) -> list[int]:
        """The words' numbers, -1 for the unknown; the bytes decide, not the hash."""
        at = np.minimum(np.searchsorted(self.hash, t.hash[x:y]), max(0, len(self.hash) - 1)).tolist()
        return [k if len(self.hash) and self.spelling[self.spelt[k] : self.spelt[k + 1]].tobytes() == t.word(x + i) else -1 for i, k in enumerate(at)]

    def match(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(first word, end word, place in ``window``) of each occurrence of a window."""
        out = []
        state = length = 0
        for i, w in enumerate(words):
            at = -1 if w < 0 else self._place(self.edge, state << 32 | w)
            while w >= 0 and at < 0 and state:
                state = int(self.link[state])
                length = int(self.length[state])
                at = self._place(self.edge, state << 32 | w)
            if at < 0:
                state = length = 0
                continue
            state, length = int(self.to[at]), length + 1
            for m in self.every:
                if length >= m:
                    s = state
                    while self.length[self.link[s]] >= m:
                        s = int(self.link[s])
                    if (hit := self._place(self.window, s << 32 | m)) >= 0:
                        out.append((i + 1 - m, i + 1, hit))
        return out

    def item_ids(self, windows: set[int]) -> list[str]:
        """The ids of the items that have one of the windows, an item once."""
        items = {int(k) for x in windows for k in self.found[self.found_at[x] : self.found_at[x + 1]]}
        return [self.ids[self.id_at[i] : self.id_at[i + 1]].tobytes().decode() for k in items for i in range(self.items[k], self.items[k + 1])]

    def stretches(self, t: C.Tokens) -> list[tuple[int, int]]:
        """Token ranges that may hold a window: long enough runs of known words whose neighbours are known pairs."""
        if not self.least or not len(t.hash):
            return []
        known = within(t.hash, self.hash)
        if self.least == 1:
            return [(int(i), int(i) + 1) for i in np.flatnonzero(known)] if self.every == [1] else runs(known, t, 1)
        joined = np.zeros(len(known), bool)
        at = np.flatnonzero(known[:-1] & known[1:])
        joined[at] = within(pair(t.hash[at], t.hash[at + 1]), self.pairs)
        inner = t.offs[1:-1]
        joined[inner[(inner > 0) & (inner < len(joined))] - 1] = False
        joined[-1] = False
        return [(a, b + 1) for a, b in flat(joined) if b + 1 - a >= self.least]


def flat(mask: np.ndarray) -> list[tuple[int, int]]:
    d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))


def runs(mask: np.ndarray, t: C.Tokens, least: int) -> list[tuple[int, int]]:
    out = []
    for a, b in flat(mask):
        cuts = [a, *[int(c) for c in t.offs[np.searchsorted(t.offs, a, "right") : np.searchsorted(t.offs, b)]], b]
        out += [(x, y) for x, y in zip(cuts, cuts[1:]) if y - x >= least]
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix(a * np.uint64(3) + b)


def within(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def hashes(ws: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(ws), np.uint8)
    return C.Tokens(data, np.array([0, len(data)])).hash if ws else np.zeros(0, np.uint64)


def build(items: DataFrame, folder: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Write an automaton a block into folder, a task each; their names, one a block. Equal texts share a block."""
    spark = items.sparkSession
    C.prepare(spark)
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null")
    n = rows.agg(F.sum(F.regexp_count("text", F.lit(C.WORD_PATTERN)).cast("long"))).first()[0] or 0
    blocks = max(1, -(-n // block_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(i, words(t)) for batch in batches for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist())]
        if any(ws for _, ws in held):
            name = f"automaton-{TaskContext.get().partitionId():06d}"
            C.store_arrays(folder, name, SuffixAutomaton(held, window).arrays())
            yield pa.RecordBatch.from_pydict({"name": [name]})

    block = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")
    return sorted(r["name"] for r in C.map_arrow(rows.repartitionById(blocks, block), run, "name string").collect())


_mapped: dict[str, Automaton] = {}


def automaton(uri: str) -> Automaton:
    """A mapped block stays open (its pages are the system's to drop); one that had to be read goes after use."""
    if uri not in _mapped:
        arrays, mapped = C.load_arrays(uri)
        if not mapped:
            return Automaton(arrays)
        _mapped[uri] = Automaton(arrays)
    return _mapped[uri]


SPANS = "n_words long, n_hit long, items array<string>, spans array<struct<first:int,end:int,from:int,to:int>>, cut string"


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with n_words, n_hit, items (ids, sorted), spans (word and byte ranges of merged hits) and cut, the
    text without its spans (null where nothing is hit)."""
    spark = docs.sparkSession
    C.prepare(spark)
    folder = C.shared_path(spark, "automata")
    names = build(items, folder, window, block_words)
    added = T._parse_datatype_string(SPANS)
    docs = docs.select([f"`{c}`" for c in docs.columns if c not in added.names])
    arrow = to_arrow(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in arrow]
            texts = batch.column("text")
            for a, b, t in C.tokens(texts):
                marks: dict[int, tuple[list[tuple[int, int]], list[str]]] = {}
                for name in names:
                    sa = automaton(f"{folder}/{name}")
                    hit: dict[int, set[int]] = {}
                    for x, y in sa.stretches(t):
                        row = int(np.searchsorted(t.offs, x, "right")) - 1
                        for f, e, at in sa.match(sa.numbers(t, x, y)):
                            marks.setdefault(row, ([], []))[0].append((x + f - int(t.offs[row]), x + e - int(t.offs[row])))
                            hit.setdefault(row, set()).add(at)
                    for row, windows in hit.items():
                        marks[row][1].extend(sa.item_ids(windows))
                starts = t.offs[:-1]
                base = C.text_bytes(texts.slice(a, b - a))[1]
                for row in range(b - a):
                    cover, who = merged(marks[row][0]) if row in marks else [], marks.get(row, ((), ()))[1]
                    spans = [{"first": f, "end": e, "from": int(t.start[starts[row] + f] - base[row]), "to": int(t.end[starts[row] + e - 1] - base[row])} for f, e in cover]
                    told = int(t.offs[row + 1] - t.offs[row]), sum(e - f for f, e in cover), sorted(who), spans, without(texts[a + row].as_py(), spans) if spans else None
                    for col, v in zip(cols, told):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k.type) for v, k in zip(cols, arrow))], [*batch.schema.names, *added.names])

    return C.map_arrow(docs, run, T.StructType([*docs.schema.fields, *added.fields]))


def to_arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for f, e in sorted(ranges):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([f, e])
    return [(f, e) for f, e in out]


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents without their contaminated spans: every span of hit words (a match of window words or more, or
    the whole of a shorter item) is cut out of the text; documents of which more than max_coverage is hit go.
    Untouched texts stay as they are; n_chars follows the text where it was cut."""
    found = scan(docs.select(C.packed(docs), "text"), items, window)
    found = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") <= F.col("n_words") * max_coverage))
    changed = {"text": F.col("cut"), "n_chars": F.char_length("cut")}
    return found.select(*(
        F.when(F.col("n_hit") > 0, changed[f.name].cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`")).alias(f.name) if f.name in changed else F.col(f"row.`{f.name}`")
        for f in docs.schema.fields))


def without(text: str, spans: list[dict]) -> str:
    raw = text.encode()
    at = [0, *[x for s in spans for x in (s["from"], s["to"])], len(raw)]
    return b"".join(raw[x:y] for x, y in zip(at[::2], at[1::2])).decode()


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     b AS (SELECT row_number() OVER () AS item, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     win AS (SELECT DISTINCT item, item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
             FROM (SELECT item, item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT m FROM win),
     dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
     hit AS (SELECT doc_id, item, item_id, i, dw.m FROM dw JOIN win ON dw.m = win.m AND dw.g = win.g),
     n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
