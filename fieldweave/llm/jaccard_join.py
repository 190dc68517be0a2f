"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; documents with a Jaccard similarity of 0.8 or more are linked. Copies (equal
word sequences) become one class first. Then sets are split recursively (Christiani and Pagh 2017; Christiani, Pagh
and Sivertsen 2018): at a node of the tree every set picks ``FANOUT`` sampled shingles, shared by sets that pick the
same, and goes to the children of these; nodes of one set end, small nodes are compared by brute force, larger ones
are split again, and nodes still large at the last level are compared in blocks of bounded size. Runs with fresh
samples repeat until the recall at the threshold reaches its target.

Comparisons are exact, on whole sets. A pair met in several nodes counts in the first of them only, so links are
counted without listing pairs: a node gives one row a member (its number of links, weighted by copies, and the
least member of its component), and components are joined across nodes by large and small stars.

Defined cases: texts of one to four words are one shingle of all of them; texts without words are copies of one
another and like nothing else; null texts have no words; a null id is a document too (the class is named by the least
id that is not null); repeated rows are copies; very long texts are compared whole; an empty table gives no rows;
extra columns are ignored by ``join`` and kept by ``dedupe``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99
FANOUT = 2
DEPTH = 3
#: A node of at most so many sets is compared at once; larger ones are split, at the last level into blocks.
SMALL = 48
BLOCK = 768


def survival(similarity: float, depth: int = DEPTH, fanout: int = FANOUT) -> float:
    """The chance that a pair of this similarity shares a path of all levels in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** fanout
    return p


def runs_for(recall: float = RECALL, similarity: float = THRESHOLD) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity))))


def places(depth: int = DEPTH, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(parent, level) of each node place of the tree, -1 for the root's children, level by level."""
    out, before = [], [-1]
    for level in range(depth):
        new = []
        for p in before:
            for _ in range(fanout):
                out.append((p, level))
                new.append(len(out) - 1)
        before = new
    return out


def signatures(docs: DataFrame, runs: int) -> DataFrame:
    """(rid, doc_id, k1, k2, n, paths): a row id, two hashes of the word sequence, shingles, and a node id for each
    place of each run's tree."""
    C.prepare(docs.sparkSession)
    tree = places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in C.tokens(batch.column("text"), most=1 << 19):
                n = b - a
                doc = t.doc()
                pos = (np.arange(len(doc)) - t.offs[:-1][doc]).astype(np.uint64)
                keys = []
                with np.errstate(over="ignore"):
                    for salt in (0x632BE59BD9B4E019, 0xE703_7ED1_A0B4_28DB):
                        k = np.zeros(n, np.uint64)
                        full = np.flatnonzero(np.diff(t.offs))
                        if len(full):
                            k[full] = np.add.reduceat(C.mix(t.hash + pos * np.uint64(salt)), t.offs[:-1][full])
                        keys.append(k.view(np.int64))
                h, owner = C.grams(t, SHINGLE)
                offs = np.searchsorted(owner, np.arange(n + 1))
                full = np.flatnonzero(np.diff(offs))
                paths = np.zeros((n, runs * len(tree)), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(runs):
                        for i, (parent, _) in enumerate(tree):
                            seed = C.mix(np.array([r * 1000 + i + 1], np.uint64))[0]
                            x = (h ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                            x ^= x >> np.uint64(32)
                            x *= np.uint64(0xD6E8FEB86659FD93)
                            col = r * len(tree) + i
                            up = paths[full, r * len(tree) + parent] if parent >= 0 else np.uint64(0)
                            if len(full):
                                least = np.minimum.reduceat(x, offs[:-1][full])
                                paths[full, col] = C.mix(least + C.mix(up + seed))
                yield pa.RecordBatch.from_arrays([
                    batch.column("rid").slice(a, n), batch.column("doc_id").slice(a, n), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()),
                    pa.array(np.diff(offs), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(paths.view(np.int64).ravel()), paths.shape[1]).cast(pa.list_(pa.int64())),
                ], ["rid", "doc_id", "k1", "k2", "n", "paths"])

    return C.map_arrow(with_rid(docs), run, "rid long, doc_id long, k1 long, k2 long, n long, paths array<long>")


def with_rid(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text): rows equal in id and text share their row id."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def leaves(reps: DataFrame, runs: int) -> DataFrame:
    """(node, rid, n): the members of the nodes to compare, equal member sets once. One round a level."""
    tree = places()
    width = len(tree)
    kids = [[i for i, (p, _) in enumerate(tree) if p == q] for q in range(width)]
    roots = [i for i, (p, _) in enumerate(tree) if p < 0]
    first = F.array(*(F.lit(r * width + i) for r in range(runs) for i in roots))
    rows = reps.filter("n > 0").select("rid", F.explode(first).alias("place"), "paths").select("rid", "place", F.get("paths", F.col("place")).alias("node"))
    found = None
    for level in range(DEPTH):
        counts = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("x")).filter("n > 1")
        counts = C.materialise(counts, f"counts{level}")  # apart from the join, so that a hot node's rows can be split there
        met = C.materialise(rows.join(counts, "node"), f"nodes{level}")
        done = met if level == DEPTH - 1 else met.filter(F.col("n") <= SMALL)
        done = done.select("node", "rid", "n", "s", "x")
        found = done if found is None else found.unionByName(done)
        if level == DEPTH - 1:
            break
        down = F.array(*(F.array(*(F.lit(r * width + k) for k in kids[i])) if kids[i] else F.array().cast("array<int>") for r in range(runs) for i in range(width)))
        large = met.filter(F.col("n") > SMALL).select("rid", F.explode(F.get(down, F.col("place"))).alias("place"))
        rows = large.join(reps.select("rid", "paths"), "rid").select("rid", "place", F.get("paths", F.col("place")).alias("node"))
    once = found.groupBy("n", "s", "x").agg(F.min("node").alias("node")).select("node")
    return found.select("node", "rid", "n").join(once, "node")


def shingles(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b, t in C.tokens(texts):
        h, owner = C.grams(t, SHINGLE)
        offs = np.searchsorted(owner, np.arange(b - a + 1))
        out += [np.unique(h[offs[i] : offs[i + 1]]) for i in range(b - a)]
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets are similar enough, by exact intersections; shingles of one set only are left out, and
    the rest is multiplied in slices."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.concatenate(([True], every[1:] != every[:-1]))
    ident = np.cumsum(fresh) - 1
    times = np.bincount(ident)
    keep = times[ident] > 1
    ident, owner = ident[keep], owner[keep]
    ident = np.cumsum(np.concatenate(([True], ident[1:] != ident[:-1]))) - 1 if len(ident) else ident
    common = np.zeros((n, n), np.float32)
    most = max(256, (1 << 22) // n)
    for lo in range(0, int(ident[-1]) + 1 if len(ident) else 0, most):
        a, b = np.searchsorted(ident, [lo, lo + most])
        m = np.zeros((n, min(most, int(ident[-1]) + 1 - lo)), np.float32)
        m[owner[a:b], ident[a:b] - lo] = 1
        common += m @ m.T
    ok = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(ok, False)
    return ok


def compare(node: int, rows: dict[str, list], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, least similar row id) of each member, over pairs first met in this node."""
    ok = similar(shingles(pa.array(rows["text"], pa.large_string())), threshold)
    if rows["i"][0] != rows["j"][0]:  # two blocks: only pairs across
        block = np.array(rows["b"])
        ok &= block[:, None] != block[None, :]
    rid = np.array(rows["rid"], np.int64)
    label = rid.copy()
    if ok.any():
        while True:
            low = np.minimum(label, np.where(ok, label[None, :], np.iinfo(np.int64).max).min(1))
            if (low == label).all():
                break
            label = low
    earlier = sorted({x for ls in rows["leaves"] for x in ls if x < node})
    if earlier and ok.any():
        at = {x: k for k, x in enumerate(earlier)}
        m = np.zeros((len(rid), len(earlier)), np.float32)
        for r, ls in enumerate(rows["leaves"]):
            m[r, [at[x] for x in ls if x < node]] = 1
        ok &= (m @ m.T) == 0
    return (ok * np.array(rows["copies"], np.int64)[None, :]).sum(1), label


def compare_leaves(docs: DataFrame, reps: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(rid, links, root) of every member of every node."""
    spark = docs.sparkSession
    per = members.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("nodes")).join(reps.select("rid", "copies"), "rid")
    held = with_rid(docs).select("rid", "text").join(per, "rid")
    held = held.select("rid", "text", "copies", F.transform("nodes", lambda x: x["node"]).alias("leaves"), F.explode("nodes").alias("x"))
    blocks = F.ceil(F.col("x.n") / BLOCK).cast("int")
    held = held.select("*", F.pmod(F.xxhash64(F.lit(3), "rid"), blocks).cast("int").alias("b"), blocks.alias("blocks"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    held = held.select(F.col("x.node").alias("node"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rid", "copies", "leaves", "text")
    dealt = held.repartition(C.partitions(spark), "node", "i", "j").sortWithinPartitions("node", "i", "j", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: dict[str, list]) -> pa.RecordBatch | None:
            if len(rows["rid"]) < 2:
                return None
            links, root = compare(rows["node"][0], rows, threshold)
            use = (links > 0) | (root != np.array(rows["rid"]))
            return pa.RecordBatch.from_arrays([pa.array(np.array(rows["rid"])[use], pa.int64()), pa.array(links[use], pa.int64()), pa.array(root[use], pa.int64())], ["rid", "links", "root"])

        group: dict[str, list] = {}
        at = None
        for batch in batches:
            cols = {k: v for k, v in zip(batch.schema.names, (c.to_pylist() for c in batch.columns))}
            for k in range(batch.num_rows):
                key = cols["node"][k], cols["i"][k], cols["j"][k]
                if key != at:
                    if at is not None and (out := told(group)) is not None:
                        yield out
                    at, group = key, {c: [] for c in cols}
                if not (group["rid"] and group["rid"][-1] == cols["rid"][k]):  # repeated rows
                    for c in cols:
                        group[c].append(cols[c][k])
        if at is not None and (out := told(group)) is not None:
            yield out

    return C.map_arrow(dealt, run, "rid long, links long, root long")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(u, v): the least vertex v of the component of every vertex u that is not the least itself, by alternating
    large and small stars (Kiveris et al. 2014)."""
    e = C.materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        both = big.join(least, "u")
        small = both.select("u", F.col("m").alias("v")).unionByName(both.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        last, e = e, C.materialise(small, name)
        C.remove(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e
        seen = now


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(rid, doc_id, class_id, rep_id, n_links, kept): class_id is the least id of the documents linked, directly or
    through others; rep_id the least id of the copies; n_links counts the similar documents, copies included; kept
    marks the row that stays when one document of each class does."""
    runs = runs_for(recall, threshold)
    sig = C.materialise(signatures(docs, runs), "signatures")
    head = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")
    # copies have equal paths; grouping by them as well spares a sort
    reps = sig.groupBy("k1", "k2", "n", "paths").agg(F.min(head).alias("head"), F.count("*").alias("copies"))
    reps = C.materialise(reps.select(F.col("head.rid").alias("rid"), "head", "k1", "k2", "n", "copies", "paths"), "classes")
    members = C.materialise(leaves(reps, runs), "members")
    found = C.materialise(compare_leaves(docs, reps, members, threshold), "found")
    star = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    reps = reps.drop("paths").join(links, "rid", "left").join(star.withColumnRenamed("u", "rid"), "rid", "left").withColumn("root", F.coalesce("v", "rid"))
    reps = C.materialise(reps, "rooted")
    C.remove(members, found, star)
    tops = reps.groupBy("root").agg(F.min("head").alias("top"))
    named = C.materialise(reps.join(tops, "root"), "named").select("k1", "k2", F.col("head.doc_id").alias("rep_id"), "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.select("rid", "doc_id", "k1", "k2").join(named, ["k1", "k2"])
    return out.select("rid", "doc_id", F.col("top.doc_id").alias("class_id"), "rep_id", "n_links", (F.col("rid") == F.col("top.rid")).alias("kept"))


def dedupe(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents, one of each class: that of the least id. Columns pass through whatever their names."""
    kept = C.materialise(join(docs, threshold, recall).filter("kept").select("rid"), "kept")
    out = docs.select(C.packed(docs), F.xxhash64("doc_id", "text").alias("rid")).join(kept.distinct(), "rid", "left_semi")
    if kept.count() > kept.distinct().count():  # rows equal in id and text
        out = out.dropDuplicates(["rid"])
    return out.select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs).select("doc_id", "class_id", "rep_id", "n_links")
