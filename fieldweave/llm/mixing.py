"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words. Whole passes over the source come first; the rest of the budget is fitted by
counting documents of each exact length, taking the same share of every length, and settling what is left by a
bounded-knapsack dynamic program over the lengths. Of each length, the documents that come first in a seeded order
are taken.

What is gathered per source is its histogram of lengths (one row per distinct length), never its documents. The
seeded order within a length is cut by hash buckets that are counted beforehand, so only the one bucket in which the
cut falls is ranked, however many documents share a length.

Defined cases: a null text has size 0; a null source is a source of its own, the last; sources without words have
target 0; an empty table gives no rows; repeated rows are documents of their own (a repeated id in equal rows is
ordered arbitrarily among its equals, which are interchangeable); a text longer than the dynamic program's range is
settled in units of some words; ``mix`` ignores extra columns, ``repeat`` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240607
BUCKETS = 256  # of the seeded order
#: The dynamic program has sums of up to so many units (words, but where a text alone is longer); so many documents of
#: a length, of those that its share gives, are left to it.
RANGE, FREED = 1 << 24, 16
THOUSAND = 1000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.SPACE_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target), given (source, source_size): shares of the whole by weight, none above ``most``
    times its source. Windows run over one row a source. Every target is min(most * size, level * weight); the level
    follows from the sources in the order in which they reach their limit."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", pick.cast("double")).withColumn("limit", F.col("source_size") * float(most))
    up = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - before) / weight_left)
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float, most: int = RANGE) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum as near to the budget as can be found: the
    same share of every length, less some that the knapsack is free to choose anew."""
    whole = int((lengths * counts).sum())
    if budget <= 0 or not whole:
        return np.zeros(len(lengths), np.int64)
    if budget >= whole:
        return np.where(lengths > 0, counts, 0)
    share = np.where(lengths > 0, np.floor(counts * (budget / whole)), 0).astype(np.int64)
    best = share
    for freed in (FREED, whole):  # few of each length first; if that does not meet the budget, as many as can be settled
        take, slack = share.copy(), most // 64
        for i in np.argsort(lengths, kind="stable"):
            k = min(int(take[i]), freed, max(slack // max(1, int(lengths[i])), 1))
            take[i] -= k
            slack = max(0, slack - k * int(lengths[i]))
        left = budget - float((lengths * take).sum())
        free = np.where(lengths > 0, counts - take, 0)
        for i in np.argsort(-lengths, kind="stable"):  # large lengths first, while much is left
            bound = max(most / 64, 2.0 * lengths[free > 0].max(initial=0))
            if left <= bound:
                break
            k = min(int(free[i]), int((left - bound) // max(1, lengths[i])) + 1, int(left // max(1, lengths[i])))
            take[i] += k
            free[i] -= k
            left -= float(k * lengths[i])
        take += knapsack(lengths, free, left, most)
        best = min(best, take, key=lambda t: abs(float((lengths * t).sum()) - budget))
        if abs(float((lengths * best).sum()) - budget) <= 0.5:
            break
    return best


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: float, most: int = RANGE) -> np.ndarray:
    """Bounded knapsack: multiplicities are split in powers of two, reachable sums are a bit set, and each sum keeps
    the first item that reached it, by which the sum nearest to the budget is taken back. Sums of more than ``most``
    words are counted in units of some words; what that leaves is settled in finer ones."""
    take = np.zeros(len(lengths), np.int64)
    some = (counts > 0) & (lengths > 0)
    if budget <= 0 or not some.any():
        return take
    top = int(budget) + int(lengths[some].max()) + 1
    unit = -(-top // most)
    sizes, goal, top = (lengths + unit // 2) // unit, budget / unit, top // unit + 1
    mask, reached = (1 << (top + 1)) - 1, 1
    items: list[tuple[int, int]] = []
    first = np.full(top + 8, -1, np.int32)
    for i in np.argsort(lengths, kind="stable"):
        size, free, step = int(sizes[i]), int(counts[i]) if some[i] else 0, 1
        while free and size and size * min(step, free) <= top:
            step = min(step, free)
            new = (reached | reached << (size * step)) & mask
            if fresh := new ^ reached:
                low = ((fresh & -fresh).bit_length() - 1) // 8
                bits = np.unpackbits(np.frombuffer((fresh >> 8 * low).to_bytes((top + 8) // 8 - low, "little"), np.uint8), bitorder="little")
                first[8 * low : 8 * low + len(bits)][bits.astype(bool)[: len(first) - 8 * low]] = len(items)
                items.append((int(i), step))
                reached = new
            free -= step
            step *= 2
        if goal == int(goal) and reached >> int(goal) & 1:  # no sum is nearer
            break
    low = (reached & ((1 << (int(goal) + 1)) - 1)).bit_length() - 1
    above = reached >> (int(goal) + 1)
    high = int(goal) + 1 + ((above & -above).bit_length() - 1) if above else None
    at = high if high is not None and high - goal < goal - low else low
    while at:
        i, step = items[first[at]]
        take[i] += step
        at -= int(sizes[i]) * step
    left = budget - float((lengths * take).sum())
    if unit > 1 and 0 < left < budget / 2:
        take += knapsack(lengths, np.where(lengths <= 2 * left, counts - take, 0), left, most)
    return take


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, times) of every document; taken is its words times its repeats."""
    spark = docs.sparkSession
    C.prepare(spark)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), order.alias("h"), *extra)
    rows = C.materialise(rows.withColumn("bucket", F.shiftrightunsigned("h", 56).cast("int")), "sizes")
    # a null source joins as itself through a marked key
    rows = rows.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))
    hist = rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    goal = C.materialise(goal.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))), "targets")
    packed = hist.groupBy("key").agg(F.collect_list(F.struct("size", "n")).alias("hist"))
    fitted = packed.join(goal.drop("source"), "key").select("key", "source_size", "target", "hist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pairs = sorted((h["size"], h["n"]) for h in r["hist"])
                lengths, counts = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
                passes = int(r["target"] // r["source_size"]) if r["source_size"] else 0
                extra = fit(lengths, counts, r["target"] - passes * r["source_size"])
                n = len(pairs)
                yield pa.RecordBatch.from_pydict({
                    "key": [r["key"]] * n, "source_size": [r["source_size"]] * n, "target": [r["target"]] * n,
                    "size": lengths, "passes": np.full(n, passes), "extra": extra, "n": counts,
                })

    plan = C.materialise(C.map_arrow(fitted, run, "key string, source_size long, target double, size long, passes long, extra long, n long"), "plan")
    # lengths of which some but not all documents get one more pass: find the bucket of the cut from counts
    part = plan.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select("key", "size", "extra")
    by_bucket = rows.join(part, ["key", "size"]).groupBy("key", "size", "extra", "bucket").agg(F.count("*").alias("m"))
    packed = by_bucket.groupBy("key", "size", "extra").agg(F.sort_array(F.collect_list(F.struct("bucket", "m"))).alias("b"))
    upto = F.aggregate("b", F.struct(F.lit(-1).alias("cut"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("done")), lambda a, x: F.when(
        a["done"], a).when(a["before"] + x["m"] >= F.col("extra"), F.struct(x["bucket"].alias("cut"), a["before"].alias("before"), F.lit(True).alias("done"))).otherwise(
        F.struct(x["bucket"].alias("cut"), (a["before"] + x["m"]).alias("before"), F.lit(False).alias("done"))))
    cuts = packed.select("key", "size", upto.alias("u")).select("key", "size", F.col("u.cut").alias("cut"), F.col("u.before").alias("before"))
    cuts = C.materialise(plan.join(cuts, ["key", "size"], "left").withColumn("cut", F.coalesce("cut", F.when(F.col("extra") > 0, BUCKETS).otherwise(-1))), "cuts")
    joined = C.materialise(rows.join(cuts, ["key", "size"]), "joined")  # a hot length is split here, as nothing above needs it whole
    sure = joined.filter(F.col("bucket") != F.col("cut")).withColumn("more", (F.col("bucket") < F.col("cut")).cast("long"))
    rank = F.row_number().over(Window.partitionBy("key", "size").orderBy("h", "doc_id"))
    edge = joined.filter(F.col("bucket") == F.col("cut")).withColumn("more", (rank <= F.col("extra") - F.col("before")).cast("long"))
    both = sure.unionByName(edge)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"), (F.col("passes") + F.col("more")).alias("times"), *extra)


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The documents, each row as often as the mix takes it. The number of repeats is a function of the source and
    length's plan and the row's place in the seeded order, so only the narrow table of repeats meets the texts. Rows
    without a word cost no budget and are taken as often as their source's whole passes, and once more if the plan has it.
    Equal rows are one row that has the sum of their repeats; columns pass through whatever their names."""
    kept = docs.select(C.packed(docs), "doc_id", "source", "text").withColumn("rid", F.xxhash64("row"))
    times = mix(kept.select("doc_id", "source", "text", "rid"), weights, most, seed, extra=("rid",)).filter("times > 0")
    times = C.materialise(times.groupBy("rid").agg(F.sum("times").alias("times"), F.count("*").alias("rows")), "repeats")
    rows = kept.select("rid", "row")
    if not times.filter("rows > 1").isEmpty():
        rows = rows.dropDuplicates(["rid"])
    out = rows.join(times.select("rid", "times"), "rid")
    # by thousands, as equal rows may be any number
    out = out.select("row", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / THOUSAND))).alias("k"))
    some = F.least(F.lit(THOUSAND).cast("long"), F.col("times") - F.col("k") * THOUSAND).cast("int")
    return out.select("row", F.explode(F.sequence(F.lit(1), some)).alias("k")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
