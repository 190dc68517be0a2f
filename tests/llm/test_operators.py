"""Each operator on awkward tables, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fieldweave.llm import chat, common, decontamination, fingerprints, jaccard_join, kneser_ney, licenses, mixing, sstable, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans(common.UPPER, common.LOWER)
WORD, SPACE = re.compile(common.WORD_PATTERN), re.compile(common.SPACE_PATTERN)


def words(t):
    return WORD.findall((t or "").translate(LOW))


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocabulary)


BASE = prose(1, 120)
ROWS = [
    (5, BASE, "en", "a", 1), (3, BASE, "en", "b", 1), (9, BASE + " tail", "en", "a", 1), (1, None, "en", None, None), (2, "", "en", "a", 0),
    (2, "", "en", "a", 0), (None, "no id here", "en", "é", 3), (7, "one", "en", "b", 3), (8, " \n\t ", "en", "b", 3), (10, prose(2, 5000), "en", "a", 9),
    (11, "Schön! ÀB <|endoftext|> x~1   日本", "de", "c", 4), (12, prose(3, 80), "en", "c", 4), (13, prose(4, 90), "en", "a", 4), (13, prose(5, 30), "en", "a", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def clashing(df, *names):
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names})


# ---------------------------------------------------------------- 1


def test_fingerprints(docs, none):
    rows = sorted(fingerprints.compare(clashing(docs, "bucket", "tie", "fingerprint")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    by = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(rows) == len(by)
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    want = collections.Counter()
    twins = [t for i, t in by if i == 13]
    for k, (i, t) in enumerate(by):
        n = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - n] + by[(k + 1) % len(by)][1][:n]).encode()).hexdigest()] += 1
    alike = [x for x in got if x[0] not in (12, 13)]  # the order of the two rows with id 13 is by hash
    assert all(got[x] == want[x] for x in alike) and len(twins) == 2
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[5] == prints[3] != prints[9] and prints[1] == prints[2] == "0" * len(prints[1])
    at = {r["doc_id"]: r for r in rows}
    assert at[5]["near_edited"] > 0.35 and at[10]["near_next"] < 0.2 and all(0 <= r["near_edited"] <= 1 for r in rows)
    assert fingerprints.compare(none).count() == 0
    one = docs.filter("doc_id = 10")
    assert fingerprints.compare(one).first()["near_next"] == 1.0
    assert fingerprints.fingerprint(clashing(docs, "fingerprint")).filter("doc_id = 5").first()["fingerprint"] == prints[5]


def test_equal_substrings_share_names():
    a, b = prose(7, 400).encode(), prose(8, 50).encode()
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b + a, np.uint8)
    for k in (1, 2):
        n1, _ = fingerprints.level(x, np.array([0, len(x)]), 1)
        n2, _ = fingerprints.level(y, np.array([0, len(y)]), 1)
        if k == 2:
            n1, _ = fingerprints.level(n1, np.array([0, len(n1)]), 2)
            n2, _ = fingerprints.level(n2, np.array([0, len(n2)]), 2)
        shared = len(set(n1.tolist()) & set(n2.tolist()))
        assert shared >= len(set(n1.tolist())) - 12
        assert n1[20:-5].tolist() == n2[-(len(n1) - 20) : -5].tolist()


def test_a_hot_id_is_cut_into_ranges(spark):
    rows = [(7, prose(i, 6)) for i in range(300)] + [(None, prose(1000 + i, 6)) for i in range(300)] + [(i, prose(2000 + i, 6)) for i in range(8, 208)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    per = {(r["doc_id"], r["bucket"]): r["count"] for r in fingerprints.with_next(docs).filter("NOT ghost").groupBy("doc_id", "bucket").count().collect()}
    assert sum(per.values()) == len(rows) and sum(i is None for i, _ in per) > 1 and sum(i == 7 for i, _ in per) > 1
    # the order of equal ids is by hash: every document follows another, and each follows once
    got = fingerprints.compare(docs).collect()
    order = [t for _, t in sorted((((r["doc_id"] is not None, r["doc_id"] or 0, r["h"]), r["text"]) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()))]
    want = collections.Counter()
    for a, b in zip(order, [*order[1:], order[0]]):
        n = len(a) // 4
        want[hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()] += 1
    assert collections.Counter(r["edited_sha256"] for r in got) == want


M64 = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def parsed(sym, salt, raw):
    """One level of the parse, symbol by symbol."""
    runs = []
    for x in sym:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    label = [x for x, _ in runs]
    for _ in range(3 if raw else 4):
        tossed = []
        for i, x in enumerate(label):
            k = ((x ^ label[i - 1]) & -(x ^ label[i - 1])).bit_length() - 1 if i else 0
            tossed.append(2 * k + (x >> k & 1))
        label = tossed
    names, phrase = [], []
    for i, (x, run) in enumerate(runs):
        if i and label[i] > label[i - 1] and i + 1 < len(runs) and label[i] > label[i + 1]:
            names.append(phrase)
            phrase = []
        phrase.append(mixed((x + 1 + (run << (40 if raw else 1)) * (salt * 2 + 1)) & M64))
    power = 0x9E3779B97F4A7C15 | 1
    return [mixed((sum(v * pow(power, i % 4096, 1 << 64) for i, v in enumerate(p)) + salt) & M64) for p in [*names, phrase]] if runs else []


def sketched(text):
    """The whole fingerprint, name by name."""
    least, sym, k = [None] * fingerprints.BINS, list(text.encode()), 0
    while sym:
        k += 1
        sym = parsed(sym, k, k == 1)
        if k >= fingerprints.FIRST_LEVEL:
            for x in sym:
                for copy in range(fingerprints.COPIES if k > fingerprints.FIRST_LEVEL else 1):
                    h = mixed((x + 1000 * k + copy) & M64)
                    b, v = h >> 57, h & (1 << 57) - 1
                    least[b] = v if least[b] is None else min(least[b], v)
            if len(sym) <= 1:
                break
    return "".join(f"{0 if v is None else (mixed(v) & 0xFFFF or 1):04x}" for v in least)


@pytest.mark.parametrize("text", ["", "a", "aa", "ab", "zzzzzzz", "é日本 " * 30, prose(21, 60), prose(22, 900), "ab" * 700, "x" * 5000 + "y"])
def test_fingerprints_equal_brute_force(text):
    assert fingerprints.hexed(fingerprints.sketch_texts([text, prose(3, 40)]))[0] == sketched(text)


def test_a_long_text_is_parsed_to_its_top():
    levels, (sym, at) = 0, common.text_bytes(pa.array([prose(31, 60_000, 5000)]))
    while len(sym) > 1:
        levels += 1
        sym, at = fingerprints.level(sym, at, levels)
    assert levels > 6


def test_likeness_follows_the_shared_part():
    parts = [prose(100 + i, 300, 5000) for i in range(2)]
    mixed = [" ".join([*parts[0].split()[:k], *parts[1].split()[k:]]) for k in (300, 225, 150, 0)]
    s = fingerprints.sketch_texts(mixed)
    like = [float(fingerprints.likeness(s[:1], s[i : i + 1])[0]) for i in range(4)]
    assert like[0] == 1 > like[1] > like[2] > like[3]
    one_by_one = np.concatenate([fingerprints.sketch_texts([m]) for m in mixed])
    assert (one_by_one == s).all()


# ---------------------------------------------------------------- 2


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return held | share
        held |= {s: float(most * sizes[s]) for s in over}


def test_mixing(docs, none):
    rows = mixing.mix(clashing(docs, "bucket", "size", "h", "key")).collect()
    assert len(rows) == len(ROWS) and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=repr)
    sizes = collections.Counter()
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(SPACE.findall(t or ""))
    goal = water(sizes)
    took = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    for source, total in took.items():  # as near as whole passes and any subset of the documents come
        sums = {0}
        for _, t, _, s, _ in ROWS:
            sums |= {x + len(SPACE.findall(t or "")) for x in sums} if s == source else set()
        rest = goal[source] - goal[source] // sizes[source] * sizes[source] if sizes[source] else 0
        assert abs(total - goal[source]) <= min(abs(x - rest) for x in sums) + 1e-6
    assert mixing.mix(none).count() == mixing.repeat(none).count() == 0
    names = ("row", "rid", "times", "k", "size")
    kept = mixing.repeat(clashing(docs, *names)).collect()
    assert kept[0].asDict().keys() == {*docs.columns, *names} and all(r["rid"] == "x" for r in kept)
    assert sum(len(SPACE.findall(r["text"] or "")) for r in kept) == sum(took.values())


def test_equal_rows_share_their_repeats(spark):
    docs = spark.createDataFrame([(1, "a", "one two three")] * 2500 + [(2, "b", prose(1, 100))] * 3 + [(3, "b", "x y")], "doc_id long, source string, text string")
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["times"]
    assert collections.Counter(r["doc_id"] for r in mixing.repeat(docs).collect()) == +want


def test_rows_without_a_word_are_repeated_as_the_mix_has_them(spark):
    kinds = "doc_id long, source string, text string"
    docs = spark.createDataFrame([(i, "ab"[i % 2], prose(i, 30)) for i in range(40)] + [(100, "a", None), (101, "b", ""), (102, "a", " \n")], kinds)
    want = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    got = [r["doc_id"] for r in mixing.repeat(docs).collect()]
    assert {i: got.count(i) for i in want} == want and max(want[i] for i in (100, 101, 102)) > 0


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_as_near_as_any_subset(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 60), 6, replace=False)).astype(np.int64)
    counts = rng.integers(1, 4, 6).astype(np.int64)
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * int(n) for s in sums for k in range(int(c) + 1)}
    for budget in rng.uniform(0, float((lengths * counts).sum()), 10):
        for take in (mixing.knapsack(lengths, counts, budget), mixing.fit(lengths, counts, budget)):
            assert (take >= 0).all() and (take <= counts).all() and abs((take * lengths).sum() - budget) <= min(abs(s - budget) for s in sums) + 1e-6


@pytest.mark.parametrize(("lengths", "counts", "budget", "want"), [
    ([3_000_000], [2], 5_900_000, 6_000_000), ([5, 3_000_000], [10, 4], 11_900_000, 12_000_000), ([5, 3_000_000], [10, 4], 11_400_000, 12_000_000),
    ([5, 3_000_000], [10, 4], 10_400_000, 9_000_050), ([7, 900_000_000], [1000, 3], 1_800_000_700, 1_800_000_700), ([900_000_000], [3], 1_300_000_000, 900_000_000),
])
def test_very_long_texts_come_as_near_as_they_can(lengths, counts, budget, want):
    take = mixing.fit(np.array(lengths), np.array(counts), float(budget))
    assert (take <= counts).all() and (take * lengths).sum() == want


def test_fit_is_exact_on_a_large_histogram():
    rng = np.random.default_rng(2)
    lengths, counts = np.arange(1, 4000), rng.integers(1, 30, 3999)
    for share in (0.1, 0.73):
        budget = float((lengths * counts).sum()) * share
        assert abs((mixing.fit(lengths, counts, budget) * lengths).sum() - budget) <= 0.5


# ---------------------------------------------------------------- 4

ITEMS = [
    (1, " ".join(f"q{i}" for i in range(25))), (2, "Short ITEM here"), (3, "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 z"), (10, None), (11, " ... "),
    (4, " ".join(["rep"] * 14)), (5, "single"), (2, "SHORT item... here"), (None, "Short ITEM here"),
]
LEAKY = [
    (1, "x " + " ".join(f"Q{i}" for i in range(12)) + " y"), (2, "a short, item; HERE b short item"), (3, " ".join(["rep"] * 11)), (4, None), (5, "q0 q1 q2 q3 q4 q5 q6 q7 q8"),
    (6, "mono single " + " ".join(f"q{i}" for i in range(5, 25))), (7, BASE), (7, BASE), (8, "single"), (9, "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 z single"),
]


def hits(text, items, window=10):
    w, hit, who = words(text), set(), []
    for i, t in items:
        got = False
        q = words(t)
        m = min(window, len(q))
        for s in range(len(q) - m + 1) if m else ():
            for k in range(len(w) - m + 1):
                if w[k : k + m] == q[s : s + m]:
                    hit |= set(range(k, k + m))
                    got = True
        who += ["" if i is None else str(i)] * got
    return len(w), len(hit), sorted(who)


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_decontamination(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = clashing(spark.createDataFrame(LEAKY, "doc_id long, text string"), "n_words", "spans", "cut", "extra")
    rows = decontamination.scan(docs, items, block_words=block).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows) == sorted((i, *hits(t, ITEMS)) for i, t in LEAKY)


def test_blocks_that_cannot_be_mapped_are_read(spark, monkeypatch):
    monkeypatch.setattr(common.os.path, "exists", lambda _: False)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    folder = common.shared_path(spark, "automata")
    for name in decontamination.build(items, folder, block_words=10):
        got, mapped = common.load_arrays(f"{folder}/{name}")
        assert not mapped and len(got["hash"]) and decontamination.automaton(f"{folder}/{name}") is not decontamination.automaton(f"{folder}/{name}")


def test_cleaning(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    leaky = spark.createDataFrame([(1, BASE + " " + ITEMS[0][1] + ". End", "en", "a", 1), (2, ITEMS[0][1], "en", "a", 2)], KIND)
    names = ("items", "n_words", "n_hit", "spans", "cut", "row")
    rows = decontamination.clean(clashing(leaky.unionByName(docs), *names), items).collect()
    assert all(r[n] == "x" for r in rows for n in names)
    assert rows[0]["text"] == BASE + " . End" and rows[0]["n_chars"] == len(BASE) + 6 and len(rows) == len(ROWS) + 1
    assert decontamination.clean(none, items).count() == 0 and decontamination.clean(docs, items.limit(0)).count() == len(ROWS)


# ---------------------------------------------------------------- 5


def test_licenses(spark, none):
    texts = [
        "Use it under the MIT License. And, under the mit license!", "Apache License, Version 2.0 here", "x CC BY-NC 4.0", None, "", "mit license",
        "This work is licensed under the GNU General Public License, version 3.", "This work is now licensed under the GNU General Public License version 3", "cc by cc by nc " * 3,
    ]
    docs = clashing(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string"), "rid", "label", "words")
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = [(k, v) for p, v in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({v for _, v in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert rows[6]["labels"] == "gpl-3" and rows[7]["labels"] == "gpl-3" and rows[7]["score"] < 1 and rows[5]["labels"] == ""
    assert licenses.scan(none).count() == 0


# ---------------------------------------------------------------- 6


def shingled(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else frozenset()


def brute_links(rows):
    sets = [shingled(t) for _, t in rows]
    like = lambda a, b: (not a and not b) or bool(a and b and len(a & b) / len(a | b) >= 0.8)
    n = len(rows)
    link = [[j for j in range(n) if j != i and like(sets[i], sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in link[i])]) for i in range(n)]
    named = {c: min((rows[i][0] for i in range(n) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    return collections.Counter((rows[i][0], named[label[i]], len(link[i])) for i in range(n)), len(named)


def near_copies(seed, n, size=60):
    rng, base = np.random.default_rng(seed), prose(seed, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.choice(size, rng.integers(0, 3), replace=False):
            w[k] = f"e{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


def test_jaccard_join(spark, docs, none):
    group = [(100 + i, t) for i, t in enumerate(near_copies(3, 40) + near_copies(4, 5) + [prose(9, 70)] * 4)]
    rows = [(i, t) for i, t, *_ in ROWS] + group
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "rid", "node", "n", "paths")
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(df).collect())
    want, classes = brute_links(rows)
    assert got == want
    names = ("rid", "_rid", "row", "kept")
    kept = jaccard_join.dedupe(clashing(df, *names)).collect()
    assert len(kept) == classes and all(r[n] == "x" for r in kept for n in names)
    assert jaccard_join.join(none).count() == 0 and jaccard_join.dedupe(docs).columns == docs.columns


def test_large_nodes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rows = list(enumerate(near_copies(5, 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(df, recall=0.9999).collect())
    assert got == brute_links(rows)[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 50), (3, 90)]
    got = {r["u"]: r["v"] for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 31)}, 90: 1, 51: 50, 60: 50}
    assert jaccard_join.runs_for() >= 1 and jaccard_join.survival(0.8) > 0.9


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, docs, none, order):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t, *_ in ROWS] + [(200 + i, prose(50 + i, 300, 60)) for i in range(12)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "shard", "meta", "packed").repartition(3)
    out = common.crc_mod(F.col("doc_id"), 7) == 2
    got = kneser_ney.score(df, kneser_ney.train(df.filter(~out), order), out).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    texts = [(i, [*["\0start"] * (order - 1), *SPACE.findall((t or "").translate(LOW)), "\0end"]) for i, t in rows]
    grams = lambda ws: [tuple(ws[i : i + order]) for i in range(len(ws) - order + 1)]
    counts = {order: collections.Counter(g for i, ws in texts if not held(i) for g in grams(ws))}
    for k in range(order - 1, 0, -1):  # of the shorter ones: different words before them
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    one = collections.Counter(w for i, ws in texts if not held(i) for w in ws[order - 1 :])
    n, v = sum(one.values()), len(one)
    d = {k: kneser_ney.discounts([sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]) for k, c in counts.items()}
    begun, kinds = collections.Counter(), collections.defaultdict(collections.Counter)
    for c in counts.values():
        for g, x in c.items():
            begun[g[:-1], len(g)] += x
            kinds[g[:-1], len(g)][min(x, 3)] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        h = (g[:-1], k)
        if not begun[h]:
            return p(g[1:])
        left = sum(d[k][j] * kinds[h][j] for j in (1, 2, 3)) / begun[h]
        return max(counts[k][g] - d[k][min(counts[k][g], 3)], 0) / begun[h] + left * p(g[1:])

    some = list(one) + ["\0unknown"]
    for h in (list(counts[order])[0][:-1], list(counts[order])[40][:-1], ("\0start",) * (order - 1), ("\0never",) * (order - 1)):
        assert sum(p((*h, w)) for w in some) == pytest.approx(1)
    want = collections.Counter()
    for i, ws in texts:
        s = sum(math.log10(p(g)) for g in grams(ws))
        own = ws[order - 1 :]
        b = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own)
        want[i, held(i), len(own), sum(one[w] > 0 for w in own), n, round(b, 6), round(s, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    if order == kneser_ney.ORDER:
        nothing = kneser_ney.score(docs, kneser_ney.train(none), out).collect()
        assert len(nothing) == len(ROWS) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in nothing)
        assert kneser_ney.score(none, kneser_ney.train(docs), out).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.zipf(1.2, 500).clip(max=1 << 40).astype(np.int64), np.full(500, 255), np.zeros(500, np.int64)]
    assert all((a == b).all() for a, b in zip(kneser_ney.unpack(kneser_ney.pack(cols)), cols))
    words, c = [rng.zipf(1.3, 300).clip(max=1 << 30).astype(np.int64) for _ in range(3)], cols[1][:300]
    back = kneser_ney.unpack_grams(kneser_ney.pack_grams(words, c))
    assert sorted(zip(*(x.tolist() for x in back))) == sorted(zip(*(x.tolist() for x in [*words, c])))


@pytest.mark.parametrize("size", [0, 1, 7, 5000, 200_000])
def test_sorted_hash_arrays(tmp_path, size):
    rng = np.random.default_rng(size)
    h = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
    place = np.sort(kneser_ney.placed(h))
    cols = [rng.zipf(1.5, len(h)).clip(max=1 << 50).astype(np.int64), rng.integers(0, 3, len(h))]
    kneser_ney.store(str(tmp_path), "a", place, kneser_ney.coded(cols))
    a, mapped = common.load_arrays(f"{tmp_path}/a")
    assert mapped
    if size:
        at = kneser_ney.search(a, place)
        assert (at == np.arange(len(h))).all() and all((x == y).all() for x, y in zip(kneser_ney.decoded(a, at, 2), cols))
        assert (kneser_ney.search(a, kneser_ney.placed(rng.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))) >= 0).sum() <= 2


# ---------------------------------------------------------------- 8


def test_token_shards(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(sstable.default_vocabulary())
    rows = sstable.encode_and_read(clashing(docs, "tie", "shard")).collect()
    want = collections.Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x, *_ in ROWS)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == collections.Counter({(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())): n for (i, x), n in want.items()})
    rows.sort(key=lambda r: (r["start"]))
    assert [r["doc_id"] for r in rows] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in rows] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in rows])[:-1])).tolist()
    assert sstable.encode_and_read(none).count() == 0
    folder = str(tmp_path / "shards")
    for r in sorted(sstable.write(docs, folder).collect()):
        shard = sstable.Reader(f"{folder}/{r['shard']}")
        for key, ids in shard:
            assert any(x.tolist() == ids.tolist() for x in shard.get(sstable.id_of(key)))
        assert shard.get(10**12) == []


def test_shard_blocks_and_lookup(tmp_path):
    rng = np.random.default_rng(4)
    keys = sorted(int(k) for k in rng.integers(-(1 << 62), 1 << 62, 3000))
    data = {k: rng.integers(0, 50_000, rng.integers(0, 30)) for k in keys}
    with common.new_file(str(tmp_path), "s") as file:
        w = sstable.Writer(file, block_bytes=500)
        for k in keys:
            w.add(sstable.key_of(k), data[k])
        w.finish()
    r = sstable.Reader(f"{tmp_path}/s")
    assert [sstable.id_of(k) for k, _ in r] == keys and len(r.index) > 50 and r.documents == 3000
    assert all(r.get(k)[0].tolist() == data[k].tolist() for k in keys[::37])
    absent = [k + 1 for k in keys[::10] if k + 1 not in data]
    assert all(r.get(k) == [] for k in absent)
    marks = b"".join(sstable.mark(sstable.key_of(k)) for k in absent)
    bits = np.unpackbits(np.frombuffer(r.bloom, np.uint8), bitorder="little")
    passed = np.all([bits[p] for p in sstable.bloom_places(marks, 8 * len(r.bloom), r.hashes)], axis=0).sum()
    assert passed < 0.1 * len(absent)


def test_a_failed_file_leaves_nothing(tmp_path):
    with pytest.raises(ValueError, match="no"), common.new_file(str(tmp_path), "s") as file:
        file.write(b"x")
        raise ValueError("no")
    assert not list(tmp_path.iterdir())


def test_hash_table():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    h = np.concatenate([h, np.arange(1, 4000, 2, dtype=np.uint64) << np.uint64(20)])  # many for one slot
    t = common.HashTable(h[:10])
    for a in range(10, len(h), 700):
        t.add(h[a : a + 700])
    assert (t.find(h) == np.arange(len(h))).all() and (t.find(h + np.uint64(1 << 62) * np.uint64(3) + np.uint64(1)) == -1).sum() > 0.9 * len(h)
    assert (common.HashTable().find(h) == -1).all()


@pytest.mark.parametrize("words", [3, 1 << 20])
def test_encoder_equals_the_tokenizer(monkeypatch, words):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sstable, "CACHE_WORDS", words)
    monkeypatch.setattr(sstable, "LEARN_WORDS", 7)
    t, e = Tokenizer.from_file(sstable.default_vocabulary()), sstable.Encoder(sstable.default_vocabulary())
    texts = [*(x or "" for _, x, *_ in ROWS), "It's WE'LL don't 'S ''ll", "ÄÖÜ éÉ e\u0301 ﬁ ǅ İstanbul ſ", "a1b2 12 3½ x²", "--- ...!? @#$%^&*()_+", "\u00a0nb\u2003em\u3000", "日本語 テスト 한국어", "x" * 40_000, "é" * 3000, "😀😀 a😀b", "\x00\x1f\x7f ctl", "<|startoftext|> <|x"]
    for some in ([x] for x in texts), [texts], [texts]:
        for part in some:
            ids, offs = e.encode(pa.array(part, pa.string()))
            for i, x in enumerate(part):
                assert ids[offs[i] : offs[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], x


# ---------------------------------------------------------------- 9


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "~1 ~0 [~1INST] <s>", "a\nb", None, "[[INST]] <<SYS>>x<</SYS>>", "[AS] [ROLE]"]
    rows = [(1, 0, "system", said[0]), (1, 1, "user", said[1]), (1, 2, "assistant", said[2]), (1, 3, "user", said[4]), (1, 4, "assistant", said[0]), (1, 5, "user", said[3]),
            (2, 0, "user", "alone"), (3, 0, "tool [AS] ~", said[5]), (3, 1, None, said[4]), (3, 2, "assistant", None), (None, 0, "assistant", "x"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "example", "parts")
    shown = chat.format_examples(df)
    got = {r["conv_id"]: r for r in chat.read_back(shown).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        replies = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())
    examples = shown.filter("conv_id = 1").orderBy("example").collect()
    assert [e["loss_start"] is not None for e in examples] == [True, True, False]
    assert examples[1]["formatted"].startswith(examples[0]["formatted"]) and sum(len(e["formatted"]) for e in examples) == got[1]["formatted_chars"]
    assert chat.read_back(chat.format_examples(df.limit(0))).count() == 0


# ---------------------------------------------------------------- 10


def labelled(n=400):
    rng = np.random.default_rng(6)
    bad = ["vile", "rotten", "filthy", "nasty"]
    out, y = [], []
    for i in range(n):
        w = prose(1000 + i, 60, 2000).split()
        toxic = i % 4 == 0
        if toxic:
            for k in rng.choice(60, 3, replace=False):
                w[k] = bad[rng.integers(4)]
        out.append((i, " ".join(w)))
        y.append((i, int(toxic)))
    return out, y


def test_toxicity(spark, docs, none):
    rows, y = labelled()
    df = clashing(spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "vile rotten nasty")], "doc_id long, text string"), "score", "terms", "extra")
    labels = spark.createDataFrame([*y, (5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [(got[i]["predicted"], t) for i, t in y if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] < 0.3 and not got[1000]["neighbours"]
    assert got[None]["predicted"] == 1 and got[None]["neighbours"]
    said = collections.Counter(w for i, t in y if t and got[i]["predicted"] for w in got[i]["terms"])
    assert {w for w, _ in said.most_common(4)} == {"vile", "rotten", "filthy", "nasty"}
    assert all(r["neighbours"] for r in got.values() if words(r["text"])) and all(r["extra"] == "x" for r in got.values())
    for few in (labels.limit(0), labels.filter("toxic = 1")):
        s = toxicity.score(docs, toxicity.train(docs, few)).collect()
        assert len(s) == len(ROWS) and all(0 <= r["score"] <= 1 for r in s)
    assert toxicity.score(none, model).count() == 0
    kept = toxicity.clean(clashing(df, "row", "neighbours"), model)
    assert kept.columns == [*df.columns, "row", "neighbours"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_scores_equal_brute_force(spark):
    rows, y = labelled(220)
    rows += [(500, rows[0][1]), (501, rows[1][1] + " and more"), (502, None), (503, " . "), (504, prose(77, 20_000, 2000)), (2, "a second text of id 2")]
    y += [(500, 1), (501, None), (502, 0)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int"))).collect()
    two = {r["h"]: r["text"] for r in spark.createDataFrame([r for r in rows if r[0] == 2], "doc_id long, text string").selectExpr("xxhash64(text) h", "text").collect()}
    text = {i: t for i, t in rows} | {2: two[min(two)]}
    sample, seen = [], set()
    for i, t in sorted((i, t) for i, t in y if t is not None and zlib.crc32(str(i).encode()) % 5):
        if (text[i] or "") not in seen:
            seen.add(text[i] or "")
            sample.append((i, t))
    n = len(rows)
    df = collections.Counter(w for _, t in rows for w in set(words(t)))
    known = {w for i, _ in sample for w in words(text[i])}

    def vector(t):
        v = {w: c * (1 + toxicity.SATURATION) / (c + toxicity.SATURATION) * math.log((n + 1) / (df[w] + 1)) for w, c in collections.Counter(words(t)).items() if w in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else v

    held = [(vector(text[i]), t, i) for i, t in sample]
    labels = {i: t for i, t in y if t is not None and zlib.crc32(str(i).encode()) % 5}
    rate, own = sum(labels.values()) / len(labels), sum(t for _, t in sample) / len(sample)
    weight = [rate / own if t else (1 - rate) / (1 - own) for _, t in sample]
    empty = [(w, t) for (v, t, _), w in zip(held, weight) if not v]
    none = (sum(w * t for w, t in empty) + rate) / (sum(w for w, _ in empty) + 1)
    bad = sum(t for _, t in sample)
    radii = [15 * 2**j for j in range(10) if 15 * 2**j <= 2 * min(bad, len(sample) - bad)]
    assert len(radii) > 1

    def nearest(v, but=None):
        return sorted(((-round(sum(x * u.get(w, 0) for w, x in v.items()), 12), k) for k, (u, _, _) in enumerate(held) if k != but))

    def votes(v, but=None):
        near = [(-c, k) for c, k in nearest(v, but) if c < -1e-12]
        out = []
        for j, k in enumerate(radii):
            w = [c / max(1 - c, 0.01) if j == 0 else c for c, _ in near[:k]]
            p = (sum(x * held[e][1] for x, (_, e) in zip(w, near)) + none) / (sum(w) + 1)
            p = min(max(p, 1e-3), 1 - 1e-3)
            out.append(math.log(p / (1 - p)))
        return out, [held[e][2] for _, e in near[:3]]

    x = np.array([votes(v, k)[0] for k, (v, _, _) in enumerate(held)])
    line = toxicity.logistic((x - x.mean(0)) / (x.std(0) + 1e-9), np.array([t for _, t, _ in held], float), np.array(weight))
    want = []
    for i, t in rows:
        v, ids = votes(vector(t))
        want.append((i, round(1 / (1 + math.exp(-(line[0] + ((np.array(v) - x.mean(0)) / (x.std(0) + 1e-9)) @ line[1:]))), 6), ids))
    assert sorted(((r["doc_id"], round(r["score"], 6), r["neighbours"]) for r in got)) == sorted(want)


def test_a_near_copy_is_found_by_any_words(spark):
    rows, y = labelled()
    n = len(rows)
    rare = " ".join(f"rare{i}" for i in range(40))
    docs = [*rows, (n, rare), (n + 1, rare + " and"), (n + 2, "cleanly " + " ".join(f"calm{i}" for i in range(40)))]
    while zlib.crc32(str(docs[n][0]).encode()) % 5 == 0:  # an id outside the held-out fold
        docs[n] = (docs[n][0] + 1000, rare)
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*y, (docs[n][0], 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert got[n + 1]["predicted"] == 1 and got[n + 1]["neighbours"][0] == docs[n][0] and all(w.startswith("rare") for w in got[n + 1]["terms"])
    assert got[n + 2]["predicted"] == 0


@pytest.mark.parametrize(("share", "block", "first"), [(0.0, 8, 0.1), (0.08, 4, 1.0), (0.08, 64, 2.0), (1.0, 16, 1.0)])
def test_index_equals_brute_force(monkeypatch, share, block, first):
    monkeypatch.setattr(toxicity, "COMMON", share)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "FIRST", first)
    monkeypatch.setattr(toxicity, "TEXTS", 37)
    rng = np.random.default_rng(9)
    dense = np.zeros((300, 200))
    for k, row in enumerate(dense):
        row[rng.zipf(1.3, 20) % 100 + 100 * (k % 2)] = rng.uniform(0.1, 1)
        row /= np.sqrt((row**2).sum())
    dense[7] = dense[3]
    vectors = [(np.flatnonzero(row), row[row > 0]) for row in dense]
    index = toxicity.BlockMaxIndex(vectors, 200)
    near, who = index.nearest(vectors, 10, np.arange(300))
    for i in range(300):
        want = dense @ dense[i]
        want[i] = 0
        want = sorted(((-round(c, 12), j) for j, c in enumerate(want) if c > 1e-12))[:10]
        assert np.allclose(near[i, : len(want)], [-c for c, _ in want], atol=1e-11) and who[i, : len(want)].tolist() == [j for _, j in want] and (who[i, len(want) :] == -1).all()
    assert index.opened <= 300 * index.blocks


# ---------------------------------------------------------------- shared


def test_tokens_equal_the_patterns():
    texts = [t or "" for _, t, *_ in ROWS] + ["a", "", "é", "Z9_z", "\x80x", "x" * 5000]
    for split, pattern, fold in ((True, WORD, True), (False, SPACE, True)):
        for a, b, t in common.tokens(pa.array([*texts, None]), words=split, most=50):
            for i in range(a, b):
                want = pattern.findall(([*texts, ""][i]).translate(LOW))
                assert [t.word(k).decode() for k in range(t.offs[i - a], t.offs[i - a + 1])] == want


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("block", [8, 64, 1 << 22])
def test_separator_scan(spark, tmp_path, block):
    from fieldweave.llm import separators

    rng = np.random.default_rng(block)
    files, want = [], set()
    for k in range(5):
        ids = rng.choice([1, 2, 3, 9], [0, 1, 40, 400, 400][k], p=[0.3, 0.3, 0.2, 0.2] if k < 4 else [0.5, 0.3, 0.2, 0]).astype("<u2")
        common.write_file(str(tmp_path), f"f{k}", [ids.tobytes()])
        files.append((f"f{k}", ids.nbytes))
        start = number = 0
        for i, x in enumerate(ids.tolist()):
            if x == 9:
                want.add((f"f{k}", number, start, i - start, True))
                start, number = i + 1, number + 1
        if start < len(ids):
            want.add((f"f{k}", number, start, len(ids) - start, False))
    got = separators.scan(spark, str(tmp_path), spark.createDataFrame(files, "file string, bytes long"), 9, "<u2", block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ids_that_do_not_fit_are_refused(spark, docs, tmp_path):
    from fieldweave.llm import separators

    vocabulary = sstable.default_vocabulary()
    assert separators.dtype_for(vocabulary) == "<u2" and separators.dtype_for(vocabulary, 70_000) == "<u4"
    with pytest.raises(Exception, match="an id beyond"):
        separators.write_flat(docs, str(tmp_path), 70_000, "<u2").collect()
    assert separators.write_flat(docs, str(tmp_path), 70_000).count() > 0


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    from fieldweave.llm import separators

    t = Tokenizer.from_file(sstable.default_vocabulary())
    t.encode_special_tokens = True
    rows = separators.count_tokens(clashing(docs, "file", "at", "bytes"), block_bytes=64).collect()
    want = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in rows) == want
    assert separators.count_tokens(none).count() == 0
