"""Toxicity by the nearest labelled examples.

Examples are a bounded, seeded sample of the labelled documents (``MAX_EXAMPLES``; equal texts once), half of them
toxic as far as there are so many; the calibration weighs each class as it is among all labels. A text is its
TF-IDF vector over every word of the examples, with document frequencies counted over all documents; labels choose no
words. Its neighbours are the examples of the highest exact cosine, found in a block-max inverted index: examples
stand in blocks of like ones. Rare words are met through their postings; of the common words, whose postings are
long, each block holds the greatest weights, which bound what they can add. Blocks are opened in the order of their
bounds, until no bound exceeds the k-th best cosine; only there the common words are summed up.

Votes weighted by nearness tell the score: that of the ``K`` nearest examples, near copies far ahead, and those of
twice, four times and so on as many (``WIDE`` at most); in the wide ones words
tell that are few in a long text. The votes are calibrated by a logistic fit of the examples' own, each without itself. Evidence is the nearest examples' ids and, of a text
called toxic, the words that bring it near to toxic neighbours rather than to others.

Defined cases: a null or empty text, or one without a word of the examples, gets the calibrated rate of such examples;
very long texts are scored whole; of several labels of an id the greatest counts, null ones do not; labels without a
document are ignored; of several texts of an id that of the least hash is the example; without examples of both
classes the score is the examples' rate (0 without any); ties among neighbours go to the earlier example; repeated
rows are scored alike, each for itself; an empty table gives no rows; extra columns pass through ``score``, but for
score, predicted, neighbours and terms, which it replaces, and through ``clean`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

FOLDS, HELD_OUT = 5, 0
#: The classifier is fitted on at most so many labelled documents.
MAX_EXAMPLES = 8000
#: The fewest and most neighbours; how far ahead near copies are at most; the weight of the rate.
K, WIDE, NEAR, PRIOR = 15, 960, 0.01, 1.0
#: A word counts tf * (1 + SATURATION) / (tf + SATURATION) times its idf.
SATURATION = 1.0
#: Of the index: examples a block, texts at once, from which share of the examples on a word is common and how many
#: are at most, and how much more than the neighbours is opened at first. They decide the speed alone.
BLOCK, TEXTS, COMMON, DENSE, FIRST = 64, 64, 0.1, 512, 2.0
SLICE = 256
#: Cosines that differ by less are ties.
SAME = 1e-12
SEED, TERMS = 11, 5

Vector = tuple[np.ndarray, np.ndarray]


def flattened(vectors: list[Vector]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, terms, weights) of sparse vectors."""
    offs = np.concatenate(([0], np.cumsum([len(t) for t, _ in vectors]))).astype(np.int64)
    if not len(vectors):
        return offs, np.zeros(0, np.int32), np.zeros(0)
    return offs, np.concatenate([t for t, _ in vectors]).astype(np.int32), np.concatenate([w for _, w in vectors]).astype(np.float64)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of successive ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class BlockMaxIndex:
    """Sparse unit vectors of examples, by term and by block of examples; every cosine is exact."""

    def __init__(self, vectors: list[Vector], terms: int):
        self.n, self.terms = len(vectors), terms
        self.offs, self.term, self.weight = flattened(vectors)
        self._build()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("n", "terms", "offs", "term", "weight")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._build()

    def _build(self) -> None:
        n = self.n
        self.number = np.full(self.terms, -1, np.int32)
        df = np.bincount(self.term, minlength=self.terms)
        common = np.argsort(-df, kind="stable")[:DENSE]
        common = common[df[common] > COMMON * n]
        self.slot = np.full(self.terms, -1, np.int32)
        self.slot[common] = np.arange(len(common))
        who = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.offs))
        often = self.slot[self.term] >= 0
        dense = np.zeros((n, len(common)))
        dense[who[often], self.slot[self.term[often]]] = self.weight[often]
        self.order = alike(dense, np.diff(self.offs))
        self.blocks = -(-n // BLOCK)
        self.place = np.empty(n, np.int32)
        self.place[self.order] = np.arange(n, dtype=np.int32)
        self.top = np.zeros((len(common), self.blocks))
        self.dense: list[tuple[np.ndarray, np.ndarray]] = []  # of each block its common words, and their weights
        for b in range(self.blocks):
            part = dense[self.order[b * BLOCK : (b + 1) * BLOCK]].T
            self.top[:, b] = part.max(1, initial=0)
            own = np.flatnonzero(self.top[:, b])
            self.dense.append((own, np.ascontiguousarray(part[own])))
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.at = np.searchsorted(self.term[rare], np.arange(self.terms + 1))
        self.posting, self.posted = self.place[who[rare]], self.weight[rare]
        del dense, who, often, rare

    def nearest(self, texts: list[Vector], k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each text the k examples of the highest cosine above 0, without the example ``but``: rows of cosines
        and of examples, filled up by 0 and -1."""
        near, who = np.zeros((len(texts), k)), np.full((len(texts), k), -1, np.int64)
        self.opened = 0
        for a in range(0, len(texts) if self.n and k else 0, TEXTS):
            self._nearest(texts[a : a + TEXTS], k, None if but is None else but[a : a + TEXTS], near[a : a + TEXTS], who[a : a + TEXTS])
        return near, who

    def _nearest(self, texts: list[Vector], k: int, but: np.ndarray | None, near: np.ndarray, who: np.ndarray) -> None:
        m = len(texts)
        sums, often = np.zeros((m, self.blocks * BLOCK)), np.zeros((m, len(self.top)))
        for i, (t, w) in enumerate(texts):
            slot = self.slot[t]
            often[i, slot[slot >= 0]] = w[slot >= 0]
            t, w = t[slot < 0], w[slot < 0]
            size = self.at[t + 1] - self.at[t]
            at = spans(self.at[t], size)
            sums[i] = np.bincount(self.posting[at], np.repeat(w, size) * self.posted[at], minlength=sums.shape[1])
        if but is not None:
            sums[np.arange(m), self.place[but]] = -10.0
        cells = sums.reshape(m, self.blocks, BLOCK)
        bound = cells.max(2) + often @ self.top
        first = min(self.blocks, int(np.ceil(FIRST * k / BLOCK)) + 1)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        open_ = np.zeros((m, self.blocks), bool)
        np.put_along_axis(open_, best, True, 1)
        self._open(cells, often, open_)
        least = np.zeros(m)
        if first * BLOCK > k and first < self.blocks:
            met = np.take_along_axis(cells, best[:, :, None], 1).reshape(m, -1)
            least = np.maximum(np.partition(met, met.shape[1] - k, 1)[:, met.shape[1] - k], 0)
        more = (bound > least[:, None] - SAME) & ~open_
        self._open(cells, often, more)
        open_ |= more
        self.opened += int(open_.sum())
        for i in range(m):
            blocks = np.flatnonzero(open_[i])
            value = cells[i, blocks].ravel()
            at = np.flatnonzero(value > SAME)
            if len(at) > k:
                at = at[value[at] >= np.partition(value[at], len(at) - k)[len(at) - k] - SAME]
            value, example = value[at], self.order[blocks[at // BLOCK] * BLOCK + at % BLOCK]
            at = np.lexsort((example, -np.round(value, 12)))[:k]
            near[i, : len(at)], who[i, : len(at)] = value[at], example[at]

    def _open(self, cells: np.ndarray, often: np.ndarray, which: np.ndarray) -> None:
        for b in np.flatnonzero(which.any(0)):
            rows = np.flatnonzero(which[:, b])
            own, weights = self.dense[b]
            cells[rows, b, : weights.shape[1]] += often[np.ix_(rows, own)] @ weights

    def shared(self, text: Vector, examples: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, what each adds) to the weighted sum of the text's cosines with some examples."""
        size = self.offs[examples + 1] - self.offs[examples]
        at = spans(self.offs[examples], size)
        t, w = text
        self.number[t] = np.arange(len(t))
        place = self.number[self.term[at]]
        self.number[t] = -1
        hit = place >= 0
        return t, np.bincount(place[hit], (self.weight[at] * np.repeat(weights, size))[hit], minlength=len(t)) * w


def alike(dense: np.ndarray, sizes: np.ndarray, rounds: int = 6) -> np.ndarray:
    """An order in which examples of like common words, and then of like length, stand together."""
    n = len(dense)
    groups = int(np.ceil(np.sqrt(n / BLOCK)))
    if groups < 2 or not dense.shape[1]:
        return np.argsort(sizes, kind="stable")
    unit = dense / np.maximum(np.sqrt((dense * dense).sum(1)), 1e-12)[:, None]
    middle = unit[np.linspace(0, n - 1, groups).astype(int)]
    for _ in range(rounds):
        group = (unit @ middle.T).argmax(1)
        middle = np.stack([unit[group == g].sum(0) if (group == g).any() else middle[g] for g in range(groups)])
        middle /= np.maximum(np.sqrt((middle * middle).sum(1)), 1e-12)[:, None]
    return np.lexsort((sizes, group))


class Model:
    """The words of the examples and their idf, the examples' index and labels, and the calibration."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = C.HashTable(self.hashes)
        self.idf = np.ones(len(hashes))
        self.ids, self.y = [], np.zeros(0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.table = C.HashTable(self.hashes)

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> Vector:
        w = tf * (1 + SATURATION) / (tf + SATURATION) * self.idf[terms]
        return terms, w / max(float(np.sqrt((w * w).sum())), 1e-12)

    def counts(self, t: C.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets by text, terms, times) of the examples' words in each text; a text's terms ascend."""
        n, words = len(t.offs) - 1, max(1, len(self.hashes))
        at = self.table.find(t.hash)
        hit = np.flatnonzero(at >= 0)
        key, times = np.unique(t.doc()[hit] * words + at[hit], return_counts=True)
        return np.searchsorted(key, np.arange(n + 1) * words), key % words, times

    def radii(self) -> list[int]:
        """From K on each twice the one before, up to twice the number of toxic (or, if fewer, other) examples, or WIDE."""
        out = [K]
        while 2 * out[-1] <= WIDE and out[-1] <= min(self.y.sum(), len(self.y) - self.y.sum()):
            out.append(2 * out[-1])
        return out

    def neighbours(self, rows: list[Vector], but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of texts given as (terms, times); but: for each an example that does not count."""
        return self.index.nearest([self.vector(*r) for r in rows], max(self.radii()), but)

    def votes(self, near: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The votes of each text's neighbours, a column a radius."""
        bad = np.where(who >= 0, self.y[who] if len(self.y) else 0.0, 0.0)
        out = []
        for i, k in enumerate(self.radii()):
            w = near[:, :k] / np.maximum(1 - near[:, :k], NEAR) if i == 0 else near[:, :k]
            out.append(((w * bad[:, :k]).sum(1) + PRIOR * self.none) / (w.sum(1) + PRIOR))
        return np.stack(out, 1)

    def fit(self, ids: list[int], y: np.ndarray, rows: list[Vector], rate: float) -> None:
        """Index the examples, given (terms, times), and calibrate on each one's votes without itself; rate: the share
        of toxic ones among all that are labelled, which examples of either class stand for by their weight."""
        self.ids, self.y = ids, y
        self.both = len(y) > 0 and 0 < y.sum() < len(y)
        self.rate = rate if self.both else float(y.mean()) if len(y) else 0.0
        weight = np.where(y > 0, self.rate / y.mean(), (1 - self.rate) / (1 - y.mean())) if self.both else np.ones(len(y))
        empty = np.array([not len(t) for t, _ in rows], bool)
        self.none = float(((y * weight)[empty].sum() + self.rate) / (weight[empty].sum() + 1)) if len(y) else 0.0
        self.index = BlockMaxIndex([self.vector(*r) for r in rows], len(self.hashes))
        if self.both:
            # in slices: all neighbours at once would be many times as large as the examples
            x = logit(np.concatenate([self.votes(*self.neighbours(rows[a : a + SLICE], np.arange(a, min(a + SLICE, len(rows))))) for a in range(0, len(rows), SLICE)]))
            self.middle, self.spread = x.mean(0), x.std(0) + 1e-9
            self.line = logistic((x - self.middle) / self.spread, y, weight)

    def score(self, votes: np.ndarray) -> np.ndarray:
        if not self.both:
            return np.full(len(votes), self.rate)
        return 1 / (1 + np.exp(-(self.line[0] + (logit(votes) - self.middle) / self.spread @ self.line[1:])))

    def reasons(self, row: Vector, who: np.ndarray) -> np.ndarray:
        """The terms that add more to the cosines with the nearest toxic examples than to those with the nearest others."""
        who = who[who >= 0]
        bad, good = who[self.y[who] > 0][:K], who[self.y[who] == 0][:K]
        t, gain = self.index.shared(self.vector(*row), np.concatenate([bad, good]), np.concatenate([np.full(len(x), s / max(1, len(x))) for x, s in ((bad, 1), (good, -1))]))
        best = np.argsort(-gain, kind="stable")[:TERMS]
        return t[best[gain[best] > 0]]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and slopes by Newton's method with halved steps; columns whose slope would fall are left out, the
    steepest first, so that no vote ever lowers the score."""
    m, use = np.concatenate([np.ones((len(x), 1)), x], 1), np.ones(x.shape[1] + 1, bool)

    def loss(b: np.ndarray) -> float:
        z = m @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * (b @ b))

    while True:
        beta = np.zeros(m.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(m @ beta, -50, 50)))
            grad = m.T @ (weight * (y - p)) - ridge * beta
            part = m[:, use]
            step = np.zeros_like(beta)
            step[use] = np.linalg.solve((part * (weight * p * (1 - p))[:, None]).T @ part + ridge * np.eye(part.shape[1]), grad[use])
            now, size = loss(beta), 1.0
            while loss(beta + size * step) > now + 1e-12 and size > 1e-6:
                size /= 2
            beta += size * step
            if np.abs(size * step).max() < 1e-9:
                break
        low = int(beta[1:].argmin()) + 1
        if beta[low] >= 0:
            return beta
        use[low] = False


def examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, toxic, text) of the sample, written once, and the share of toxic ones among all that are labelled. Half
    of the sample is toxic, as far as there are so many of either class; of each the first by a seeded hash, one text
    an id, equal texts once."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(C.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    known = C.materialise(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic-labels")
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = count.get(1, 0), count.get(0, 0)
    most = min(bad, max(MAX_EXAMPLES // 2, MAX_EXAMPLES - good))
    sample: list = []
    for toxic, n in ((1, most), (0, min(good, MAX_EXAMPLES - most))):
        sample += known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(n).collect()
    marked = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in sample], "doc_id long, toxic int")
    # marked has MAX_EXAMPLES rows at most
    one = rows.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("x"))
    first = one.groupBy(F.col("x.h")).agg(F.min(F.struct("doc_id", "x")).alias("y"))
    return C.materialise(first.select("y.doc_id", "y.x.toxic", "y.x.text"), "toxic-examples"), bad / max(1, bad + good)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    C.prepare(docs.sparkSession)
    kept, rate = examples(docs, labels)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t in C.tokens(batch.column("text"), most=CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(t.hash).view(np.int64))], ["h"])

    # the words of MAX_EXAMPLES documents at most
    model = Model(C.map_arrow(kept.select("text"), words, "h long").distinct().toArrow()["h"].to_numpy().view(np.uint64))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(model.hashes), np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, t in C.tokens(batch.column("text"), most=CHUNK):
                df += np.bincount(model.counts(t)[1], minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(df)], pa.int32()), pa.array([n, *df[df > 0]], pa.int64())], ["term", "df"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in C.tokens(batch.column("text"), most=CHUNK):
                offs, terms, times = model.counts(t)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("toxic").slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(terms, pa.int32())), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(times, pa.int32())),
                ], ["doc_id", "toxic", "terms", "times"])

    count = C.map_arrow(docs.select("text"), frequent, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # one row a word
    term, freq = count["term"].to_numpy(), count["df"].to_numpy()
    total = int(freq[term < 0].sum())
    model.idf = np.full(len(model.hashes), np.log(total + 1))
    model.idf[term[term >= 0]] = np.log((total + 1) / (freq[term >= 0] + 1))
    found = C.map_arrow(kept, features, "doc_id long, toxic int, terms array<int>, times array<int>").toArrow().sort_by("doc_id")

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = found[name].combine_chunks()
        return lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)

    (terms, offs), (times, _) = flat("terms"), flat("times")
    ids, toxic = found["doc_id"].to_pylist(), found["toxic"].to_numpy().astype(float)
    del found, count, term, freq
    C.trim()  # the driver's memory is small, and what follows takes several times the examples' vectors
    model.fit(ids, toxic, [(terms[x:y], times[x:y]) for x, y in zip(offs, offs[1:])], rate)
    del terms, times
    C.trim()
    return model


ADDED = ["score", "predicted", "neighbours", "terms"]
#: Bytes of text met at once.
CHUNK = 1 << 18


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with score, predicted, and as evidence the nearest examples' ids and the telling words."""
    spark = docs.sparkSession
    C.prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded as the examples are
    kept = docs.drop(*ADDED)
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string("score double, predicted int, neighbours array<long>, terms array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores, near_ids, words = [], [], []
            for _, _, t in C.tokens(batch.column("text"), most=CHUNK):
                offs, terms, times = m.counts(t)
                rows = [(terms[x:y], times[x:y]) for x, y in zip(offs, offs[1:])]
                of: dict[tuple[bytes, bytes], int] = {}
                at = [of.setdefault((x.tobytes(), y.tobytes()), len(of)) for x, y in rows]
                first = np.unique(at, return_index=True)[1]
                near, who = m.neighbours([rows[i] for i in first])
                told = m.score(m.votes(near, who))
                why: dict[int, list[str]] = {}
                for i, row in zip(at, first.tolist()):
                    if told[i] >= 0.5 and i not in why:
                        hashes = t.hash[t.offs[row] : t.offs[row + 1]]
                        why[i] = [t.word(int(t.offs[row] + np.flatnonzero(hashes == m.hashes[x])[0])).decode() for x in m.reasons(rows[row], who[i])]
                scores += told[at].tolist()
                near_ids += [[m.ids[x] for x in who[i, :3] if x >= 0] for i in at]
                words += [why.get(i, []) for i in at]
            added = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(near_ids, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *ADDED])

    return C.map_arrow(kept, run, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, their columns untouched."""
    rows = docs.select(C.packed(docs), "text")
    return score(rows, model).filter("predicted = 0").select("row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    held_out = C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "neighbours", "terms")
