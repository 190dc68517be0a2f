"""The registered queries on the smallest tables, against their SQL where there is one; and the pipeline."""

import collections
import zlib

import numpy as np
import pytest
from compare import database, difference
from pyspark.sql import functions as F
from test_operators import ITEMS, KIND, ROWS, SPACE, brute_links, hits, near_copies, prose, words

import corpus_pipeline
from fieldweave.llm import jaccard_join, mixing, sstable, toxicity
from fieldweave.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert difference(spark, database(SF), QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_a_row_for_each_document(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES[name](spark, SF).count() == n


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert 0.5 * n < docs.count() < n
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_each_stage_keeps_what_brute_force_keeps(spark, tmp_path):
    from tokenizers import Tokenizer

    bad = ["vile", "rotten", "filthy", "nasty"]
    rng = np.random.default_rng(3)
    rows = [r for r in ROWS if r[0] is not None and r[0] != 13]
    for i in range(100, 220):
        w = prose(2000 + i, 50, 3000).split()
        if i % 4 == 0:
            for k in rng.choice(50, 6, replace=False):
                w[k] = bad[rng.integers(4)]
        rows.append((i, " ".join(w), "en", "abc"[i % 3], 9))
    rows += [(300 + i, t, "de", "b", 9) for i, t in enumerate(near_copies(8, 12))]
    rows += [(400, BASED + " " + ITEMS[0][1] + " . End of it", "en", "a", 5), (401, ITEMS[0][1], "en", "a", 5), (402, prose(5, 40) + " single", "en", "c", 5)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100, 220)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)

    told = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    kept = of(stages["toxicity"](spark, docs, sf))
    assert kept == sorted((r for r in map(tuple, docs.collect()) if r[0] in {x["doc_id"] for x in told if x["predicted"] == 0}), key=repr)
    toxic = {i for i in range(100, 220) if i % 4 == 0}
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert len(gone & toxic) > 0.8 * len(toxic) and len(gone - toxic) < 5

    docs = spark.createDataFrame(kept, KIND)
    linked, _ = brute_links([r[:2] for r in kept])
    first = {c for i, c, _ in linked}
    once = of(stages["ngram_jaccard_join"](spark, docs, sf))
    assert [r[0] for r in sorted(once)] == sorted(first) and set(once) <= set(kept)

    docs = spark.createDataFrame(once, KIND)
    clean = of(stages["decontamination"](spark, docs, sf))
    want = {}
    for r in once:
        n, hit, _ = hits(r[1], ITEMS)
        if hit <= n / 2:
            want[r[0]] = (n - hit, hit)
    before = {r[0]: r for r in once}
    assert {r[0]: len(words(r[1])) for r in clean} == {i: n for i, (n, _) in want.items()} and 401 not in want and want[400][1] == 25
    for r in clean:
        if not want[r[0]][1]:
            assert r == before[r[0]]
        else:
            assert r[4] == len(r[1]) and not hits(r[1], ITEMS[:1])[1]

    docs = spark.createDataFrame(clean, KIND)
    mix = of(stages["mixing"](spark, docs, sf))
    times = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    assert collections.Counter(mix) == +collections.Counter({r: times[r[0]] for r in clean})
    sizes = collections.Counter()
    for r in mix:
        sizes[r[3]] += len(SPACE.findall(r[1] or ""))
    goal = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(sizes[s] - t) <= 60 for s, t in goal.items())

    t = Tokenizer.from_file(sstable.default_vocabulary())
    shards = stages["token_output"](spark, spark.createDataFrame(mix, KIND), sf).orderBy("start").collect()
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in clean}
    assert [r["doc_id"] for r in shards] == sorted(r[0] for r in mix)
    assert all((r["n_tokens"], r["ids_crc32"]) == (len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes())) for r in shards)
    assert [tuple(r) for r in corpus_pipeline.run(spark, sf).orderBy("start").collect()] == [tuple(r) for r in shards]


BASED = prose(61, 150, 3000)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, stage):
    none = spark.createDataFrame([], KIND)
    assert corpus_pipeline.STAGES[stage][1](spark, none, SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    names = ("row", "rid", "score", "predicted", "n_words", "cut", "times", "k", "h")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.lit("x") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.filter(" OR ".join(f"{n} <> 'x'" for n in names)).isEmpty()
    assert jaccard_join.op6_jaccard_join(spark, SF).count() == docs.count()
