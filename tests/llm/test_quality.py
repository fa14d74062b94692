import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import entry, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            marked |= set(range(i, i + 5))
    base = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)
    return (*base, len(words) < 10 or 100 * len(marked) > 20 * len(words))


def test_query(spark, sf_dir, documents):
    rows = entry.op8_quality_rules(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_good_stay_and_bad_go(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels)
    kept = {r.doc_id: r.kept for r in quality.score_documents(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [kept[i] for i, q in truth.items() if q == 1]
    bad = [kept[i] for i, q in truth.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_edges(spark, edges, empty):
    model = quality.train(edges, spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.score_documents(edges, model).collect()
    texts = [r.text for r in edges.collect()]
    assert sorted(tuple(r)[1:7] for r in rows) == sorted(brute(t) for t in texts)
    kept = quality.keep_good(edges, model)
    assert kept.schema == edges.schema and kept.count() == sum(not brute(t)[5] for t in texts)
    assert quality.score_documents(empty, model).count() == 0


def test_forest_finds_what_lies_apart():
    rng = np.random.default_rng(2)
    usual = rng.normal(0.1, 0.03, (1000, 4)).clip(0, 1)
    forest = quality.IsolationForest(usual)
    assert forest.score(np.full((1, 4), 0.9))[0] > forest.score(usual).max()


def test_counts_do_not_depend_on_the_batch():
    texts = ["a b c d e a b c d e f", None, "x\n\nx\nx y # $", "ä ö ü " * 9, ""]
    whole, _ = quality.measure(pa.array(texts))
    single = np.concatenate([quality.measure(pa.array([t], pa.string()))[0] for t in texts])
    assert (whole == single).all()


def test_path_lengths_against_a_walk_down_each_tree():
    rng = np.random.default_rng(2)
    forest = quality.IsolationForest(rng.random((60, 4)), trees=7, sample=32)
    rows = rng.random((25, 4))

    def path(t, row):
        node = 0
        while forest.feature[t, node] >= 0:
            node = 2 * node + 1 + (row[forest.feature[t, node]] >= forest.split[t, node])
        return forest.length[t, node]

    want = [2 ** -(np.mean([path(t, r) for t in range(7)]) / forest.usual(32)) for r in rows]
    assert np.allclose(forest.score(rows), want)


def test_every_labelled_row_takes_part(spark):
    ids = spark.range(12_600).withColumnRenamed("id", "doc_id")
    last = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id", F.lit(8)).desc()).limit(300).collect()}
    usual, junk = "some plain words that a good text of any kind may hold {}", "# $ % & < > | * # $ % & X{}"
    docs = spark.createDataFrame([(i, (junk if i in last else usual).format(i)) for i in range(12_600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in last)) for i in range(12_600)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.score_documents(docs, quality.train(docs, labels)).collect()}
    assert {i for i, k in kept.items() if not k} == last


def test_model_against_all_rows_at_once(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").select("text", "quality").toArrow().combine_chunks()
    base, features = quality.measure(rows.column("text").combine_chunks())
    ok, bad = ~quality.base_failed(base), rows.column("quality").to_numpy() == 0
    features, bad = features[ok], bad[ok]
    forest = quality.IsolationForest(features[~bad])
    for parts in (1, 5):
        model = quality.train(docs.repartition(parts), labels.repartition(parts))
        assert (model.forest.feature == forest.feature).all() and (model.forest.length == forest.length).all()
        assert model.threshold == quality.calibrate(forest.score(features), bad, 0.001)


def test_threshold_of_a_table(spark):
    rng = np.random.default_rng(5)
    for n, loss in ((1, 0.001), (40, 0.1), (3000, 0.01), (3000, 0.0)):
        scores = np.round(rng.random(n + 30), 2 if n == 40 else 9)
        bad = np.arange(n + 30) >= n
        table = spark.createDataFrame([(int(s), bool(b)) for s, b in zip(scores.view(np.int64), bad, strict=True)], "bits long, bad boolean")
        assert quality.calibrate_table(table, n, loss) == quality.calibrate(scores, bad, loss)


def test_parts_hold_every_row():
    rows = np.random.default_rng(3).random((900, 4))
    forest = quality.IsolationForest.planted(900, 4, trees=5)
    leaves = forest.leaves(rows[:500]) + forest.leaves(rows[500:])
    assert (leaves.sum(axis=1) == 900).all()
    forest.fill(leaves)
    whole = quality.IsolationForest(rows, trees=5)
    assert (forest.length == whole.length).all() and (forest.feature == whole.feature).all()
