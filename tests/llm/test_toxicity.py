import numpy as np
import pyarrow as pa

from leafmill.llm import entry, toxicity

#: Fewer labelled rows than this table has leave languages without toxic examples.
SF = "/root/testdata/sf0.1"


def test_query_on_labelled_rows(spark):
    rows = {r.doc_id: r for r in entry.op9_toxicity(spark, SF).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert rows.keys() == docs
    assert all(0 <= r.severity <= 3 and r.toxic != r.kept and 0 <= r.grade <= 3 for r in rows.values())
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    toxic = [rows[i].toxic for i, t in truth.items() if t == 1]
    clean = [rows[i].toxic for i, t in truth.items() if t == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    found = {r.doc_id: r.toxic for r in toxicity.grade_documents(docs, model).collect()}
    assert np.mean([found[i] == bool(t) for i, t in truth.items()]) > 0.95


def test_edges(spark, edges, empty):
    none = toxicity.train(edges, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.grade_documents(edges, none).collect()
    assert len(rows) == edges.count() and not any(r.toxic for r in rows)
    kept = toxicity.keep_civil(edges, none)
    assert kept.schema == edges.schema and kept.count() == edges.count()
    assert toxicity.grade_documents(empty, none).count() == 0


def test_one_weight_vector_orders_the_grades():
    rng = np.random.default_rng(0)
    n = 400
    x = rng.integers(0, 4, n)
    weights, cuts = toxicity.fit(np.arange(n), np.zeros(n, int), x.astype(float), x, 1)
    assert weights[0] > 0 and cuts[0] < cuts[1] < cuts[2]
    p = 1 / (1 + np.exp(-(weights[0] * np.arange(4)[:, None] - cuts)))
    assert (np.diff(p.sum(axis=1)) > 0).all() and abs(p.sum(axis=1)[3] - 3) < 0.7


def test_words_and_beginnings(spark):
    rows = [(i, f"plain words here vile{'' if i % 3 else 'ly'} {i}" if i % 2 else f"plain words here {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    grades = model.grades(pa.array(["such VILELY here", "plain words here", None]))
    assert grades[0, 0] > model.threshold >= max(grades[1, 0], grades[2, 0])


def test_grades_against_one_text_at_a_time():
    import re

    words = pa.array(["Bad words, bad apples", "badly done", None, "nothing here"])
    kinds, owner, _ = toxicity.features(words)
    whole = {w: int(h) for w, h in zip(re.findall("[A-Za-z']+", "Bad words, bad apples"), kinds[0][owner == 0], strict=True)}
    assert whole["Bad"] == whole["bad"]
    picked = np.array([whole["bad"], whole["words"]], np.uint64)
    picker = toxicity.Picker(picked)
    weights = np.array([2.0, -0.5])
    model = toxicity.ToxicityModel(picker, weights, np.array([0.5, 1.0, 2.0]), 0.5)
    order = {int(h): k for k, h in enumerate(picker.picked)}
    score = weights[order[whole["bad"]]] * np.log1p(2) + weights[order[whole["words"]]] * np.log1p(1)
    want = [[1 / (1 + np.exp(-(s - c))) for c in (0.5, 1.0, 2.0)] for s in (score, 0.0, 0.0, 0.0)]
    assert np.allclose(model.grades(words), want)
