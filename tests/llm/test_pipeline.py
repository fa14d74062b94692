"""The pipeline on a small table against its stages done by hand."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm import quality, toxicity
from tests.llm.test_minhash import brute
from tests.llm.test_quality import brute as counts


def test_stages_are_what_run_does(spark, sf_dir, documents):
    columns, docs, kept = documents.columns, documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == columns, name
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) > 0.3 * len(before)
        kept.append(after)
        docs = out
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(documents, labels)
    good = {r.doc_id for r in quality.score_documents(documents, model).collect() if r.kept}
    assert kept[0] == good and not any(counts(r.text)[5] for r in documents.collect() if r.doc_id in good)
    first = documents.where(documents.doc_id.isin(*kept[0]))
    model = toxicity.train(first, labels)
    assert kept[1] == {r.doc_id for r in toxicity.grade_documents(first, model).collect() if r.kept}
    groups = brute([(r.doc_id, r.text) for r in documents.collect() if r.doc_id in kept[1]])
    assert kept[2] == {i for i, (_, _, stays) in groups.items() if stays}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == kept[2]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in documents.collect()}
    assert sum(r.length for r in rows) == sum(tokens[i] for i in kept[2])


def test_no_rows(spark, documents):
    none = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
