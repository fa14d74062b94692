import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from leafmill.llm import entry, store

PATH = P.path("word_bpe_49k.json")


def encoded(rows):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return [(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")) for r in rows]


def test_query(spark, sf_dir, documents):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in entry.op10_content_store(spark, sf_dir).collect())
    want, start = [], 0
    for doc_id, ids in encoded(documents.orderBy("doc_id").collect()):
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_edges_and_whole_ids(spark, edges, empty):
    at = store.write(edges, PATH)
    rows = sorted(store.read_ids(spark, at).collect(), key=lambda r: r.start)
    want = sorted((x is not None, x or 0, ids.tobytes()) for x, ids in encoded(edges.collect()))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [x[:2] for x in want]
    assert sorted(bytes(r.ids) for r in rows) == sorted(x[2] for x in want)
    assert [r.start for r in rows] == np.cumsum([0] + [len(r.ids) // 4 for r in rows])[:-1].tolist()
    at = store.write(empty, PATH)
    assert store.read_sums(spark, at).count() == 0


def test_equal_passages_are_stored_once(spark):
    words = " ".join(f"w{i} is {i * 7919 % 1000}" for i in range(4000))
    docs = spark.createDataFrame([(i, f"start {i} " + words) for i in range(20)], "doc_id long, text string").repartition(5)
    at = store.write(docs, PATH)
    stored = store._chunks(spark, at)
    ids = store.read_sums(spark, at).agg({"n_tokens": "sum"}).first()[0]
    assert stored.count() == stored.select("name").distinct().count()
    assert stored.selectExpr("sum(octet_length(payload)) / 2").first()[0] < 0.1 * ids


def test_damage_is_found(spark, documents):
    at = store.write(documents.limit(50), PATH)
    chunks = store._chunks(spark, at)
    bad = chunks.selectExpr("name", "concat(payload, x'0100') payload").collect()
    spark.createDataFrame(bad, chunks.schema).write.mode("overwrite").parquet(f"{at}/chunks/kind=chunk")
    with pytest.raises(Exception, match="other bytes than its name says"):
        store.read_sums(spark, at).collect()


def test_moved_recipes_are_found(spark, documents):
    at = store.write(documents.limit(50), PATH)
    recipes = store._recipes(spark, at)
    moved = recipes.selectExpr("part", "key", "before + 1 as before", "doc_id", "n_tokens", "names", "root").collect()
    spark.createDataFrame(moved, recipes.schema).write.mode("overwrite").parquet(f"{at}/recipes")
    with pytest.raises(Exception, match="not those of the manifest"):
        store.read_sums(spark, at)


def test_blocks_and_repeated_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i // 3 % 40 if i % 5 else None, f"text {i // 3 % 7}") for i in range(300)], "doc_id long, text string").repartition(6)
    monkeypatch.setattr(store, "BLOCK", 16)
    at = store.write(docs, PATH)
    assert spark.read.parquet(f"{at}/manifest").agg({"documents": "max"}).first()[0] <= 16
    rows = sorted(store.read_sums(spark, at).collect(), key=lambda r: r.start)
    want = sorted(((x is not None, x or 0), zlib.crc32(ids.tobytes())) for x, ids in encoded(docs.collect()))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in rows) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [w[0] for w in want]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_crc_of_joined_parts():
    parts = [b"abc" * 5, b"", b"x" * 4097, b"tail", b"z" * 70_000, b"end"]
    crcs, sizes = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts])
    got = store.joined_crcs(crcs, sizes, np.array([0, 4, 6]))
    assert got.tolist() == [zlib.crc32(b"".join(parts[:4])), zlib.crc32(b"".join(parts[4:]))]


def test_cuts_follow_the_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_408, 6000)
    for first in ([0, 6000], [0, 10, 70, 4000, 6000], [0, 0, 6000]):
        ends = store.cuts(ids, np.array(first), 49_408)
        for a, b, own in zip(first[:-1], first[1:], ends, strict=True):
            sizes = np.diff([a, *own])
            assert (own[-1] == b) if b > a else not own
            assert all(s <= store.MOST for s in sizes) and all(s >= store.LEAST for s in sizes[:-1])
    shifted = store.cuts(np.concatenate([ids[:100], ids]), np.array([0, 6100]), 49_408)[0]
    whole = store.cuts(ids, np.array([0, 6000]), 49_408)[0]
    assert len(set(x - 100 for x in shifted) & set(whole)) > 0.6 * len(whole)
