import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from leafmill.llm import entry, packing

PATH = P.path("byte_bpe_50k.json")


def sound(rows, capacity):
    """Sequences are gapless from 0 and hold at most ``capacity``; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark, sf_dir, documents):
    library = Tokenizer.from_file(PATH)
    rows = entry.op5_best_two_fit(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys()
    total = 0
    for doc_id, own in pieces.items():
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sound(rows, 1024) <= -(-total // 1024) + 2


def test_edges(edges, empty):
    rows = packing.pack_documents(edges, PATH, with_ids=True).collect()
    sound(rows, 1024)
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for capacity in (10, 64, 1024):
        counts = {rng.randint(1, capacity): rng.randint(1, 3000) for _ in range(60)}
        patterns = packing.plan(counts, capacity)
        used = defaultdict(int)
        for times, lengths in patterns:
            assert times > 0 and sum(lengths) <= capacity
            for n in lengths:
                used[n] += times
        assert dict(used) == counts
        assert len(patterns) < 40 * len(counts)


def test_two_for_one():
    # Greedy fills 6 + 3 of 10 and leaves 1; the 3 gives way to 2 + 2.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]
    assert packing.best_two(np.array([0, 0, 1, 0]), 1, 4) is None
    assert packing.best_two(np.array([0, 0, 2, 0, 0]), 3, 4) == (2, 2)


def test_partitions_change_nothing(documents):
    a = packing.pack_documents(documents.repartition(1), PATH)
    b = packing.pack_documents(documents.repartition(7), PATH)
    assert sorted(a.collect()) == sorted(b.collect())


def test_other_columns_may_have_any_names(spark):
    rows = [(1, 0, 5, 10, 9, 1, 2, 3, 4)] * 40 + [(2, 0, 6, 10, 8, 1, 2, 3, 4)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, salt int, rank int, before int, tie int")
    got = packing.pack(parts, 32).collect()
    assert len(got) == 41 and got[0].rank == 2
    assert sound(got, 32) == 14


def test_repeated_pieces_get_a_place_each(spark):
    rows = [(1, 0, 0, 10, 9)] * 50 + [(None, 0, 0, 10, 9)] * 7 + [(2, 0, 0, 10, 8), (3, 0, 0, 4, 8)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    key = lambda r: (r.sequence_id, r.offset)
    want = sorted(packing.pack(parts.repartition(1), 32).collect(), key=key)
    assert sorted(tuple(r)[:5] for r in want if r.doc_id) == sorted(r for r in rows if r[0])
    assert len(want) == len(rows) and sound(want, 32) == 20
    for n, group in ((3, 200_000), (7, 8), (2, 1)):
        got = packing.pack(parts.repartition(n), 32, group).collect()
        assert len(got) == len(rows) and sound(got, 32) == 20
        if group > 64:
            assert sorted(got, key=key) == want
