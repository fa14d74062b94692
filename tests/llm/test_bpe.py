import base64
import hashlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import bpe, entry

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def u32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_agrees_with_tiktoken(spark, sf_dir, documents, public):
    got = {r.doc_id: r for r in entry.op1_byte_bpe(spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = public.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(u32(ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_edges_encode_and_decode(edges, empty, public):
    out = bpe.encode_documents(edges, RANKS, P.PATTERN, offsets=True)
    rows = out.collect()
    assert len(rows) == edges.count()
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    for r in rows:
        text = texts[r.doc_id]
        assert bytes(r.ids) == u32(public.encode_ordinary(text))
        assert len(r.starts) == len(r.ends) == len(r.ids) // 4
        assert all(a < b <= len(text) for a, b in zip(r.starts, r.ends, strict=True))
        if text:
            assert r.starts[0] == 0 and r.ends[-1] == len(text)
    assert {r.doc_id: r.text for r in bpe.decode_documents(out, RANKS, P.PATTERN).collect()} == texts
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


AWKWARD = st.lists(st.sampled_from(list("ab  \n\t\r\x0b\x1c\x85\xa0'sSé日³½Ⅷ1-.!aaa--") + ["  ", " ", "İ", "Σ", "ﬁ", "👩‍👧", "á"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_caches_change_nothing(public, text):
    encoder, vocabulary = bpe.rank_encoder(RANKS, P.PATTERN)
    ids = encoder.encode(text)
    assert ids == u32(public.encode_ordinary(text))
    assert bpe.decode(ids, vocabulary.table) == text.encode()


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_whole_columns_agree_with_tiktoken(public, text):
    for own in (bpe.rank_batches(RANKS, P.PATTERN)[0], small_ranks()):
        ids, first = own.encode(pa.array([text, None, text + " " + text]))
        assert ids[: first[1]].tolist() == public.encode_ordinary(text) and first[1] == first[2]
        assert ids[first[2] :].tolist() == public.encode_ordinary(text + " " + text)


@cache
def small_ranks():
    return bpe.BatchEncoder(bpe.rank_encoder(RANKS, P.PATTERN)[0], 1)


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_files_agree_with_the_library(text):
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        assert bpe.file_encoder(P.path(name), spaces).encode(text) == u32(library_of(name).encode(text, add_special_tokens=False).ids)


@cache
def library_of(name):
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = True
    return library


@cache
def batches_of(name, spaces, rows):
    return bpe.BatchEncoder(bpe.file_encoder(P.path(name), spaces), rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), AWKWARD), max_size=6))
def test_whole_columns_agree_with_the_library(texts):
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        library = library_of(name)
        for rows in (1, 1 << 12):  # a table that is always full, and one that is not
            own = batches_of(name, spaces, rows)
            for column in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
                ids, first = own.encode(column)
                assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_pieces_and_blocks_of_a_column():
    text = "x" * 70_000 + " a,b" * 90_000 + "\n" + "é" * 30 + "! " * 50_000
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        library = library_of(name)
        ids, first = bpe.file_batches(P.path(name), spaces).encode(pa.array([text, "", "y" * 49, text]))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[: first[1]].tolist() == want == ids[first[3] :].tolist()
        assert first[1] == first[2]


def test_characters_split_between_tokens():
    encoder, vocabulary = bpe.rank_encoder(RANKS, P.PATTERN)
    ids = encoder.encode("ab👩日")
    single = [ids[i : i + 4] for i in range(0, len(ids), 4)]
    assert "".join(bpe.decode_pieces(single, vocabulary.table)) == "ab👩日"


def test_overlapping_equal_ranks_merge_from_the_left(public):
    encoder, _ = bpe.rank_encoder(RANKS, P.PATTERN)
    for text in ("a" * 77, "-" * 1001, "=-" * 50, "\n" * 33, "anan" * 9, "x" * 20_000):
        assert encoder.encode(text) == u32(public.encode_ordinary(text))


def test_cache_generations():
    made = []
    cache = bpe._Cache(lambda k: made.append(k) or k.encode())
    limit, bpe.CACHE_ROWS = bpe.CACHE_ROWS, 3
    try:
        assert [cache[k] for k in "abcadbea"] == [k.encode() for k in "abcadbea"]
        assert len(cache) + len(cache.older) <= 6 and len(made) <= 7
    finally:
        bpe.CACHE_ROWS = limit
