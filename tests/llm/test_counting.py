import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as proto

from leafmill.llm import counting, entry

PATH = P.path("piece_bpe_32k.model")


def unigram(scores):
    """The public pieces as a unigram model of the library, with these scores."""
    model = proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    for p in model.pieces:
        if p.piece in scores:
            p.score = scores[p.piece]
    return SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def library():
    return unigram(counting.load_pieces(PATH))


def test_query_agrees_with_the_library(spark, sf_dir, documents, library):
    got = {r.doc_id: r.n_tokens for r in entry.op7_unigram_counts(spark, sf_dir).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "")) for r in documents.collect()}


def test_edges(edges, empty, library):
    rows = counting.count_tokens(edges, PATH).collect()
    texts = [r.text or "" for r in edges.collect()]
    assert sorted(r.n_tokens for r in rows) == sorted(len(library.encode(t)) for t in texts)
    assert counting.count_tokens(empty, PATH).count() == 0
    assert [tuple(r)[1:] for r in rows if r.doc_id == 1] == [(0, 0, 0.0)]


AWKWARD = st.lists(st.sampled_from([*"abcdeéß日\n\t .,'-", "  ", "the", "ing", "▁", "👩‍👧", "aaaa"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(AWKWARD)
def test_ties_and_unknowns(library, text):
    assert counting.counter(PATH).count(text)[0] == len(library.encode(text))


def test_rounding_is_the_librarys():
    """Scores that no float sum is exact for: the whole-text program."""
    scores = {p: s * 0.3337 - 0.01 for p, s in counting.load_pieces(PATH).items()}
    own, library = counting.UnigramCounter(scores), unigram(scores)
    assert not own.exact
    for text in ("the cat sat on the mat and then the other thing " * 400, "añb日 \n x" * 300):
        assert own.count(text)[0] == len(library.encode(text))


def test_beyond_the_exact_range(library):
    own = counting.UnigramCounter(counting.load_pieces(PATH))
    text = "thorough reinterpretation of unusual words; " * 300
    want = own.count(text)
    own.exact = 100.0
    assert own.count(text) == want and want[0] == len(library.encode(text))
