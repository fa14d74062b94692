import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import entry, langid
from leafmill.llm.langid import ByteNet, Shape


@pytest.fixture(scope="module")
def net(documents):
    return langid.train(documents)


def test_query_on_the_held_out_fold(spark, sf_dir, documents):
    got = {r.doc_id: r for r in entry.op4_byte_network(spark, sf_dir).collect()}
    rows = documents.collect()
    assert got.keys() == {r.doc_id for r in rows}
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in rows if got[r.doc_id].held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95


def test_edges(edges, empty, net):
    rows = {r.doc_id: r for r in langid.predict(edges, net).collect()}
    assert [(rows[k].lang_pred, rows[k].score) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(rows[k].lang_pred in net.langs for k in (4, 5, None, 7, 8, 9))
    assert not rows[None].held_out
    assert langid.predict(edges, net).count() == edges.count()
    assert langid.predict(empty, net).count() == 0
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.predict(edges, None).collect()} == {"und"}


def test_windows_cover_every_place():
    shape = Shape(window=16, widths=(2, 3))
    texts = pa.array([None, "", "a", "x" * 16, "y" * 17, "0123456789" * 7])
    windows, owner, real = langid.windows_of(texts, shape)
    for i, text in enumerate(texts.to_pylist()):
        own = windows[owner == i]
        starts = np.arange(len(own)) * shape.stride
        found = {bytes(w[k : k + 3]) for w, r in zip(own, real[owner == i], strict=True) for k in range(r - 2)}
        data = (text or "").encode()
        assert found >= {data[k : k + 3] for k in range(len(data) - 2)}
        assert len(own) == (0 if not data else starts[-1] // shape.stride + 1)


def test_gradients_are_the_slopes():
    shape = Shape(window=12, embed=3, widths=(2, 3), filters=2)
    net = ByteNet.fresh(shape, ["a", "b", "c"])
    random = np.random.default_rng(0)
    windows, langs = random.integers(0, 256, (6, 12)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    for k in net.order:
        setattr(net, k, getattr(net, k).astype(np.float64))
    grads = net._gradients(windows, langs, np.ones(6))
    grads["conv"] *= shape.mask()

    def loss():
        return -np.log(langid.softmax(net.scores(windows))[np.arange(6), langs]).mean()

    for k in net.order:
        values = getattr(net, k)
        places = np.argwhere(np.abs(grads[k]) > 1e-3)[:8]
        for at in map(tuple, places):
            was = values[at]
            values[at] = was + 1e-5
            up = loss()
            values[at] = was - 1e-5
            down = loss()
            values[at] = was
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-3


def test_letters():
    assert not any(map(langid.has_letter, (None, "", "100", "½ 100 ²", "Ⅷ _", "—\n\t!")))
    assert all(map(langid.has_letter, ("½ x", "é", "日", "Ω.")))


def brute_scores(net, text):
    """Mean over windows, weighted by their bytes, one window and one filter at a time."""
    data, shape = text.encode(), net.shape
    total, at = np.zeros(len(net.langs)), 0
    while at == 0 or at + shape.widest - 1 < len(data):
        window = (data[at : at + shape.window] + b" " * shape.window)[: shape.window]
        x = net.embed[np.frombuffer(window, np.uint8)]
        top = [max(float((x[k : k + shape.widest].ravel() * net.conv[:, f]).sum()) for k in range(shape.window - shape.widest + 1)) for f in range(shape.size)]
        total += (np.maximum(np.array(top) + net.bias, 0) @ net.out + net.out_bias) * min(shape.window, len(data) - at)
        at += shape.stride
    return total


def test_predictions_against_one_window_at_a_time(spark):
    net = ByteNet.fresh(Shape(window=24, embed=3, widths=(2, 3), filters=3), ["a", "b", "c"])
    texts = ["short", "a somewhat longer text, of two or three windows and a rest", "é" * 40, "x" * 24, "y" * 25]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(rows, net).collect()}
    assert got == {k: net.langs[int(brute_scores(net, t).argmax())] for k, t in enumerate(texts)}


def test_training_rows_are_bounded_whole_and_repeatable(spark):
    rows = [(i % 50, f"{'ein' if i % 2 else 'one'} text {i // 50} " * 40, "de" if i % 2 else "en") for i in range(200)] + [(7, "y" * 300, "xx"), (None, "no id", "zz")]
    nets = []
    for parts in (3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        nets.append(langid.train(docs, Shape(window=32, filters=4), sample=20, longest=5_000))
    assert nets[0].langs == nets[1].langs and "zz" not in nets[0].langs
    assert all((getattr(nets[0], k) == getattr(nets[1], k)).all() for k in nets[0].order)
