import hashlib
import zlib

import numpy as np
import pytest

from leafmill.llm import entry, jpeg, media


def test_query(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in entry.op3_progressive_jpeg(spark, sf_dir).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert rows.keys() == texts.keys()
    seen = {}
    for doc_id, data in texts.items():
        r = rows[doc_id]
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert seen.setdefault(data, tuple(r)[1:]) == tuple(r)[1:]


def test_edges(edges, empty):
    stored = media.store_texts(edges).cache()
    back = sorted((r.doc_id or -1, r.text) for r in media.read_texts(stored).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in edges.collect())
    for r in media.tensors(stored).collect():
        assert len(r.rgb) == 3 * r.height * r.width
    assert media.store_texts(empty).count() == 0 and media.store_and_read(empty).count() == 0


def test_other_bytes_have_no_pixels(spark):
    good = media.to_files(__import__("pyarrow").array(["text"]))[0]
    rows = spark.createDataFrame([(1, b"no picture"), (2, None), (3, good), (4, good[:90])], "doc_id long, media binary")
    assert {r.doc_id: r.width for r in media.tensors(rows).collect()} == {1: None, 2: None, 3: 32, 4: None}


class Reader:
    """Bit by bit, block by block: progressive JPEG as the standard tells it."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def bits(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | (self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1)
            self.at += 1
        return out

    def symbol(self, table):
        codes, lengths = jpeg.canonical(*table)
        find = {(int(n), int(c)): s for s, (c, n) in enumerate(zip(codes, lengths, strict=True)) if n}
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits(1)
            if (n, code) in find:
                return find[n, code]
        raise AssertionError("no such code")

    def value(self, n):
        v = self.bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def slow_decode(data):
    f = jpeg.parse(data)
    out = np.zeros((f.blocks, 64), int)
    for scan, tables, restart, lanes in f.scans:
        blocks, part, unit = jpeg.scan_blocks(f.width, f.height, f.parts, scan.parts)
        step = restart * unit or len(blocks)
        for k, lane in enumerate(lanes):
            reader, before, run = Reader(lane), {}, 0
            for b, c in zip(blocks[k * step : (k + 1) * step], part[k * step : (k + 1) * step], strict=True):
                table, now, row = tables[scan.parts.index(c)], scan.now, out[b]
                if scan.low == 0 and not scan.before:
                    before[c] = before.get(c, 0) + reader.value(reader.symbol(table) & 15)
                    row[0] = before[c] << now
                elif scan.low == 0:
                    row[0] |= reader.bits(1) << now
                elif not scan.before:
                    at = scan.low
                    if run:
                        run -= 1
                        continue
                    while at <= scan.high:
                        r, s = divmod(reader.symbol(table), 16)
                        if s:
                            at += r
                            row[at] = reader.value(s) << now
                        elif r < 15:
                            run = (1 << r) + reader.bits(r) - 1
                            break
                        else:
                            at += 15
                        at += 1
                else:
                    at, one = scan.low, 1 << now
                    while at <= scan.high and not run:
                        r, s = divmod(reader.symbol(table), 16)
                        new = 0
                        if s:
                            new = one if reader.bits(1) else -one
                        elif r < 15:
                            run = (1 << r) + reader.bits(r)
                            break
                        while at <= scan.high:
                            if row[at]:
                                if reader.bits(1):
                                    row[at] += one if row[at] > 0 else -one
                            elif not r:
                                if new:
                                    row[at] = new
                                at += 1
                                break
                            else:
                                r -= 1
                            at += 1
                    if run:
                        for i in range(at, scan.high + 1):
                            if row[i] and reader.bits(1):
                                row[i] += one if row[i] > 0 else -one
                        run -= 1
    return out


SCRIPTS = {
    "own": jpeg.SCRIPT,
    "deep": (*(jpeg.Scan((c,), *band, 0, 3) for c in range(3) for band in ((0, 0), (1, 9), (10, 63))), *(jpeg.Scan((c,), *band, n + 1, n) for n in (2, 1, 0) for c in range(3) for band in ((0, 0), (1, 63)))),
}


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 1.0])
@pytest.mark.parametrize("restart", [1, 8, 1000])
def test_against_the_slow_decoder(monkeypatch, script, share, restart):
    monkeypatch.setattr(jpeg, "SCRIPT", SCRIPTS[script])
    monkeypatch.setattr(jpeg, "RESTART", restart)
    rng = np.random.default_rng(restart)
    sizes = [(16, 16), (48, 32), (16, 64), (80, 80)]
    blocks = sum(w * h * 6 // 256 for w, h in sizes)
    coefs = np.where(rng.random((blocks, 64)) < share, rng.integers(-160, 161, (blocks, 64)), 0).astype(np.int16)
    coefs[rng.random(blocks) < 0.4, 20:] = 0
    blobs = jpeg.encode(coefs, sizes, [b""] * 4)
    files, got = jpeg.decode(blobs)
    assert (got == coefs).all()
    assert (slow_decode(blobs[3]) == coefs[files[3].base :]).all()


def test_pixels():
    coefs = np.zeros((24, 64), np.int16)
    coefs[:, 0] = np.repeat([400, -200, 300], [16, 4, 4])
    files, got = jpeg.decode(jpeg.encode(coefs, [(32, 32)], [b"c"]))
    y, cb, cr = 128 + 50, 128 - 25, 128 + 37.5
    want = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    rgb = jpeg.tensors(files, jpeg.samples(files, got))[0]
    assert rgb.shape == (32, 32, 3) and (np.abs(rgb.reshape(-1, 3) - np.clip(want, 0, 255)) <= 2).all()


def test_samples_are_those_of_the_cosine_sum():
    rng = np.random.default_rng(0)
    coefs = rng.integers(-60, 61, (24, 64)).astype(np.int16)
    files, got = jpeg.decode(jpeg.encode(coefs, [(32, 32)], [b""]))
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = coefs[5]
    block = block.reshape(8, 8)
    scale = np.array([0.125**0.5] + [0.5] * 7)
    want = [[sum(scale[v] * scale[u] * block[v, u] * np.cos((2 * y + 1) * v * np.pi / 16) * np.cos((2 * x + 1) * u * np.pi / 16) for v in range(8) for u in range(8)) for x in range(8)] for y in range(8)]
    assert np.abs(jpeg.samples(files, got)[5].reshape(8, 8) - np.clip(np.array(want) + 128, 0, 255)).max() <= 0.51
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
