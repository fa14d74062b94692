"""Texts as media columns: progressive JPEG files that hold them without loss.

JPEG keeps quantized coefficients exactly, not samples, so these are the unit: a
payload byte is one coefficient in zigzag order, with all quantizers 1.  Bytes
that are frequent in prose stand for small coefficients, and none for zero.
Blocks fill Y, then Cb, then Cr of a 4:2:0 picture about as wide as high; spare
blocks at the end are zero.  The file's comment says how many bytes the text
has; with it the payload comes back from the coefficients of any decoder.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm import jpeg
from leafmill.llm.common import map_batches, saved, slices
from leafmill.llm.words import text_bytes

UNIT, FILL = 576, 255
_MCU, _BLOCKS = 384, 6
#: Fixed value: bytes in order of their frequency in prose and filling; the rest follow by number.
FREQUENT = b" en\xfftaiorshdlu\xc3cm\ngpfbvwy,.\xa9kTSIEA-"


def _values() -> np.ndarray:
    """The coefficient of each byte: 1, -1, 2, -2 and so on down the frequencies."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    out = np.empty(256, np.int16)
    out[order] = [(k // 2 + 1) * (1 - k % 2 * 2) for k in range(256)]
    return out


TO_COEF = _values()
TO_BYTE = np.zeros(257, np.uint8)
TO_BYTE[TO_COEF + 128] = np.arange(256)


def padded(n: int) -> int:
    """The payload of n bytes: filled up to a positive multiple of UNIT."""
    return max(1, -(-n // UNIT)) * UNIT


def shape(payload: int) -> tuple[int, int]:
    """Width and height of the picture that holds so many bytes."""
    units = -(-payload // _MCU)
    across = int(np.ceil(np.sqrt(units)))
    return 16 * across, 16 * -(-units // across)


def to_files(texts: pa.Array) -> list[bytes]:
    data, first = text_bytes(texts)
    sizes = np.diff(first).tolist()
    shapes = [shape(padded(n)) for n in sizes]
    blocks = [w * h // 256 * _BLOCKS for w, h in shapes]
    at = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    coefs = np.zeros(64 * at[-1], np.int16)
    values = TO_COEF[data]
    for n, a, start in zip(sizes, at, first.tolist(), strict=False):
        coefs[64 * a : 64 * a + n] = values[start : start + n]
        coefs[64 * a + n : 64 * a + padded(n)] = TO_COEF[FILL]
    return jpeg.encode(coefs.reshape(-1, 64), shapes, [b"text bytes %d" % n for n in sizes])


def payloads(files: list[jpeg.File], coefs: np.ndarray) -> list[tuple[int, bytes]]:
    """Of each file the text's bytes and the payload with its filling."""
    out = []
    flat = TO_BYTE[np.clip(coefs.reshape(-1), -128, 128) + 128]
    for f in files:
        n = int(f.comment.rpartition(b" ")[2])
        out.append((n, flat[64 * f.base : 64 * f.base + padded(n)].tobytes()))
    return out


_LEVELS = np.arange(256)


def feature(rgb: np.ndarray) -> str:
    """Size, mean colour in thousandths, and shares of eight bands of green in thousandths."""
    h, w, _ = rgb.shape
    n = h * w
    levels = [np.bincount(rgb[:, :, k].reshape(-1), minlength=256) for k in range(3)]
    means = [int(x @ _LEVELS) * 1000 // n for x in levels]
    bands = levels[1].reshape(8, 32).sum(axis=1) * 1000 // n
    return f"{w}x{h} " + ",".join(map(str, means)) + " " + ",".join(map(str, bands.tolist()))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each whole text as a progressive JPEG file.

    A null or empty text is one unit of filling.  Equal texts have equal files;
    a null id stays null; other columns are not looked at.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text", 2 << 20):
                yield pa.record_batch([part.column("doc_id"), pa.array(to_files(part.column("text")), pa.binary())], ["doc_id", "media"])

        return step

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, "doc_id long, media binary")


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[jpeg.File], np.ndarray]]:
    for part in slices(batch, "media", 2 << 20):
        blobs = part.column("media").to_pylist()
        yield part, blobs, *jpeg.decode(blobs)


def tensors(media: DataFrame) -> DataFrame:
    """``doc_id, height, width, rgb``: full-resolution pixels, three bytes each, row by row.

    Any progressive JPEG of one or three components; other bytes, and null, give null.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "media", 2 << 20):
                height, width, rgb = [], [], []
                for blob in part.column("media").to_pylist():
                    try:
                        files, coefs = jpeg.decode([blob or b""])
                        pixels = jpeg.tensors(files, jpeg.samples(files, coefs))[0]
                    except (jpeg.JpegError, IndexError, KeyError, ValueError):
                        pixels = None
                    height.append(None if pixels is None else pixels.shape[0])
                    width.append(None if pixels is None else pixels.shape[1])
                    rgb.append(None if pixels is None else pixels.tobytes())
                yield pa.record_batch([part.column("doc_id"), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(rgb, pa.binary())], ["doc_id", "height", "width", "rgb"])

        return step

    return map_batches(media.select("doc_id", "media"), make, "doc_id long, height int, width int, rgb binary")


def read_texts(media: DataFrame) -> DataFrame:
    """``doc_id, text`` of files that ``store_texts`` made (a null text comes back empty)."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, _, files, coefs in _decoded(batch):
                texts = [own[:n].decode() for n, own in payloads(files, coefs)]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return map_batches(media.select("doc_id", "media"), make, "doc_id long, text string")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What the stored files hold, and features of their pixels."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, blobs, files, coefs in _decoded(batch):
                pixels = jpeg.tensors(files, jpeg.samples(files, coefs))
                rows = [
                    (n, len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(rgb))
                    for (n, own), blob, rgb in zip(payloads(files, coefs), blobs, pixels, strict=True)
                ]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        return step

    return map_batches(media.select("doc_id", "media"), make, DIGESTS)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of files written to the shared folder and read again."""
    return digests(saved(store_texts(docs, id_col, text_col), "media", "zstd"))
