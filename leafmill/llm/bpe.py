"""Byte-level BPE: encoding and decoding whole texts, with exact ids.

The tokenizers library does the merging.  Texts are cut only where a pre-token
surely begins, so the pieces give the same pre-tokens as the whole text: at a
space before anything but white space, round a lone newline, and where ASCII
punctuation follows a letter.  ``BatchEncoder`` does that for whole Arrow columns
in numpy and looks each piece up by its hash; only pieces not met before are
Python strings.  ``CachedEncoder`` takes one text, with the same rules.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import heapq
import os
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import map_batches, slices
from leafmill.llm.words import SPACE, mix, stream, text_bytes

#: Entries of each of a cache's two generations, and the longest key kept.
CACHE_ROWS, CACHE_KEY = 300_000, 48

_SAFE_CUT = re.compile(r" (?=\S)")


def byte_chars() -> list[str]:
    """The printable character that stands for each of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(spare)
            spare += 1
    return [chars[b] for b in range(256)]


BYTE_CHARS = byte_chars()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def to_bytes(chars: str) -> bytes:
    return bytes(map(CHAR_BYTES.__getitem__, chars))


_TO_CHARS = dict(enumerate(BYTE_CHARS))
#: Characters below are NFC as they are, and each is lowered by itself.
_PLAIN = "\u0130"
_SPACE, _NEWLINE, _MARKS = BYTE_CHARS[32], BYTE_CHARS[10], string.punctuation


class _Cache(dict):
    """A dict that computes what it lacks.

    When it is full its entries become the older generation and the one before
    is forgotten; an older entry that is asked for again moves back.
    """

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > CACHE_KEY:
                return value
        if len(self) >= CACHE_ROWS:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class CachedEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers.

    ``pretokens`` cuts a text, ``merge`` gives the ids of one pre-token.  With
    ``spaces`` a pre-token may begin with a space; without, spaces vanish and
    letters are lowered.  Letters, perhaps with ASCII punctuation after
    them, need no pattern: they are one pre-token, the punctuation another.
    """

    def __init__(self, pretokens: Callable[[str], Iterable[str]], merge: Callable[[str], list[int]], spaces: bool):
        self.pretokens, self.merge, self.spaces = pretokens, merge, spaces
        self.words = _Cache(lambda w: array("I", merge(w)).tobytes())
        self.parts = _Cache(self._after_space if spaces else self._bare)

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pretokens(text)))

    def _after_space(self, part: str) -> bytes | None:
        """None where the space before ``part`` is no cut."""
        return self._spaced(part) if part and not part[0].isspace() else None

    def _spaced(self, part: str, lead: str = " ") -> bytes:
        if part.isalpha():
            return self.words[(_SPACE if lead else "") + (part if part.isascii() else to_chars(part.encode()))]
        core = part.rstrip(_MARKS)
        if core.isalpha():
            return self._spaced(core, lead) + self.words[part[len(core) :]]
        if "\n" in part and (lines := part.split("\n")) == part.split():  # single newlines, no other white space
            return self._spaced(lines[0], lead) + b"".join(self.words[_NEWLINE] + self._spaced(x, "") for x in lines[1:])
        return self._cut(lead + part)

    def _bare(self, part: str) -> bytes:
        if part.isascii() or max(part) < _PLAIN:
            if part.isalpha():
                low = part.lower()
                return self.words[low if low.isascii() else to_chars(low.encode())]
            core = part.rstrip(_MARKS)
            if core.isalpha():
                return self._bare(core) + self.words[part[len(core) :]]
            if "\n" in part:
                return b"".join(map(self._bare, part.split("\n")))
        return self._cut(part)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.spaces:
            return b"".join(map(self.parts.__getitem__, text.split(" ")))
        if "  " not in text:
            parts = text.split(" ")
            try:
                return self._cut(parts[0]) + b"".join(map(self.parts.__getitem__, parts[1:]))
            except TypeError:  # one of the parts is None
                pass
        parts = _SAFE_CUT.split(text)
        return self._cut(parts[0]) + b"".join(map(self.parts.__getitem__, parts[1:]))


#: Bytes of positions hashed at once.
_BLOCK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER, _INVERSE = (_powers(b, _BLOCK + CACHE_KEY + 1) for b in (_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64)))
_VALUE = stream(53, 256) | np.uint64(1)
_ASCII_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_PUNCTUATION = np.array([chr(b) in string.punctuation for b in range(256)])
#: First bytes of two-byte characters that are letters all but two, U+00D7 and U+00F7.
_LETTER_LEAD = np.isin(np.arange(256), [0xC3, 0xD0, 0xD1])
_NO_LETTER = np.isin(np.arange(256), [0x97, 0xB7])
#: Bytes that may begin or be white space: no cut stands before one of them.
_BLANK = SPACE | np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])


class BatchEncoder:
    """Whole string columns to ids: numpy finds the pieces, a hash table their ids.

    A piece of up to ``CACHE_KEY`` bytes is known by 64 bits of hash and its
    table has up to ``rows`` entries before it starts anew; a longer one is
    encoded each time it is met.
    """

    def __init__(self, encoder: CachedEncoder, rows: int = 1 << 20):
        self.encoder, self.rows = encoder, rows
        self.mask = np.uint64((1 << max(1, (2 * rows - 1).bit_length())) - 1)
        self._forget()

    def _forget(self) -> None:
        size = int(self.mask) + 1
        self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.first, self.many, self.entries = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.flat, self.used = np.zeros(4096, "<u4"), 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, little-endian unsigned 32-bit, and where each text's begin (and the end)."""
        data, text = text_bytes(texts)
        if self.entries >= self.rows:
            self._forget()
        starts, ends = self._pieces(data, text)
        long = np.flatnonzero(ends - starts > CACHE_KEY)
        entry = self._known(data, starts, ends, long)
        many = self.many[entry].astype(np.int64)
        own = {i: np.frombuffer(self._slow(data[starts[i] : ends[i]].tobytes()), "<u4") for i in long.tolist()}
        many[long] = [len(v) for v in own.values()]
        place = np.concatenate([[0], np.cumsum(many)])
        source = np.repeat(self.first[entry] - place[:-1], many)
        source += np.arange(place[-1])
        ids = self.flat.take(source, mode="clip")
        for i, v in own.items():
            ids[place[i] : place[i + 1]] = v
        return ids, place[np.searchsorted(starts, text)]

    def _pieces(self, data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.zeros(len(data) + 1, bool)
        left, right = data[:-1], data[1:]
        letter = _ASCII_LETTER[left]
        high = np.flatnonzero(left >= 0x80)
        high = high[high > 0]
        letter[high] = _LETTER_LEAD[data[high - 1]] & ~_NO_LETTER[data[high]]
        begin[1:-1] = letter & _PUNCTUATION[right]
        if self.encoder.spaces:
            calm = ~_BLANK[right]
            begin[:-2] |= (left == 32) & calm
            lone = 1 + np.flatnonzero((data[1:-1] == 10) & calm[1:] & (left[:-1] < 0x80) & ~_BLANK[left[:-1]])
            lone = lone[~np.isin(lone, text) & ~np.isin(lone + 1, text)]
            begin[lone] = begin[lone + 1] = True
            begin[text] = True  # a space that ends a text is no piece's first but its own
            at = np.flatnonzero(begin[:-1])
            return at, np.append(at[1:], len(data))
        inside = ~SPACE[data]
        begin[text] = True
        begin[1:-1] |= inside[1:] & ~inside[:-1]
        begin[:-1] &= inside
        stop = np.zeros(len(data) + 1, bool)
        stop[1:-1] = inside[:-1] & ~inside[1:]
        stop[-1] = inside[-1]
        stop |= begin
        stop[text] = True
        at, stops = np.flatnonzero(begin[:-1]), np.flatnonzero(stop)
        return at, stops[np.searchsorted(stops, at, "right")]

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        bounds = np.searchsorted(starts, np.arange(0, len(data) + _BLOCK, _BLOCK))
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a == b:
                    continue
                base = k * _BLOCK
                values = _VALUE[data[base : base + _BLOCK + CACHE_KEY]]
                values *= _POWER[: len(values)]
                sums = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(values, out=sums[1:])
                s = starts[a:b] - base
                e = np.minimum(ends[a:b] - base, len(values))  # a longer piece is not looked up
                out[a:b] = (sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64)
        return np.maximum(mix(out), np.uint64(1))

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: np.ndarray) -> np.ndarray:
        """The entry of each piece; of a long one none, which is 0."""
        h = self._hashes(data, starts, ends)
        a = (h & self.mask).astype(np.int64)
        entry = self.slots[a].astype(np.int64)
        found = self.keys[a] == h
        found[long], entry[long] = True, 0
        lost = np.flatnonzero(~found)
        if len(lost):
            b = ((h[lost] >> np.uint64(32)) & self.mask).astype(np.int64)
            entry[lost] = self.slots[b]
            lost = lost[self.keys[b] != h[lost]]
        if len(lost):
            fresh, which, back = np.unique(h[lost], return_index=True, return_inverse=True)
            at = lost[which]
            entry[lost] = self._add(fresh, [data[s:e].tobytes() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])[back]
        return entry

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        made = [self._slow(p) for p in pieces]
        ids = np.frombuffer(b"".join(made), "<u4")
        many = np.array([len(m) // 4 for m in made], np.int32)
        self.flat = _room(self.flat, self.used, len(ids))
        self.first, self.many = (_room(x, self.entries, len(made)) for x in (self.first, self.many))
        new = np.arange(self.entries, self.entries + len(made))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[new] = self.used + np.cumsum(many) - many
        self.many[new] = many
        self.used += len(ids)
        self.entries += len(made)
        a, b = ((keys >> np.uint64(s) & self.mask).astype(np.int64) for s in (0, 32))
        slot = np.where((self.keys[a] == 0) | (self.keys[b] != 0), a, b)
        self.keys[slot], self.slots[slot] = keys, new
        lost = self.slots[slot] != new  # two of these in one slot: the key goes with the entry that stayed
        self.keys[slot[lost]] = keys[self.slots[slot[lost]] - new[0]]
        return new

    def _slow(self, piece: bytes) -> bytes:
        text, own = piece.decode(), self.encoder
        if text.isalpha() and (own.spaces or text.isascii() or max(text) < _PLAIN):  # most new pieces, and rarely met in another form
            if not own.spaces:
                text = text.lower()
            return array("I", own.merge(text if text.isascii() else to_chars(text.encode()))).tobytes()
        if not own.spaces:
            return own._bare(text)
        if text[0] != " ":
            return own._spaced(text, "")
        return own._spaced(text[1:]) if len(text) > 1 and not text[1].isspace() else own._cut(text)


def _room(old: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(old):
        return old
    out = np.zeros(max(2 * len(old), used + more), old.dtype)
    out[:used] = old[:used]
    return out


def with_ends(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` of documents that begin at ``first``, with an end id after each."""
    n = np.arange(len(first) - 1)
    out = np.empty(len(ids) + len(n), "<u4")
    ends = first[1:] + n
    plain = np.ones(len(out), bool)
    plain[ends] = False
    out[ends], out[plain] = end_id, ids
    return out, first + np.append(n, len(n))


def lowest_first(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
    if data in ranks:
        return [ranks[data]]
    n = len(data)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(data[left : end[right]])) is not None:
                heapq.heappush(heap, (r, left, end[right]))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return out


class RankVocabulary:
    """A rank file (base64 token, rank) as a BPE model of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, models, pre_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        merges, twice = [], []
        for token, rank in self.ranks.items():
            n = len(token)
            cuts = [i for i in range(1, n) if token[:i] in self.ranks and token[i:] in self.ranks]
            merges += [(rank, i, token) for i in cuts]
            # Two different pairs that make this token can overlap only when it repeats with period i.
            if any(2 * i != n and n - i in cuts and token[i:] == token[: n - i] for i in cuts):
                twice.append(token)
        merges.sort()
        self.model = models.BPE(
            vocab={to_chars(t): r for t, r in self.ranks.items()},
            merges=[(to_chars(t[:i]), to_chars(t[i:])) for _, i, t in merges],
            ignore_merges=True,
        )
        self.twice = ahocorasick.Automaton()
        for token in twice:
            self.twice.add_word(to_chars(token), len(token))
        self.twice.make_automaton()
        self.split = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def pretokens(self, text: str) -> list[str]:
        return [p for p, _ in self.split.pre_tokenize_str(text)]

    def merge(self, chars: str) -> list[int]:
        if self.twice.kind == ahocorasick.AHOCORASICK and next(self.twice.iter(chars), None):
            return lowest_first(to_bytes(chars), self.ranks)
        return [t.id for t in self.model.tokenize(chars)]

    def encoder(self) -> CachedEncoder:
        return CachedEncoder(self.pretokens, self.merge, spaces=True)


class FileTokenizer:
    """A tokenizer file of the tokenizers library, without its special tokens."""

    def __init__(self, path: str, spaces: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.normalizer, self.split, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.spaces, self.tokenize = spaces, self.model.tokenize

    def pretokens(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [p for p, _ in self.split.pre_tokenize_str(text)]

    def merge(self, chars: str) -> list[int]:
        return [t.id for t in self.tokenize(chars)]

    def encoder(self) -> CachedEncoder:
        return CachedEncoder(self.pretokens, self.merge, self.spaces)


_encoders: dict[tuple, tuple] = {}


def rank_encoder(path: str, pattern: str) -> tuple[CachedEncoder, RankVocabulary]:
    """One for each worker process; its caches serve all tasks that run there."""
    if (key := ("ranks", path, pattern)) not in _encoders:
        vocabulary = RankVocabulary(path, pattern)
        _encoders[key] = vocabulary.encoder(), vocabulary
    return _encoders[key]


def rank_batches(path: str, pattern: str) -> tuple[BatchEncoder, RankVocabulary]:
    """As ``rank_encoder``, for whole columns."""
    if (key := ("rank batches", path, pattern)) not in _encoders:
        encoder, vocabulary = rank_encoder(path, pattern)
        _encoders[key] = BatchEncoder(encoder), vocabulary
    return _encoders[key]


def file_batches(path: str, spaces: bool) -> BatchEncoder:
    """As ``file_encoder``, for whole columns."""
    if (key := ("batches", path, spaces)) not in _encoders:
        _encoders[key] = (BatchEncoder(file_encoder(path, spaces)),)
    return _encoders[key][0]


def file_encoder(path: str, spaces: bool) -> CachedEncoder:
    if (key := ("file", path, spaces)) not in _encoders:
        tokenizer = FileTokenizer(path, spaces)
        _encoders[key] = tokenizer.encoder(), tokenizer
    return _encoders[key][0]


def decode(ids: bytes | np.ndarray, table: list[bytes]) -> bytes:
    """The bytes behind ids (little-endian unsigned 32-bit, or an array)."""
    values = np.frombuffer(ids, "<u4") if isinstance(ids, (bytes, memoryview)) else np.asarray(ids)
    return b"".join(map(table.__getitem__, values.tolist()))


def decode_pieces(chunks: Iterable[bytes], table: list[bytes]) -> Iterator[str]:
    """Text of consecutive id chunks; a character split between two waits for its rest."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield decoder.decode(decode(chunk, table))
    if tail := decoder.decode(b"", True):
        yield tail


def token_spans(text: str, ids: bytes, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each token's first character and the one after its last.

    A token that holds part of a character counts that whole character.
    """
    values = np.frombuffer(ids, "<u4")
    ends = np.cumsum([len(table[i]) for i in values.tolist()], dtype=np.int64)
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    if not len(values):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    return char[starts].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)


ENCODED = "doc_id long, ids binary, starts array<int>, ends array<int>"


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``doc_id, ids, starts, ends``: ids as little-endian unsigned 32-bit integers.

    ``starts`` and ``ends`` are character offsets (null without ``offsets``).
    A null or empty text has no ids; a null id stays null; rows are never
    merged, so equal rows come back as often as they came; other columns are
    not looked at.
    """

    def make():
        encoder, vocabulary = rank_encoder(path, pattern)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [encoder.encode(t) for t in texts]
                spans = [token_spans(t or "", i, vocabulary.table) for t, i in zip(texts, ids, strict=True)] if offsets else []
                starts, ends = ([s[k] for s in spans] if offsets else [None] * len(ids) for k in (0, 1))
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "ids", "starts", "ends"])

        return step

    return map_batches(_two(df, id_col, text_col), make, ENCODED)


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, data, text``: the bytes behind ``ids``, and their text.

    Bytes that are no UTF-8 become U+FFFD in ``text``; null ids give null.
    """

    def make():
        _, vocabulary = rank_encoder(path, pattern)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data = [None if x is None else decode(x, vocabulary.table) for x in batch.column("ids").to_pylist()]
            texts = [None if d is None else d.decode("utf-8", "replace") for d in data]
            yield pa.record_batch([batch.column("doc_id"), pa.array(data, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "data", "text"])

        return step

    return map_batches(df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids"), make, "doc_id long, data binary, text string")


def _two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and return digests of both in one pass over the texts.

    The ids never leave the worker that made them, so nothing is shuffled and
    nothing grows but one narrow row for each document.  A null or empty text
    has no ids; a text of any length is encoded whole.  A null id stays null,
    repeated rows come back as often as they came, no rows give no rows; other
    columns are not looked at.
    """

    def make():
        encoder, vocabulary = rank_batches(path, pattern)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                ids, first = encoder.encode(part.column("text"))
                data = memoryview(ids.tobytes())
                ids_sha, decoded_sha, sizes = [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    decoded = decode(ids[a:b], vocabulary.table)
                    ids_sha.append(hashlib.sha256(data[4 * a : 4 * b]).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                    sizes.append(len(decoded))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(first)), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

        return step

    return map_batches(_two(df, id_col, text_col), make, DIGESTS)
