"""Near-duplicate groups: one-permutation MinHash, bands, stars, exact links.

One permutation fills all bins of a signature at once; an empty bin copies a
filled one that a fixed random order of bins names (optimal densification), so
that any two texts look in the same order.  Texts that agree in a band share a
bucket.  A bucket gives each member one candidate edge, to its smallest member:
a star, so edges grow with rows and not with pairs.  Edges are confirmed on the
full sets.  Where a bucket still holds texts of different groups, further stars
with other centres follow, and then every pair between the groups: in small
buckets one by one, in larger ones by what each text and the hub do not share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import map_batches, saved, slices, unused, workers_see_us
from leafmill.llm.components import components
from leafmill.llm.words import mix, shingle_sets, stream, words_of


@dataclass(frozen=True)
class NearDup:
    """Linked: 100 * intersection >= ``percent`` * union of ``words``-word shingles.

    A pair at the threshold of 0.85 shares none of the 40 bands of 7 with a
    chance of 2e-7.  ``small`` is the bucket size up to which, after the first
    star, all pairs between different groups are confirmed; larger buckets get
    ``rounds`` rounds of stars around ``centres`` further members first, which
    join most of what is alike, and all pairs still between different groups
    are then compared, in blocks of about ``block`` members.
    """

    words: int = 5
    percent: int = 85
    bands: int = 40
    rows: int = 7
    small: int = 16
    centres: int = 2
    rounds: int = 2
    block: int = 1024


class Signer:
    """Sets of 64-bit hashes to band keys."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.order = (stream(23, 4096 * self.bins) % np.uint64(self.bins)).astype(np.int64).reshape(4096, self.bins)
        self.places = stream(29, self.bins) | np.uint64(1)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """The least value of each bin; ``values`` ascend and are not empty."""
        bins = ((mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(self.bins)).astype(np.int64)
        out, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[::-1]] = values[::-1]  # of several, the last written is the least
        full[bins] = True
        empty = np.flatnonzero(~full)
        if len(values) == 1:
            out[:] = values[0]
            return out
        for at in range(0, len(self.order), 32):
            if not len(empty):
                return out
            tries = self.order[at : at + 32, empty]
            hit = full[tries]
            found = hit.any(axis=0)
            out[empty[found]] = out[tries[hit.argmax(axis=0), np.arange(len(empty))][found]]
            empty = empty[~found]
        out[empty] = values[0]  # still the same for equal sets; about never reached
        return out

    def keys(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            rows = (self.signature(values) * self.places).reshape(self.bands, self.rows)
            return mix(rows.sum(axis=1, dtype=np.uint64) + self.places[: self.bands]).view(np.int64)


_signers: dict[tuple[int, int], Signer] = {}


def signer(bands: int, rows: int) -> Signer:
    if (bands, rows) not in _signers:
        _signers[bands, rows] = Signer(bands, rows)
    return _signers[bands, rows]


def _signed(docs: DataFrame, p: NearDup) -> DataFrame:
    def make():
        own = signer(p.bands, p.rows)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                sets = shingle_sets(words_of(part.column("text")), p.words)
                n = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    h1 = np.array([mix(s * np.uint64(3)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    h2 = np.array([mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                bands = pa.array([own.keys(s) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(n), pa.array(h1), pa.array(h2), bands], ["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands"])

        return step

    return map_batches(docs, make, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>")


#: Bits of the filter that spares texts outside all pairs the way; 2 MB whatever the input.
FILTER_BITS = 1 << 24


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of FILTER_BITS at any size of the input.

    It only lets texts be left out that are surely in no pair; where it is
    full it lets all through, and the exact join after it decides alone.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 32) as int))")).alias("bits"))
    got = words.toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _sets(docs: DataFrame, p: NearDup, near: np.ndarray) -> DataFrame:
    docs = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((near[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            for part in slices(batch, "text") if batch.num_rows else ():
                sets = [s.tobytes() for s in shingle_sets(words_of(part.column("text")), p.words)]
                yield pa.record_batch([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "hashes"])

        return step

    return map_batches(docs, make, "id long, hashes binary")


def _sets_of(ids: DataFrame, docs: DataFrame, p: NearDup, most: int) -> DataFrame:
    ids = saved(ids.toDF("doc_id").distinct(), "candidates", rows=most)
    return saved(_sets(docs, p, _filter(ids)).join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi"), "sets")


def _confirmed(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, p: NearDup) -> DataFrame:
    """The pairs ``a, b`` of a written table whose full sets are similar enough.

    Sets of too different sizes need no look at the texts.
    """
    most = pairs.count()
    for side in "ab":
        pairs = pairs.join(sizes.toDF(side, f"n{side}"), side)
    pairs = saved(pairs.where(f"100 * least(na, nb) >= {p.percent} * greatest(na, nb)").select("a", "b"), "sized", rows=most)
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(pairs.select("a").union(pairs.select("b")), docs, p, 2 * most)
    both = pairs.join(sets.toDF("b", "of_b"), "b").join(sets.toDF("a", "of_a"), "a").select("a", "b", "of_a", "of_b")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("of_a"), batch.column("of_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= p.percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * common >= p.percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

        return step

    return map_batches(both, make, "a long, b long")


def near_duplicates(df: DataFrame, params: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for every row of ``df``.

    A text without words (null, empty) is linked with nothing.  A null id is
    linked with nothing either and stays (component_id null, kept true).  Rows
    that repeat an id and text get equal results; rows that share an id follow
    their own texts; of a group the least id is kept, so there are no ties.  A
    text of any length is one set.  No rows give no rows.  Other columns are not
    looked at.
    """
    p = params
    docs = df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text", f"xxhash64(`{text_col}`) text_hash")
    signed = saved(_signed(docs, p), "signed")
    n = signed.count()
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    classes = saved(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes", rows=n)
    firsts = linked.withColumnRenamed("doc_id", "rep").join(classes, ["h1", "h2", "rep"], "left_semi")
    sizes = saved(firsts.select("rep", "n_shingles").distinct(), "sizes", rows=n)
    members = firsts.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1")
    rest = saved(members.join(buckets, "key"), "buckets", rows=n * p.bands)
    most = rest.count()
    tested = saved(rest.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs", rows=most)
    texts = docs.where("doc_id is not null").drop("text_hash")
    links = saved(_confirmed(tested, sizes, texts, p), "confirmed")
    labels = components(links)
    for done in range(p.rounds):
        # A bucket of one group stays one, so each round looks at what the round before left.
        rest = _mixed(rest, labels, most)
        pairs = _stars(rest.where(f"size > {p.small}").drop("hub"), p, done)
        if not done:
            x, y = rest.where(f"size <= {p.small}").alias("x"), rest.alias("y")
            small = x.join(y, F.expr("x.key = y.key and x.rep < y.rep and x.label <> y.label")).selectExpr("x.rep a", "y.rep b")
            pairs = pairs.union(small)
        fresh = saved(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs", rows=most)
        new = saved(_confirmed(fresh, sizes, texts, p), "confirmed")
        if not new.isEmpty():
            links = links.union(new)
            labels = components(links)
        tested = tested.union(fresh)
        rest = rest.where(f"size > {p.small}")
    last = _between(_mixed(rest, labels, most).select("hub", "rep", "label").distinct(), texts, p)
    if last is not None and not last.isEmpty():
        labels = components(links.union(last))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("least"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2", "text_hash").join(named, ["h1", "h2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def drop_copies(df: DataFrame, params: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, less all but one of each group.

    Of rows that repeat an id and text one stays.  Rows without an id and rows
    without words stay, for nothing links them.  Other columns may have any
    names.
    """
    verdicts = saved(near_duplicates(df, params, id_col, text_col), "verdicts")
    kept = verdicts.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    own_id, own_hash = unused(df.columns, "kept_id", "kept_hash")
    once, more = (kept.where(x).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)) for x in ("n = 1 or doc_id is null", "n > 1 and doc_id is not null"))

    def these(ids: DataFrame) -> DataFrame:
        mine = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)) & F.xxhash64(F.col(f"`{text_col}`")).eqNullSafe(F.col(own_hash))
        return df.join(ids, mine, "left_semi")

    if more.isEmpty():
        return these(once)
    return these(once).unionByName(these(more).dropDuplicates([id_col, text_col]))


def _mixed(rest: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The members of buckets that still hold different groups, with their group's ``label``."""
    labelled = rest.select("key", "rep", "size", "hub").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return saved(labelled.join(mixed, "key", "left_semi").distinct(), "mixed", rows=most)


def _stars(rest: DataFrame, p: NearDup, done: int) -> DataFrame:
    """Pairs ``a < b`` of each bucket's further centres and what is of another group."""
    out = None
    for k in range(p.centres):
        turn = F.xxhash64(F.col("key"), F.lit(done * p.centres + k))
        centres = rest.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(turn)).alias("least")).select("key", F.col("least").bitwiseXOR(turn).alias("hub"))
        whose = rest.select("key", F.col("rep").alias("hub"), F.col("label").alias("own"))
        star = rest.join(centres.join(whose, ["key", "hub"]), "key").where("label <> own").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        out = star if out is None else out.union(star)
    return out


def _between(members: DataFrame, docs: DataFrame, p: NearDup) -> DataFrame | None:
    """Links ``a, b`` that join all groups with a link between members of one hub.

    With D the elements that a text or the hub has and not both, two texts
    differ by |Dx| + |Dy| - 2 |Dx & Dy|.  Texts of different groups are not
    both linked to the hub, and then a link between them takes a common element
    of D, at least as many as ``_differences`` says.  So each has one among the
    first of its D in any fixed order; the order here puts those first that no
    other group has, then those that few texts have.  Texts without one are
    left out, and the rest are compared, each with each, on what of D other
    groups have.  Which elements those are is told by bitmaps of bounded size:
    one that is full, or two elements on one bit, lets more texts through to
    the comparison and none less.
    """
    members = saved(members, "members")
    if not (most := members.count()):
        return None
    sets = _sets_of(members.select("rep").union(members.select("hub")), docs, p, 2 * most)
    both = members.join(sets.toDF("rep", "of_rep"), "rep").join(sets.toDF("hub", "of_hub"), "hub")
    diffs = saved(_differences(both, p), "differences")
    useful = diffs.select("pivot", "label", F.explode("diff").alias("e")).groupBy("pivot", "e").agg(F.count("*").alias("n_e"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    shared, often = _bitmaps(saved(useful.select("pivot", "e", (F.col("n_e") > OFTEN).alias("often")), "useful"))
    first = _first_parts(diffs, shared, often)
    # A list serves two far texts by their strong parts, or a far one and a near one's strong part.
    lists = first.groupBy("pivot", "e").agg(
        F.expr("min(label) filter (where far and strong)").alias("low"),
        F.expr("max(label) filter (where far and strong)").alias("high"),
        F.expr("bool_or(not far) and bool_or(far)").alias("crossed"),
    )
    lists = lists.where("low < high or crossed").select("pivot", "e", F.lit(False).alias("often"))
    rows = saved(_active(diffs, shared, often, _bitmaps(saved(lists, "lists"))[0]), "active", rows=8 * most)
    share = F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum(F.size("diff")) / (p.block << 9))).cast("int")
    dealt = rows.join(rows.groupBy("pivot").agg(share.alias("blocks")), "pivot").withColumn("mine", F.expr("cast(pmod(xxhash64(row), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    workers_see_us(docs.sparkSession)
    cells = dealt.select("pivot", "i", "j", "mine", "rep", "label", "n", "d", "diff").groupBy("pivot", "i", "j")
    return saved(cells.applyInArrow(lambda cell: _compared(cell, p.percent), "a long, b long").distinct(), "between")


def _differences(both: DataFrame, p: NearDup) -> DataFrame:
    """D of each ``rep`` to its ``hub``, and how many of its first elements count.

    With q = 100 - percent and Q = 100 + percent, a pair is linked if Q times
    what it differs by is at most q times its sizes' sum.  ``far``: not linked
    to the hub.  ``strong`` first elements of D hold a common one if the other
    text is far, ``weak`` whatever the other text is.
    """

    def make():
        q, big = 100 - p.percent, 100 + p.percent

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for rep, label, x, h in zip(batch.column("rep").to_pylist(), batch.column("label").to_pylist(), batch.column("of_rep"), batch.column("of_hub"), strict=True):
                x, h = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)
                diff = np.setxor1d(x, h, assume_unique=True)
                n, d = len(x), len(diff)
                excess, far = big * d - q * n, big * d - q * n > q * len(h)
                need = -(-(excess + q * len(h) + 1) // (2 * big))
                least = -(-(excess - q * len(h)) // 200) if far else need
                with np.errstate(over="ignore"):
                    pivot, row = (mix(mix(s).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0] for s in (h, x))
                out.append((int(pivot), int(row), rep, label, n, d, far, d - max(need, least) + 1, d - least + 1, diff.view(np.int64)))
            yield pa.record_batch([pa.array(list(c)) if k < 9 else pa.array(list(c), pa.list_(pa.int64())) for k, c in enumerate(zip(*out, strict=True))], ["pivot", "row", "rep", "label", "n", "d", "far", "strong", "weak", "diff"])

        return step

    return map_batches(both, make, "pivot long, row long, rep long, label long, n long, d long, far boolean, strong long, weak long, diff array<long>")


#: Bits of a bitmap of elements: 32 for each of them, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25
#: An element that more texts of a hub have than this is looked at last.
OFTEN = 64


def _places(pivot: np.ndarray, e: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(pivot.view(np.uint64) ^ mix(e.view(np.uint64))) & np.uint64(bits - 1)).astype(np.int64)


def _bitmaps(elements: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Flags of all ``pivot, e`` of a written table, and of those that are ``often``."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * elements.count()).bit_length()))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = _places(batch.column("pivot").to_numpy(), batch.column("e").to_numpy(), bits)
            often = batch.column("often").to_numpy(zero_copy_only=False)
            for kind, places in ((0, at), (1, at[often])):
                words = np.zeros(bits // 32, np.uint32)
                np.bitwise_or.at(words, places >> 5, np.uint32(1) << (places & 31).astype(np.uint32))
                some = np.flatnonzero(words)
                yield pa.record_batch([pa.array(np.full(len(some), kind)), pa.array(some), pa.array(words[some].astype(np.int64))], ["kind", "word", "bits"])

        return step

    got = map_batches(elements, make, "kind long, word long, bits long").groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most bits / 32 rows of each kind
    out = []
    for kind in (0, 1):
        own, words = got[got["kind"] == kind], np.zeros(bits // 32, "<u4")
        words[own["word"].to_numpy(np.int64)] = own["bits"].to_numpy(np.int64).astype(np.uint32)
        out.append(words)
    return out[0], out[1]


def _flagged(words: np.ndarray, pivot: np.ndarray, e: np.ndarray) -> np.ndarray:
    at = _places(pivot, e, 32 * len(words))
    return (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def _ordered(batch: pa.RecordBatch, shared: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, element and place (from 1) in its row's order of each shared element of D."""
    lists = batch.column("diff")
    offsets = lists.offsets.to_numpy()
    e, sizes = lists.flatten().to_numpy(), np.diff(offsets)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    pivot = batch.column("pivot").to_numpy()[row]
    keep = _flagged(shared, pivot, e)
    row, e, pivot = row[keep], e[keep], pivot[keep]
    order = np.lexsort((mix(e.view(np.uint64)), _flagged(often, pivot, e), row))
    row, e = row[order], e[order]
    many = np.bincount(row, minlength=batch.num_rows)
    begun = np.cumsum(many) - many
    at = batch.column("d").to_numpy()[row] - many[row] + np.arange(len(row)) - begun[row] + 1
    return row, e, at


def _first_parts(diffs: DataFrame, shared: np.ndarray, often: np.ndarray) -> DataFrame:
    """``pivot, e, label, far, strong``: the shared elements among the first of each D that count."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            row, e, at = _ordered(batch, shared, often)
            keep = at <= batch.column("weak").to_numpy()[row]
            row, e, at = row[keep], e[keep], at[keep]
            take = pa.array(row)
            yield pa.record_batch([batch.column("pivot").take(take), pa.array(e), batch.column("label").take(take), batch.column("far").take(take), pa.array(at <= batch.column("strong").to_numpy()[row])], ["pivot", "e", "label", "far", "strong"])

        return step

    return map_batches(diffs, make, "pivot long, e long, label long, far boolean, strong boolean")


def _active(diffs: DataFrame, shared: np.ndarray, often: np.ndarray, listed: np.ndarray) -> DataFrame:
    """The texts with one of the listed elements among their first, with all their shared ones."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            row, e, at = _ordered(batch, shared, often)
            hit = (at <= batch.column("weak").to_numpy()[row]) & _flagged(listed, batch.column("pivot").to_numpy()[row], e)
            active = np.zeros(batch.num_rows, bool)
            active[row[hit]] = True
            kept = np.flatnonzero(active)
            mine = active[row]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=batch.num_rows)[kept])]).astype(np.int32)
            diff = pa.ListArray.from_arrays(pa.array(offsets), pa.array(e[mine]))
            names = ["pivot", "row", "rep", "label", "n", "d"]
            yield pa.record_batch([*(batch.column(c).take(pa.array(kept)) for c in names), diff], [*names, "diff"])

        return step

    return map_batches(diffs, make, "pivot long, row long, rep long, label long, n long, d long, diff array<long>")


def _compared(cell: pa.Table, percent: int) -> pa.Table:
    """Links between the two blocks of a cell, one for each two groups they join."""
    mine, rep, label, n, d = (cell.column(c).to_numpy() for c in ("mine", "rep", "label", "n", "d"))
    lists = cell.column("diff").combine_chunks()
    row, values = np.repeat(np.arange(len(rep)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    if (i := cell.column("i")[0].as_py()) == (j := cell.column("j")[0].as_py()):
        left = right = np.arange(len(rep))
    else:
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    place = np.zeros(len(rep), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    at = np.unique(values, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):
        a, b = np.searchsorted(at, [start, start + 2048])
        which, column = row[a:b], at[a:b] - start
        sides = []
        for size, own in ((len(left), mine[which] == i), (len(right), mine[which] == j)):
            side = np.zeros((size, 2048), np.float32)
            side[place[which[own]], column[own]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    apart = d[left][:, None] + d[right][None] - 2 * common.astype(np.int64)
    linked = ((100 + percent) * apart <= (100 - percent) * (n[left][:, None] + n[right][None])) & (label[left][:, None] != label[right][None])
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for x, y in np.argwhere(linked).tolist():
        x, y = left[x], right[y]
        a, b = root(int(label[x])), root(int(label[y]))
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
