import random
import re

import numpy as np

from leafmill.llm import entry, minhash, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}


def brute(rows, percent=85):
    """Component of each id by looking at all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((top(a), top(b)))
                    label[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert as_dict(entry.op2_minhash_dedup(spark, sf_dir)) == brute(rows)


def chains(rng):
    """Texts that differ step by step, so that the ends of a chain are not alike."""
    out = []
    for _ in range(6):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 7, 80, 300]))]
        for _ in range(rng.randrange(2, 30)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = f"W{rng.randrange(400)}"
    rng.shuffle(out)
    return [*enumerate(out), *((1000 + i, t) for i, t in enumerate(["", None, " \n", "a b", "A b", "a  b\n"]))]


def test_chains_and_large_buckets(spark):
    for seed in range(2):
        rows = chains(random.Random(seed))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert as_dict(minhash.near_duplicates(df)) == brute(rows)


def templated(rng, n=300, pairs=40, words=400, edits=4):
    """One template's texts, most below the threshold to each other, with pairs above it."""
    base, out, fresh = [f"t{i}" for i in range(words)], [], iter(range(10**6))
    for i in range(n):
        places = rng.sample(range(0, words, 5), edits)
        text = [f"u{next(fresh)}" if p in places else w for p, w in enumerate(base)]
        out.append(" ".join(text))
        if i < pairs:
            others = [places[0], *rng.sample([p for p in range(0, words, 5) if p not in places], edits - 1)]
            out.append(" ".join(text[p] if p == places[0] else f"u{next(fresh)}" if p in others else w for p, w in enumerate(base)))
    rng.shuffle(out)
    return list(enumerate(out))


def test_all_pairs_of_a_large_templated_group(spark):
    rows = templated(random.Random(3))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for params in (minhash.NearDup(), minhash.NearDup(block=50)):
        assert as_dict(minhash.near_duplicates(df, params)) == want


def test_edges(edges, empty):
    rows = minhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    assert {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id == 5} == {(1, 4, False)}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert all(r.kept and not r.n_shingles for r in rows if r.doc_id in (1, 2, 3))
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_copies(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert minhash.drop_copies(edges.where("doc_id = 5")).count() == 1


def test_signatures():
    own = minhash.Signer(4, 3)
    values = np.unique(words.stream(3, 50))
    bins = ((words.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(12)).astype(int)
    got = own.signature(values)
    assert all(got[b] == values[bins == b].min() for b in set(bins.tolist()))
    assert set(own.signature(values[:2]).tolist()) <= set(values[:2].tolist())


def test_other_columns_may_have_any_names(spark):
    rows = [(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (3, "another text of its own", 5, 6)]
    kept = minhash.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, kept_id int, _kept_hash int"))
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
