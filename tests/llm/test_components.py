import random

from leafmill.llm import components as C


def least_reached(links):
    label = {x: x for link in links for x in link}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    return {x: top(x) for x in label}


def found(spark, links, monkeypatch=None):
    rounds = []
    if monkeypatch:
        save = C.saved
        monkeypatch.setattr(C, "saved", lambda df, name, **how: rounds.append(name) or save(df, name, **how))
    rows = C.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    return {r.node: r.label for r in rows}, rounds.count("labels") - 1


def test_graphs_against_union_find(spark):
    rng = random.Random(5)
    graphs = [[(rng.randrange(60), rng.randrange(60)) for _ in range(40)] for _ in range(2)]
    graphs.append([(7, 7), (3, 9), (9, 3), (3, 9), (1, 9)])
    for links in graphs:
        want = least_reached(links)
        alone = {x for x in want if not any(x in link and len(set(link)) == 2 for link in links)}
        assert found(spark, links)[0] == {k: v for k, v in want.items() if k not in alone}
    assert found(spark, [])[0] == {}


def test_rounds_grow_with_the_logarithm_of_a_path(spark, monkeypatch):
    ids = list(range(600))
    random.Random(1).shuffle(ids)
    got, rounds = found(spark, list(zip(ids[:-1], ids[1:], strict=True)), monkeypatch)
    assert got == dict.fromkeys(range(600), 0)
    assert rounds <= 14
