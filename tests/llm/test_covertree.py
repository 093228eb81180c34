import numpy as np
import pytest

from veilgraph.llm import covertree


def brute(ids, values, queries, k, own=True):
    """queries: positions in ids and values; own leaves the query's row out."""
    out = []
    for at in queries:
        q, v = ids[at], values[at]
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(zip(ids, values, strict=True)) if not (own and j == at) and len(w) == len(v)))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def clustered(n, dim, seed=0, spread=20):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-500, 500, (12, dim))
    return centres[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, (n, dim))


@pytest.mark.parametrize("spread", [0, 20, 900])
def test_dual_tree(spread):
    values = clustered(3000, 6, spread=spread)
    ids = np.arange(3000) * 3 - 50
    tree = covertree.Tree.load(covertree.Tree.build(ids, values).dump())
    assert sorted(tree.ids) == sorted(ids)
    for k in range(len(tree.lo)):  # the covering invariant
        points, centre = tree.values[tree.lo[k] : tree.hi[k]], tree.values[tree.centre[k]]
        assert np.sqrt(((points - centre) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
    asked = covertree.Tree.build(ids[::50], values[::50])
    search = covertree.Search(asked, 7)
    search.meet(tree)
    got = sorted((int(q), r + 1, int(i), int(s)) for q, row, names in zip(asked.ids, search.scores, search.ids, strict=True) for r, (s, i) in enumerate(zip(row, names, strict=True)))
    assert got == brute(ids, values, range(0, 3000, 50), 7, own=False)
    if spread == 20:
        assert search.pairs_compared < 0.7 * len(ids) * len(asked.ids)  # pruning works where there are groups


def test_large_numbers():
    values = np.array([[2**30, 3], [-(2**30), 5], [2**30 - 1, 7], [0, 0]])
    search = covertree.Search(covertree.Tree.build(np.array([9]), values[:1]), 3)
    search.meet(covertree.Tree.build(np.arange(4), values))
    assert search.scores[0].tolist() == [2**60 + 9, 2**60 - 2**30 + 21, 0]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(covertree, "TILE_NUMBERS", 400)
    monkeypatch.setattr(covertree, "BLOCK_NUMBERS", 40)
    values = clustered(500, 4, 1)
    rows = [(i, [float(x) / 8 for x in v], "e") for i, v in enumerate(values.tolist())]
    rows += [(1000, [1.0, 2.0], "e"), (1100, [1.0, 3.0], "e"), (1200, [], "e"), (1300, None, "e"), (1400, [1.0, None, 2.0, 3.0], "e"), (1500, [1.0, float("nan"), 0.0, 0.0], "e"), (1600, [float("inf"), 0.0, 0.0, 0.0], "e"), (None, [1.0, 1.0, 1.0, 1.0], "e")]
    rows += [(700 + i, rows[100][1], "e") for i in range(40)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, covertree.top_k(df, df.where("vec_id % 100 = 0"), 10, scale=8).collect()))
    good = [(i, [int(np.floor(x * 8)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = brute([i for i, _ in good], [v for _, v in good], [k for k, (i, _) in enumerate(good) if i % 100 == 0], 10)
    assert got == want
    assert covertree.top_k(df.where("1 = 0"), df, 3).collect() == []


def test_repeated_ids(spark):
    """Rows that share an id with the query, or are equal to it, stay its
    candidates."""
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [3.0, 0.5]), (7, [1.0, 2.0]), (8, [-1.0, 4.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, covertree.top_k(df, df.where("vec_id % 100 = 0"), 3, scale=2).collect()))
    assert got == brute([i for i, _ in rows], [[int(np.floor(2 * x)) for x in v] for _, v in rows], [0, 1, 2], 3)


def test_large_components(spark):
    """Scores up to 63 bits are exact; what goes beyond is refused."""
    rows = [(1, [1.5e9, -1.0]), (2, [1.5e9 - 1, 3.0]), (3, [-1.5e9, 7.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, covertree.top_k(df, df, 2, scale=1).collect()))
    assert got == brute([i for i, _ in rows], [[int(np.floor(x)) for x in v] for _, v in rows], range(4), 2)
    for big in (1e15, 1e18):
        df = spark.createDataFrame([(1, [big]), (2, [big]), (3, [-big])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="63 bits"):
            covertree.top_k(df, df, 1).collect()


def test_blocks_are_sent_only_where_they_can_score(spark, monkeypatch):
    monkeypatch.setattr(covertree, "TILE_NUMBERS", 200)
    monkeypatch.setattr(covertree, "BLOCK_NUMBERS", 100)
    values = clustered(2000, 4, 2, spread=5)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values.tolist())], "vec_id long, embedding array<double>")
    sent, real = [], covertree.search_pairs
    monkeypatch.setattr(covertree, "search_pairs", lambda pairs, blocks, tiles, k, stripes: (sent.append((pairs.count(), blocks.count() * tiles.count())), real(pairs, blocks, tiles, k, stripes))[1])
    got = sorted(map(tuple, covertree.top_k(df, df.where("vec_id % 20 = 0"), 5, scale=1).collect()))
    assert got == brute(list(range(2000)), values, range(0, 2000, 20), 5)
    assert sum(n for n, _ in sent) < sent[0][1] / 4
