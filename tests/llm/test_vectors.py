"""Vector operators against brute force, on clustered vectors with planted near copies and odd rows."""

import math

import numpy as np
import pytest

from floorledger.llm import graph_dedup, multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, v int, score string, cluster int"
D = 24


def make():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, D))
    x = (centre[rng.integers(0, 6, 700)] + rng.normal(size=(700, D))).astype(np.float32)
    near = (x[rng.integers(0, 200, 120)] * (1 + rng.normal(size=(120, 1)) * 0.1) + rng.normal(size=(120, D)) * 0.02).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near, np.repeat(x[:1], 40, axis=0)]))]
    odd = [(5000, None), (5001, [0.0] * D), (5002, [math.nan] * D), (5003, [None] + [1.0] * (D - 1)), (5004, [1.0, 2.0]), (5005, [math.inf] * D), (5100, []), (None, rows[0][1])]
    return rows, odd


ROWS, ODD = make()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, v, 1, 2, 3, "s", 4) for i, v in [*ROWS, *ODD, ROWS[7]]], SCHEMA).repartition(3).cache()


def test_multi_index_finds_the_nearest(frame):
    got = multi_index.search(frame, frame.where("vec_id % 100 = 0")).collect()
    ids, x = np.array([i for i, _ in ROWS]), np.array([v for _, v in ROWS], dtype=np.float32).astype(float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(order))
        total += 10
    assert {r.query_id for r in got} == set(ids[ids % 100 == 0].tolist()) and hit / total >= 0.9
    first = sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)
    assert [r.vec_id for r in first] == list(range(820, 830))  # copies of the query, by id


def test_multi_index_with_few_or_no_rows(frame, spark):
    few = frame.where("vec_id in (0, 1, 2)")
    assert multi_index.search(few, few.where("vec_id = 0")).count() == 2
    assert multi_index.search(frame.limit(0), frame.limit(0)).count() == 0


def exact(rows, threshold=0.9):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    c = x @ x.T >= threshold
    np.fill_diagonal(c, False)
    return c


def test_graph_dedup_finds_the_links(frame, monkeypatch):
    c = exact(ROWS)
    for shard in (graph_dedup.SHARD, 150):  # one shard; several, some split
        monkeypatch.setattr(graph_dedup, "SHARD", shard)
        monkeypatch.setattr(graph_dedup, "CENTROIDS", 4)
        out = graph_dedup.dedup(frame).collect()
        assert len(out) == len(ROWS) + len(ODD) + 1
        got = {r.vec_id: r for r in out}
        n = np.array([got[i].n_links for i, _ in ROWS])
        assert (n <= c.sum(1)).all() and n.sum() >= 0.97 * c.sum()
        assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
        assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in ODD if i is not None)
        assert got[820].component_id == 0 and got[820].n_links >= 40
    assert graph_dedup.dedup(frame.limit(0)).count() == 0


def test_graph_of_a_shard_reaches_near_copies():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 48))
    x = np.concatenate([x, x[:150] + rng.normal(size=(150, 48)) * 0.05, x[:1] + rng.normal(size=(200, 48)) * 0.1])
    x /= np.sqrt((x * x).sum(1))[:, None]
    adj, medoid = graph_dedup.build(x)
    q, node = graph_dedup.range_search(x, adj, medoid, x, np.full(len(x), -1), 0.2)
    c = x @ x.T >= 0.9
    found = {(min(a, b), max(a, b)) for a, b in zip(q.tolist(), node.tolist()) if a != b}
    want = {(a, b) for a, b in zip(*map(lambda v: v.tolist(), np.nonzero(np.triu(c, 1))))}
    assert found <= want and len(found) >= 0.97 * len(want)


def planted(n, m, d, seed=1):
    """n unit vectors without structure, and m partners of some at a cosine of 0.9 to 0.93."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.sqrt((x * x).sum(1))[:, None]
    a, w = x[:m], rng.normal(size=(m, d))
    w -= (w * a).sum(1)[:, None] * a
    w /= np.sqrt((w * w).sum(1))[:, None]
    cos = rng.uniform(0.9001, 0.93, size=(m, 1))
    return np.concatenate([x, cos * a + np.sqrt(1 - cos * cos) * w])


def test_asked_covers_every_pair():
    from floorledger.llm.vectors import centroids, distances

    x = planted(1500, 800, 32)
    c = centroids(x, 60)
    d = distances(x, c)
    home = np.argmin(d, axis=1)
    reach = np.array([np.sqrt(d[home == j, j].max(initial=0)) for j in range(len(c))])
    ok = graph_dedup.asked(x, home, c, reach, 0.9)
    i, j = np.nonzero(x @ x.T >= 0.9)
    cross = home[i] > home[j]
    assert cross.sum() > 100 and ok[i[cross], home[j[cross]]].all()


def test_graph_dedup_finds_the_links_of_many_shards(spark, monkeypatch):
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(planted(1200, 600, 32))]
    c = exact(rows)
    monkeypatch.setattr(graph_dedup, "SHARD", 40)  # 90 centroids
    df = spark.createDataFrame([(i, v, 1, 2, 3, "s", 4) for i, v in rows], SCHEMA).repartition(3).cache()
    for sizes in ({}, {"HELD": 15, "ASKING": 500}):  # one task; many, of centroids in several pieces
        for name, size in sizes.items():
            monkeypatch.setattr(graph_dedup, name, size)
        got = {r.vec_id: r.n_links for r in graph_dedup.dedup(df).collect()}
        n = np.array([got[i] for i, _ in rows])
        assert (n <= c.sum(1)).all() and n.sum() >= 0.995 * c.sum()
