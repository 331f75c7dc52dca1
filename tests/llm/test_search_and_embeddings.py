"""op1 and op5 against brute force on small tables, with the odd rows the contracts name."""

import math

import numpy as np
import pytest

from ledgerlens.llm.common import components
from ledgerlens.llm.embedding_dedup import embedding_links, near_tiles
from ledgerlens.llm.tiles import LEAD, boxes, number_by_cell, principal_axes, project, second_moment
from ledgerlens.llm.topk_search import cell_topk, quantise, topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, score long, tile int"  # score, tile: clashing extras


def _vectors(seed, n=150, d=20):
    rng = np.random.RandomState(seed)
    centres = rng.randn(6, d)
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.randn(d) * rng.choice([0.05, 0.3, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3, 7, 8))
    rows[10] = (10, None, 0, 7, 8)
    rows[11] = (11, [0.0] * d, 0, 7, 8)
    rows[12] = (12, [float("nan")] * d, 0, 7, 8)
    rows[13] = (13, [float("inf")] + [1.0] * (d - 1), 0, 7, 8)
    rows[14] = (14, [None] + [1.0] * (d - 1), 0, 7, 8)
    rows[15] = (15, rows[16][1], None, None, None)  # equal vectors
    rows[17] = (17, rows[16][1], None, None, None)
    rows[18] = (18, [], 0, 7, 8)
    return rows


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_topk_equals_brute_force(spark, tile_rows):
    rows = _vectors(1)
    df = quantise(spark.createDataFrame(rows, SCHEMA))
    got = topk_search(df.where("vec_id % 20 = 0"), df, 20, tile_rows=tile_rows, query_rows=5).collect()
    ints = {r[0]: [math.floor(64 * x) for x in r[1]] for r in rows if _usable(r[1])}
    want = []
    for q in [i for i in ints if i % 20 == 0]:
        s = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q))[:20]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_large_values_and_few_candidates(spark):
    big = float(2.0 ** 20)
    df = quantise(spark.createDataFrame([(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 2.0])], "vec_id long, embedding array<float>"))
    got = topk_search(df.where("vec_id = 0"), df, 20).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert got[0].score == int(64 * big) ** 2 + 64 * 128


def test_topk_empty(spark):
    df = quantise(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk_search(df, df, 20).count() == 0


def test_cell_bounds_never_lose_a_candidate():
    rng = np.random.RandomState(3)
    c = rng.randint(-50, 50, (400, 70))
    q = rng.randint(-50, 50, (9, 70))
    a, b, s = cell_topk(q, np.arange(1000, 1009), c, np.arange(400), 7)
    for i in range(9):
        full = c @ q[i]
        top = np.lexsort((np.arange(400), -full))[:7]
        assert list(b[a == 1000 + i]) == list(top) and list(s[a == 1000 + i]) == list(full[top])


def test_cell_bounds_hold_beyond_exact_doubles():
    rng = np.random.RandomState(5)
    c = rng.randint(-2 ** 28, 2 ** 28, (600, 64))  # sums pass 2**53, products of neighbours differ by little
    c[100:400] = c[0]
    c[100:400, 63] += np.arange(300)
    q = c[:3].copy()
    a, b, s = cell_topk(q, np.arange(1000, 1003), c, np.arange(600), 9)
    for i in range(3):
        full = c @ q[i]
        top = np.lexsort((np.arange(600), -full))[:9]
        assert list(b[a == 1000 + i]) == list(top) and list(s[a == 1000 + i]) == list(full[top])


def test_floors_only_leave_out_lower_scores():
    rng = np.random.RandomState(6)
    c, q = rng.randint(-50, 50, (300, 40)), rng.randint(-50, 50, (4, 40))
    a, b, s = cell_topk(q, np.arange(1000, 1004), c, np.arange(300), 5)
    floors = np.array([s[a == 1000 + i].min() for i in range(4)], dtype=float)
    again = cell_topk(q, np.arange(1000, 1004), c, np.arange(300), 5, floors)
    assert all(np.array_equal(x, y) for x, y in zip((a, b, s), again, strict=True))
    assert not len(cell_topk(q, np.arange(1000, 1004), c, np.arange(300), 5, floors + 1e6)[0])


def test_opened_cells_grow_with_the_tiles_of_clustered_vectors(spark):
    def opened(n):
        rng = np.random.RandomState(9)
        centres = rng.randn(40, 24)
        v = centres[np.arange(n) % 40] + 0.1 * rng.randn(n, 24)
        df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "rep long, v array<double>")
        axes = principal_axes(second_moment(df, 24, units=True))
        placed = number_by_cell(project(df, axes, units=True), 0.2236, ["rep"], "at")
        tiles = boxes(placed.selectExpr("*", "floor(at / 16) tile"), "tile", LEAD)
        return tiles.count(), near_tiles(tiles, 0.9, LEAD).count()

    (t1, c1), (t2, c2) = opened(400), opened(1600)
    assert (t1, t2) == (25, 100)
    assert c1 < t1 ** 2 and c2 / t2 ** 2 < c1 / t1 ** 2 / 2, (c1, c2)  # the opened share falls as tiles get compact


@pytest.mark.parametrize("tile_rows", [2048, 13])
def test_embedding_links_equal_brute_force(spark, tile_rows):
    rows = _vectors(2)
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, SCHEMA), tile_rows=tile_rows).collect()}
    vecs = {r[0]: np.array(r[1]) for r in rows if _usable(r[1]) and any(r[1])}
    link = {i: {j for j, w in vecs.items() if j != i and len(w) == len(v)
                and float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))) >= 0.9} for i, v in vecs.items()}
    comp = {r[0]: r[0] for r in rows}
    for _ in rows:
        comp.update({i: min([comp[i], *(comp[j] for j in link[i])]) for i in sorted(link)})
    assert len(got) == len(rows)
    for r in rows:
        x = got[r[0]]
        assert (x.n_links, x.component_id, x.kept) == (len(link.get(r[0], ())), comp[r[0]], comp[r[0]] == r[0]), r[0]


def test_embedding_links_empty_and_unusable(spark):
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = embedding_links(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (700, 701)], "a long, b long").repartition(7)
    got = {r.v: r.root for r in components(edges).collect()}
    want = {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)} | {701: 700}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
