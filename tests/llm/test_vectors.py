"""Whitening and embedding near-dedup against brute force with whole matrices, and on odd tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.llm import neighbours
from penstock.llm.neighbours import near_neighbours, op13_embedding_dedup
from penstock.llm.whitening import feast, intervals, op11_whitening, principal, whiten

SF = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<float>, label int"


def embeddings(path=SF):
    return duckdb.sql(f"select vec_id, embedding, label from '{path}/embeddings.parquet'").fetchall()


# whitening


def whitened_by_force(vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return exact, (x - sums / n) @ u / np.sqrt(e), e / np.trace(np.cov(x.T, bias=True))


def test_whitening_whole_table(spark):
    rows = embeddings()
    exact, white, explained = whitened_by_force([r[1] for r in rows])
    got = {}
    for r in op11_whitening(spark, SF).collect():
        assert r.n == len(rows) and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r
    signs = np.sign([got[rows[0][0]][k + 1].whitened * white[0][k] for k in range(32)])
    for (vec, _, _), deviation, row in zip(rows, exact, white, strict=True):
        mine = [got[vec][k] for k in range(1, 33)]
        assert {m.deviation for m in mine} == {deviation}
        np.testing.assert_allclose([m.whitened for m in mine], row * signs, atol=1e-9)
        np.testing.assert_allclose([m.explained for m in mine], explained, rtol=1e-12)


@pytest.mark.parametrize("d, rank", [(1, 1), (5, 3), (40, 40), (64, 9), (120, 120)])
def test_eigenvectors_by_force(d, rank):
    a = np.random.default_rng(d).standard_normal((d, rank))
    v = a @ a.T
    if d == 40:  # every eigenvalue ten times
        v = a @ np.diag(np.repeat([4.0, 3.0, 2.0, 1.0], 10)) @ np.linalg.inv(a)
        q, _ = np.linalg.qr(a)
        v = q @ np.diag(np.repeat([4.0, 3.0, 2.0, 1.0], 10)) @ q.T
        v = (v + v.T) / 2
    e, x = principal(v, 32)
    want = np.linalg.eigvalsh(v)[::-1]
    assert len(e) == min(32, rank)
    np.testing.assert_allclose(e, want[: len(e)], rtol=1e-12)
    np.testing.assert_allclose(v @ x, x * e, atol=1e-11 * want[0])
    np.testing.assert_allclose(x.T @ x, np.eye(len(e)), atol=1e-12)


def test_missed_eigenvalue_is_noticed():
    with pytest.raises(ArithmeticError):
        feast(np.diag([1.0, 2.0, 3.0]), 0.5, 2.5, 3, 1e-12)
    assert intervals((np.array([1.0, 2.0, 3.0]), np.zeros(2)), 0.0, 4.0, 3) == [(0.0, 4.0, 3)]


def test_whitening_odd_rows(spark):
    good = [(i, [float(np.sin(7 * i + j)) for j in range(3)], 1) for i in range(20)]
    odd = [(50, None, 1), (51, [1.0, None, 2.0], 1), (52, [1.0, float("nan"), 2.0], 1), (53, [float("inf"), 0.0, 0.0], 1), (54, [1.0], 1), (55, [], 1)]
    frame = spark.createDataFrame([*good, *odd, good[3], (None, [0.5, 0.5, 0.5], None)], SHAPE)
    frame = frame.selectExpr("*", "1 as vec", "2 as x", "3 as n", "'y' as part").repartition(3)
    got = whiten(frame).collect()
    exact, white, explained = whitened_by_force([*[np.float32(r[1]) for r in good], np.float32(good[3][1]), [0.5] * 3])
    assert sorted(r.vec for r in got if r.vec is not None) == sorted([*range(20), 3]) and len(got) == 22
    held = {r.vec: r for r in got}
    for vec in range(20):
        assert held[vec].deviation == exact[vec]
        np.testing.assert_allclose(np.abs(held[vec].whitened), np.abs(white[vec]), atol=1e-9)
    np.testing.assert_allclose(held[0].explained, explained, rtol=1e-10)
    assert held[None].n == 22
    # equal vectors and a single one have no component
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SHAPE)).collect()
    assert [(len(r.whitened), r.deviation, r.identity_error) for r in same] == [(0, 0, 0.0)] * 2
    for none in (frame.limit(0), frame.where("vec_id = 50"), frame.where("vec_id = 55")):
        assert whiten(none).count() == 0
    # deviations beyond a long are null, those beyond a machine square are exact
    huge = whiten(spark.createDataFrame([(1, [0.0], 1), (2, [2.0**25], 1), (3, [2.0**40], 1), (4, [2.0**24], 1)], "vec_id long, embedding array<double>, label int"))
    x = [int(64 * c) for c in (0, 2**25, 2**40, 2**24)]
    assert {r.vec: r.deviation for r in huge.collect()} == {i + 1: d if (d := (4 * c - sum(x)) ** 2) < 2**63 else None for i, c in enumerate(x)}


# near-dedup


def links_by_force(rows, least=0.93):
    """(links per row, component per row) of (vec, vector, label)."""
    links = [set() for _ in rows]
    unit = []
    for vec, v, label in rows:
        sound = v and vec is not None and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if sound else None)
    for i, (_, _, label) in enumerate(rows):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and label == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i].add(j)
                links[j].add(i)
    component = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, some in enumerate(links):
            for j in [*some, *[k for k, r in enumerate(rows) if r[0] is not None and r[0] == rows[i][0]]]:
                if component[j] is not None and component[i] is not None and component[j] < component[i]:
                    component[i], changed = component[j], True
    return [len(some) for some in links], component


def clusters(seed, groups, size, noise, d=16):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = draw.standard_normal(d)
        centre /= np.linalg.norm(centre)
        rows += [(100 * g + i, (3 * (centre + noise * draw.standard_normal(d) / d**0.5)).astype(np.float32).tolist(), g % 2) for i in range(size)]
    return rows


@pytest.mark.parametrize("block", [7, neighbours.BLOCK])
def test_groups_by_force(spark, block):
    """Tight groups come out as by force, in blocks as well; nothing is counted twice."""
    rows = clusters(1, 12, 25, 0.12)
    want, component = links_by_force(rows)
    assert max(want) == 24
    got = {r.vec: r for r in near_neighbours(spark.createDataFrame(rows, SHAPE), block=block).collect()}
    assert {v: r.n_links for v, r in got.items()} == {r[0]: n for r, n in zip(rows, want, strict=True)}
    assert {v: r.component for v, r in got.items()} == {r[0]: c for r, c in zip(rows, component, strict=True)}


def test_recall_at_the_edge(spark):
    """Of pairs near the least cosine nearly all are found, and none below it."""
    rows = clusters(2, 20, 20, 0.3, d=64)
    want, _ = links_by_force(rows)
    got = {r.vec: r.n_links for r in near_neighbours(spark.createDataFrame(rows, SHAPE)).collect()}
    assert all(got[r[0]] <= n for r, n in zip(rows, want, strict=True))
    assert 0 < sum(want) < 20 * 20 * 19 and sum(got.values()) >= 0.97 * sum(want)


def test_dedup_whole_table(spark):
    rows = embeddings()
    want, component = links_by_force(rows)
    got = {r.vec_id: r for r in op13_embedding_dedup(spark, SF).collect()}
    assert [(got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) for r in rows] == [(n, c, c == r[0]) for r, n, c in zip(rows, want, component, strict=True)]


def test_dedup_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [-1.0, 2.0, 0.0, 0.5]
    rows = [
        (5, v, 1), (3, v, 1), (9, [2 * c for c in v], 1), (4, v, 2), (6, v, None), (7, None, 1), (8, [0.0] * 4, 1), (10, [1.0, None, 3.0, 4.0], 1),
        (11, [1.0, float("nan"), 3.0, 4.0], 1), (12, [float("inf"), 0.0, 0.0, 0.0], 1), (13, v[:3], 1), (14, [], 1), (None, v, 1), (15, w, 1), (15, v, 1),
        (16, [-0.0, 1.0, 0.0, 0.0], 1), (17, [0.0, 1.0, 0.0, 0.0], 1), (18, [1e-30, 2e-30, 3e-30, 4e-30], 1), (19, w, 1), (19, w, 1),
    ]
    frame = spark.createDataFrame(rows, SHAPE)
    frame = frame.select("*", *[F.lit("z").alias(c) for c in ("vec", "key", "node", "n", "x", "g", "ends", "i")]).repartition(3)
    want, component = links_by_force(rows)
    got = sorted((r.vec if r.vec is not None else -1, r.n_links, r.component) for r in near_neighbours(frame).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, n, c) for r, n, c in zip(rows, want, component, strict=True))
    assert near_neighbours(frame.limit(0)).count() == 0
