"""Hard negatives against their SQL on tables with ties, repeated rows, odd vectors and clusters; the bounds themselves."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from phasegrid.llm import negatives
from phasegrid.llm.queries import ORACLE, QUERIES

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("label", pa.int32())])


def agrees(spark, tmp_path, rows, name="embeddings"):
    """The query and its SQL over the same file give the same rows."""
    table = pa.Table.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA)
    table = table.append_column("score", pa.array(["x"] * len(rows))).append_column("part", pa.array([1] * len(rows)))
    import pyarrow.parquet as pq

    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(ORACLE["op13_hard_negatives"]).fetchall()
    got = [tuple(r) for r in QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    return got


def clustered(n, seed, dim=32, clusters=6):
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.normal(size=(clusters, 8)), dim // 8, axis=1)
    return [(i, (centres[i % clusters] + 0.05 * rng.normal(size=dim)).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_over_several_blocks(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", 5)
    assert len(agrees(spark, tmp_path, clustered(900, seed))) > 100


def test_ties_repeats_and_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    grid = [0.0, 0.5, 0.25, -0.5, 1.0]
    rows = [(i, [rng.choice(grid) for _ in range(3)], rng.randrange(3)) for i in range(260)]
    rows += rows[50:53] * 4 + [(100, [0.5, 0.5, 0.5], 1)] * 3 + [(300 + i, [1.0, 1.0, 1.0], i % 2) for i in range(80)]
    rows += [(400, None, 1), (450, [float("nan"), 0.0, 1.0], 1), (500, [float("inf"), 0.0, 0.0], 1), (550, [None, 0.1, 0.2], 1), (600, [0.1, 0.1, 0.1], None)]
    rows += [(None, [9.0, 9.0, 9.0], 1), (650, [], 1), (651, [], 2), (652, [], 1), (700, [0.5, 0.5], 1), (701, [0.5, 0.25], 2), (702, [0.5, 0.5], 1)]
    rows += [(750, [0.0, 0.0, 0.0], 1), (800, [-1.0, -1.0, -1.0], 8), (801, [-1.0, -1.0, -1.0], 8)]
    got = agrees(spark, tmp_path, rows)
    assert {100, 350, 650} <= {r[0] for r in got} and not {400, 450, 500, 550, 600} & {x for r in got for x in (r[0], r[1], r[3])}


def test_empty_one_label_and_no_anchor(spark, tmp_path):
    for rows in ([], [(i, [1.0, 0.0], 1) for i in range(0, 50, 2)], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert agrees(spark, tmp_path, rows) == []


def test_scores_that_no_long_holds_raise(spark):
    rows = spark.createDataFrame([(0, 1, [1e60]), (1, 1, [1e60])], "id long, label long, vector array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        negatives.hard_negatives(rows).collect()
    wide = spark.createDataFrame([(0, 1, [2.0**21, 0.0]), (1, 1, [2.0**23, 1.0]), (2, 2, [2.0**22, 3.0])], "id long, label long, vector array<double>")
    assert [tuple(r) for r in negatives.hard_negatives(wide).collect()] == [(0, 1, 1, 2, 2**60, 2**59)]


def packed(rows):
    ids, vectors, labels = zip(*rows)
    return negatives.Rows(negatives._block(0, ids, ids, labels, np.floor(np.array(vectors) * negatives.SCALE)) | {"part": 0})


@pytest.mark.parametrize("dim", [8, 13, 64])
def test_bounds_hold_and_leave_few_pairs_of_clusters(dim, monkeypatch):
    monkeypatch.setattr(negatives, "SPARSE", 1.0)
    rng = np.random.default_rng(dim)
    a = packed([(i, rng.normal(size=dim), 0) for i in range(40)])
    exact = a.vectors @ a.vectors.T
    for means, deviations, sizes in a.levels:
        middle, reach = (means * sizes) @ means.T, deviations @ deviations.T + 1
        assert (middle - reach <= exact).all() and (exact <= middle + reach).all()
    b = packed(clustered(600, dim, clusters=25))
    every = np.arange(600)
    exact = b.vectors @ b.vectors.T
    least = np.sort(exact, axis=1)[:, -30]
    x, y = negatives.left_by_bounds(b, every, b, every, least, np.full(600, 1 << 60))
    held = np.zeros(exact.shape, bool)
    held[x, y] = True
    assert held[exact >= least[:, None]].all()
    assert held.mean() < 0.25
