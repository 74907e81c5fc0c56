import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    for anchor in sorted({i for i, _, _ in usable if i % 50 == 0}):
        _, own, label = min((r for r in usable if r[0] == anchor), key=lambda r: (r[2], r[1]))
        scored = sorted((-sum(x * y for x, y in zip(own, v)), i, l) for i, v, l in usable if i != anchor)
        for rank, (score, positive, _) in enumerate([s for s in scored if s[2] == label][:positives], 1):
            inside = [s for s in scored if s[2] != label and low * -score <= 100 * -s[0] <= high * -score]
            out += [(anchor, rank, positive, -score, n, i, -s) for n, (s, i, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def result(df):
    names = ("anchor_id", "positive_rank", "positive_id", "positive_score", "rank", "negative_id", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def clusters(n, dims=12, seed=3, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    which = rng.integers(0, 6, n)
    vectors = (centres[which] + spread * rng.normal(size=(n, dims))) * rng.uniform(0.1, 3, n)[:, None]
    return [(i, [float(x) for x in v], int(w + (i % 5 == 0)) % 6) for i, (v, w) in enumerate(zip(vectors, which))]


@pytest.mark.parametrize("block", [40, 8192])
def test_same_as_brute_force(spark, block):
    rows = clusters(700)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(200)]  # copies, ties
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, block=block, anchor_block=block)
    expected = brute(rows)
    assert len(expected) > 100 and result(got) == expected


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.5, 0.5], 1), (50, None, 1), (100, [1.0, None], 1), (150, [nan, 1.0], 1), (200, [1.0, inf], 1), (250, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(300, [], 1), (350, [0.0, 0.0], 2), (400, [-1.0, -1.0], 2), (450, [-1.0, 1.0], 2), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.7, 0.2], 2), (3, [0.7, 0.2], 2), (3, [0.7, 0.2], 2), (4, [0.5], 3), (5, [3e4, 2e4], 3), (500, [2e4, 3e4], 3), (6, [1.5e4, 1e4], 4)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id as e", "label as asks", "vec_id as norm", "1 as angles", "2 as cell", "3 as block", "4 as rank")
    assert result(hn.hard_negatives(frame, F.col("vec_id") % 50 == 0)) == brute(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_skip():
    rows = clusters(400, spread=0.1)
    vectors = np.array([np.floor(256 * np.array(v)) for _, v, _ in rows]).astype(np.int64)
    references = hn.choose_references(vectors[:64])
    norms, angles = hn.angles_to(references, vectors)
    lower, upper = hn.score_bounds(norms, angles, norms, angles)
    scores = vectors @ vectors.T
    assert (lower <= scores).all() and (scores <= upper).all()
    # well apart from each other, most pairs of different clusters are settled by their stored angles
    assert (upper < 0.9 * norms[:, None] * norms[None, :]).mean() > 0.5


def test_far_blocks_do_not_meet(spark):
    """Rows around two directions at right angles: no block of the one meets anchors of the other."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        v = np.zeros(8)
        v[i % 2] = 1
        rows.append((i, [float(x) for x in v + 0.01 * rng.normal(size=8)], (i // 2) % 3))
    met = []
    meeting = hn._meeting
    try:
        hn._meeting = lambda *a: met.append(meeting(*a)) or met[0]
        got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, references=2, low=70, high=99)
        assert result(got) == brute(rows, low=70, high=99)
    finally:
        hn._meeting = meeting
    assert met[0].count() == 1  # anchors have even ids: one cell of two
