import numpy as np
import pytest

from lumenfold.llm.hard_negatives import OP11_SQL, Piece, mine, op11_hard_negatives, spanning_tree, walk_order
from oracle import differences

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50):
    """Plain loops over {(id, vector, label)}."""
    x = {i: ((n + 1) % 10 if i % 7 == 0 else n, [int(np.floor(256 * c)) for c in v]) for i, v, n in rows}
    out = set()
    for a, (label, v) in x.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, n) for i, (n, w) in x.items() if i != a)
        for s, p, _ in [r for r in scores if r[2] == label][:5]:
            fits = [r for r in scores if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits[:3])}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(seed, n=600, wide=8, far=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, wide))
    return [(i, (centres[i % 6] + rng.normal(size=wide) * rng.choice([0.02, far])).tolist(), int(rng.integers(0, 10))) for i in range(n)]


def test_same_as_sql(spark):
    assert differences(op11_hard_negatives(spark, SF), OP11_SQL, SF) == []


@pytest.mark.parametrize("grove, piece", [(4, 64), (2048, 16384), (1, 7)])
def test_same_as_brute_force_whatever_the_blocks(spark, grove, piece):
    rows = clustered(1)
    assert found(mine(spark.createDataFrame(rows, KIND), every=10, grove=grove, piece=piece)) == brute(rows, 10)


def test_bounds_save_scores_and_hold():
    rows = clustered(2, n=3000, far=0.05)
    x = np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64)
    labels = np.array([r[2] for r in rows])
    asked = x[::10].astype(np.float64)
    parent, edge = spanning_tree(asked)
    order, last = walk_order(parent)
    piece = Piece(np.arange(len(x)), labels, x)
    most = 0
    for a in order:
        lo, hi = piece.bounds(x[a * 10], int(parent[a]), float(edge[a]))
        true = x @ x[a * 10]
        assert (lo <= true).all() and (true <= hi).all()
        piece.positives(a * 10, int(labels[a * 10]), x[a * 10], lo, hi, 5)
        piece.negatives(int(labels[a * 10]), x[a * 10], lo, hi, [(0, 10)], 3)
        piece.keep(a, int(parent[a]), last[a], lo, hi)
        most = max(most, len(piece.kept))
    assert most <= 10 and piece.scored < len(order) * len(x) // 2


def test_ties_repeated_rows_and_equal_vectors(spark):
    rows = [(i, [1.0, 0.5] if i % 3 else [0.6, 0.5], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:40], KIND)
    assert found(mine(df, every=10, grove=5, piece=32)) == brute(rows, 10)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 2e5).tolist(), int(i % 3)) for i in range(150)]
    assert max(s[4] for s in brute(rows, 10)) > 1 << 53
    assert found(mine(spark.createDataFrame(rows, KIND), every=10, grove=6, piece=50)) == brute(rows, 10)


def test_defined_cases(spark):
    rows = clustered(3, n=120, wide=3)
    odd = [(1000, None, 1), (1050, [1.0, None, 2.0], 1), (1100, [1.0, float("nan"), 1.0], 1), (1150, [float("inf"), 1.0, 1.0], 1), (1200, [1.0, 2.0], 1), (1250, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (1300, [1e300, 0.0, 0.0], 1)]
    zero = [(1350, [0.0, 0.0, 0.0], 2), (1351, [0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd + zero], KIND + ", rank int, piece string")
    assert found(mine(df)) == brute(rows + zero)
    assert mine(df.limit(0)).count() == 0
    assert mine(df.filter("vec_id % 50 <> 0")).count() == 0
