"""op11: exact results against comparisons of all pairs, and against its SQL."""

import numpy as np
import pytest


def plain(rows, anchors, positives=5, negatives=3):
    """Rows (vec_id, label, integers), a row a vec_id."""
    out = set()
    for a, label, v in rows:
        if a not in anchors:
            continue
        clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
        scored = sorted((-clip(sum(x * y for x, y in zip(v, w, strict=True))), b, m) for b, m, w in rows if b != a and len(w) == len(v))
        for p, b, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(n, c) for n, c, m in scored if m != label and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out |= {(a, b, i + 1, c, -p, -n) for i, (n, c) in enumerate(fits)}
    return out


def test_hard_negatives(spark, monkeypatch):
    """Small blocks, so that searches take several rounds; copies, ties, two lengths, rows that take no part."""
    from cellweave.llm import negatives as N

    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "FIRST", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, int(rng.integers(0, 4)), ((centres[i % 12] + rng.normal(size=8) / 3) / 4).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, int(i % 2), rows[3][2]) for i in range(60)]
    rows += [(2000 + i, i % 3, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    rows += [(3000, 1, [0.0] * 8), (3050, 77, rows[5][2])]
    bad = [(4000, None, rows[0][2]), (4050, 1, None), (4100, 1, [float("nan")] * 8), (4150, 1, [float("inf")] + [0.0] * 7), (4200, 1, [None] + [1.0] * 7), (4250, 1, []), (None, 1, rows[0][2])]
    table = spark.createDataFrame([(*r, "x", 3) for r in [*rows, *bad, rows[7], rows[50]]], "vec_id long, label int, embedding array<float>, slot string, rank int")
    out = N.hard_negatives(N.usable(table), table.where("vec_id % 50 = 0"))
    got = [tuple(r) for r in out.collect()]
    exact = [(i, m, [int(np.floor(256 * float(x))) for x in v]) for i, m, v in rows]
    assert len(got) == len(set(got)) and set(got) == plain(exact, {i for i, _, _ in rows if i % 50 == 0})
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    nothing = table.limit(0)
    assert N.hard_negatives(N.usable(nothing), table).collect() == []
    assert N.hard_negatives(N.usable(table), nothing).collect() == []


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e300])
def test_scores_past_double_precision(spark, scale):
    from cellweave.llm import negatives as N

    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)) * scale
    table = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {tuple(r) for r in N.hard_negatives(N.usable(table), table.where("vec_id % 50 = 0")).collect()}
    exact = [(i, i % 3, [max(-(2**63), min(2**63 - 1, int(np.floor(c * 256)))) for c in v]) for i, v in enumerate(x)]
    assert got == plain(exact, {0, 50, 100})


def test_query_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    from cellweave.llm import negatives as N

    rng = np.random.default_rng(7)
    rows = [(i, None if i % 31 == 0 and i % 50 else int(rng.integers(0, 10)), (rng.normal(size=6) / 3).astype(np.float32).tolist()) for i in range(700)]
    rows += [(5000 + i, int(i % 10), rows[100][2]) for i in range(150)] + [(6000, 1, None), (6050, 1, [float("nan")] * 6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(N.OP11_SQL)
    out = N.op11_hard_negatives(spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want.fetchall())


def test_annuli_hold_what_is_within_reach():
    """No vector nearer than an annulus's gap is in it, and a score's radius holds all of that score."""
    from cellweave.llm import negatives as N

    rng = np.random.default_rng(8)
    v = rng.integers(-300, 300, (400, 7)).astype(float)
    space = N.Space(7, 300.0, float((v * v).sum(1).max()), v[:100])
    pivot, dist = space.keys(v)
    space.at, space.low, space.high = pivot, dist, dist  # an annulus a vector
    q = rng.integers(-300, 300, (20, 7)).astype(float)
    gaps, norms = space.asked(q)
    apart = np.linalg.norm(space.lift(v)[None] - np.column_stack([q * space.unit, np.zeros(20)])[:, None], axis=2)
    assert (gaps <= apart + 1e-9).all()
    scores = q @ v.T
    for i in range(20):
        assert all(apart[i, j] <= space.reach(norms[i], scores[i, j]) for j in range(400))
