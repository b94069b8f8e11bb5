import numpy as np
import pytest

from ridgeline.llm import embeddings
from ridgeline.llm.embeddings import Codes, exact_links, judge, near_vectors, quantise


def brute(rows, threshold=0.93):
    ok = [i for i, (v, x, l) in enumerate(rows) if v is not None and l is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float64) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    up[find(a)] = find(b)
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, (v, _, _) in enumerate(rows):
        c = least[find(i)] if i in set(ok) else v
        out.append((v, n[i], c, c == v))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rnd = np.random.default_rng(4)
    rows = []
    base = rnd.normal(size=(12, 24))
    for i in range(160):
        x = base[rnd.integers(12)] + rnd.normal(size=24) * rnd.choice([0, 0.2, 0.25, 0.3, 2.0])
        rows.append((1000 - i, [float(v) for v in x.astype(np.float32)], int(rnd.integers(3))))
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 24, 0), (4, [float("nan")] * 24, 0), (5, [float("inf")] + [1.0] * 23, 0), (6, rows[0][1], None)]
    rows += [(7, [None] + [1.0] * 23, 0), (8, rows[0][1][:5], rows[0][2]), (None, rows[0][1], rows[0][2]), (9, [2 * v for v in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, full string, vid long").repartition(3)
    want = brute(rows)
    want = [(None, 0, None, True) if r[0] is None else r for r in want]
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=str) == sorted(want, key=str)


def test_bound_is_rigorous():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(700, 64)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = Codes(*quantise(x))
    exact = {(i, j) for i, j in np.argwhere(np.triu(x @ x.T >= 0.4, 1))}
    sure, open_ = set(), set()
    for p, q, s in judge(code, None, 0.4):
        sure |= set(zip(p[s], q[s], strict=True))
        open_ |= set(zip(p[~s], q[~s], strict=True))
    assert sure <= exact <= sure | open_ and len(open_) < 0.01 * 700 * 699 / 2
    fine = {(i, j) for p, q in exact_links(x, code, None, 0.4) for i, j in zip(p, q, strict=True)}
    assert fine == exact - sure


def test_one_id_under_two_labels(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (1, [0.0, 1.0], 1), (3, [0.01, 1.0], 1), (5, [1.0, 1.0], 0), (5, [-1.0, 1.0], 0), (4, [-1.0, 1.01], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (5, 0, 5), (5, 1, 4)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(df).count() == 0
