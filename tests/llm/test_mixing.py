import random

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import mixing
from ridgeline.llm.mixing import mix_sources, source_targets


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets one source at a time, with exact re-sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else rest * w[s] / open_ for s in names}
        over = {s for s in names if s not in full and t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over


def rows(n, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "Z", "é", "\U0001f600", "￿", None, "tiny"]
    out = []
    for i in range(n):
        s = rnd.choices(names, [30, 5, 5, 5, 3, 3, 3, 0.3])[0]
        out.append((i, " ".join(["x"] * rnd.choice([0, 1, 5, 20, 50, 200])) if rnd.random() < 0.97 else None, s))
    return out + [(n, "one word", "b"), (None, "no id", "b")]


@pytest.mark.parametrize("block,fan", [(20_000, 64), (40, 4)])
def test_targets_and_taken(spark, monkeypatch, block, fan):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    data = rows(3000, 5)
    df = spark.createDataFrame([(*r, 1.0, 2, "k") for r in data], "doc_id long, text string, source string, target double, p long, key string")
    got = mix_sources(df).collect()
    assert len(got) == len(data)
    sizes, taken = {}, {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        f = want[r.source] / sizes[r.source]
        if r.size:
            assert int(f + 1e-9) <= r.taken / r.size <= int(f) + 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 400
    again = mix_sources(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_empty_and_zero(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    got = mix_sources(spark.createDataFrame([(1, None, "a"), (1, " ", None)], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_expectation_is_kept(spark):
    # Over seeds, each document's mean copies come near its source's factor.
    data = [(i, "w " * (1 + i % 3), "a" if i < 20 else "b") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    total = {}
    for seed in range(12):
        for r in mix_sources(df, seed=seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.taken / r.size
    factor = {r.doc_id: r.target / r.source_size for r in mix_sources(df).collect()}
    assert abs(sum(total[i] / 12 for i in range(20)) / 20 - factor[0]) < 0.05
    assert max(abs(total[i] / 12 - factor[i]) for i in factor) < 0.6


def test_weights_resharing(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1, 1), ("d", 3000, 1)], "source string, source_size long, rows long")
    got = {r.source: r.target for r in source_targets(s).collect()}
    want = fill({"a": 10, "b": 1000, "c": 1, "d": 3000})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_equal_rows_are_spread(spark, monkeypatch):
    """A third of all rows are one row: they get keys of their own, blocks stay
    small, and reruns agree however the rows lie."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    data = [(7, "a b c", "a")] * 900 + [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(1800)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    sized = mixing.materialize(df.select("*", F.xxhash64("doc_id").alias("key"), F.monotonically_increasing_id().alias("number")), "t")
    spread = mixing._spread_equal(sized)
    assert spread.count() == 2700 and spread.select("key").distinct().count() == 2700
    got = [sorted(tuple(r) for r in mix_sources(x).collect()) for x in (df, df.repartition(3), df.coalesce(1))]
    assert got[0] == got[1] == got[2]
    taken = {}
    for r in got[0]:
        taken[r[2]] = taken.get(r[2], 0) + r[5]
    want = fill({s: sum(len(t.split()) for _, t, x in data if x == s) for s in "a ab".split() + ["b"] if any(x == s for *_, x in data)})
    assert all(abs(taken[s] - want[s]) <= 10 for s in want)
