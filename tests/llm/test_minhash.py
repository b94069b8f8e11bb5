import random

from pyspark.sql import functions as F

from ridgeline.llm.minhash import keep_one, bands_for, near_duplicates, superminhash

SCHEMA = "doc_id long, text string, fp string, bands string, component_id long"


def brute(rows, k, percent):
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def make(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "two words"), (6, "three word text"), (7, "É x y z")]
    base = [rnd.choice(words) for _ in range(60)]
    while len(rows) < n:
        kind = rnd.random()
        if kind < 0.5:
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
        else:
            t = [rnd.choice(words) for _ in range(rnd.choice([3, 10, 80]))]
        if rnd.random() < 0.1:
            base = t
        rows.append((len(rows), (" " if rnd.random() < 0.5 else "\n").join(t)))
    return rows


def test_against_brute_force(spark):
    rows = make(300, 3)
    df = spark.createDataFrame([(d, t, "x", "y", 9) for d, t in rows], SCHEMA).repartition(5)
    for k, p in ((3, 85), (5, 80)):
        got = sorted(tuple(r) for r in near_duplicates(df, shingle=k, percent=p).collect())
        assert got == brute(rows, k, p)


def test_long_text_null_id_and_repeats(spark):
    long = " ".join(f"t{i % 997}x{i}" for i in range(60_000))
    rows = [(5, long), (4, long + " tail"), (None, long), (7, "a b c d"), (7, "a b c d"), (9, "x" * 1_200_000 + " y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df, shingle=3, percent=85).collect()), key=str)
    assert got == sorted(
        [(5, 59998, 4, False), (4, 59999, 4, True), (None, 59998, None, True), (7, 2, 7, True), (7, 2, 7, True), (9, 1, 9, True)],
        key=str,
    )


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().kept


def test_signature_estimates_similarity():
    import numpy as np

    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    for n, shared in ((30, 20), (2000, 1500)):
        a, b = pool[:n], pool[n - shared : 2 * n - shared]
        sig = superminhash([np.sort(a), np.sort(b), a[:0]], 128)
        true = shared / (2 * n - shared)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.15
        assert (sig[2] == sig[2].max()).all() and len(set(sig[0])) == 128


def test_bands():
    assert bands_for(85) == (5, 25)
    assert bands_for(80) == (4, 32)


def test_keep_one_row_of_each_group(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(2, a), (5, a), (5, b), (7, b + " x"), (7, b + " x"), (9, None), (9, None), (None, a), (None, "c d e f g h"), (8, "")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, c0 string, component_id int").repartition(3)
    out = keep_one(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, a), (5, b), (9, None), (9, None), (None, "c d e f g h"), (8, "")], key=str)
    assert keep_one(df.limit(0)).count() == 0
