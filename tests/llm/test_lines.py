import random

from ridgeline.llm.lines import dedup_lines


def brute(rows, span=3):
    seen, gone = {}, {}
    order = sorted((i for i, r in enumerate(rows) if r[0] is not None and r[1] is not None), key=lambda i: rows[i][0])
    places = {}
    for i in order:
        lines = rows[i][1].split("\n")
        for j in range(len(lines) - span + 1):
            places.setdefault(tuple(lines[j : j + span]), []).append((rows[i][0], j, i))
    for occurrences in places.values():
        first = min((d, j) for d, j, _ in occurrences)
        for d, j, i in occurrences:
            if (d, j) > first:
                gone.setdefault(i, set()).update(range(j, j + span))
    del seen
    out = []
    for i, (d, t) in enumerate(rows):
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        drop = gone.get(i, set())
        out.append((d, "\n".join(x for j, x in enumerate(lines) if j not in drop), len(lines), len(drop)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    pool = [f"line {i}" for i in range(12)] + ["", "é"]
    rows = [(900, None), (901, ""), (902, "\n\n\n\n\n"), (None, "line 1\nline 2\nline 3"), (903, "a\nb")]
    for i in range(150):
        rows.append((i * 11 % 150, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own {i} {rnd.random()}" for _ in range(rnd.randrange(1, 25)))))
    rows.append((904, "\n".join(f"long {i % 7000}" for i in range(30_000))))
    rows += [rows[9], rows[9]]
    df = spark.createDataFrame([(d, 1, t, "x", 0) for d, t in rows], "doc_id long, n_lines int, text string, starts string, n_removed long").repartition(4)
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "n_lines", "text", "starts", "n_removed", "n_lines", "n_removed"]
    got = [(r[0], r[2], r[5], r[6]) for r in got.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
