import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ridgeline.llm import substring
from ridgeline.llm.common import chunks
from ridgeline.llm.substring import Parsed, _parse, duplicate_spans, factors


def brute(rows, window):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, window):
    whole, cut = _parse(df, "doc_id", "text", window)
    out = whole.select("doc_id", "n_words", F.lit(0), F.lower(F.hex("sha"))).union(
        cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    )
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed, n, vocabulary=300):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    passage = [[word() for _ in range(rnd.randrange(30, 400))] for _ in range(6)]
    rows = [(10_000, None), (10_001, ""), (10_002, " \n "), (None, " ".join(passage[0]))]
    for i in range(n):
        t = []
        for _ in range(rnd.randrange(1, 5)):
            if rnd.random() < 0.5:
                p = rnd.choice(passage)
                a = rnd.randrange(len(p))
                t += p[a : a + rnd.randrange(20, 300)]
            else:
                t += [word() for _ in range(rnd.randrange(80))]
        rows.append((i * 7 % n, rnd.choice([" ", "\n", "\t "]).join(t)))
    rows.append(rows[5])
    rows.append((rows[6][0], rows[7][1]))
    return rows


def test_against_brute_force(spark):
    for seed, window in ((1, 50), (2, 12)):
        rows = corpus(seed, 120)
        df = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, owner string, th long").repartition(4)
        assert run(df, window) == brute(rows, window)


def test_low_entropy_and_long_text(spark):
    rows = [(1, "a " * 500), (2, "a " * 300 + "b " * 300), (3, "b " * 120), (4, "a b " * 400), (5, "a b " * 60)]
    long = " ".join(f"t{i % 5003}x{i}" for i in range(200_000))
    rows += [(6, long), (7, "start " + long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 50) == brute(rows, 50)


def test_empty_and_spans(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run(empty, 50) == []
    text = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "x y " + text + " z")], "doc_id long, text string")
    row = duplicate_spans(df).first()
    assert (row.doc_id, row.n_removed, row.text, [tuple(s) for s in row.spans]) == (2, 60, "x y z", [(2, 62)])
    assert substring.GRAM < 50


def naive_factors(rows, window):
    """The parse word by word. The reference has every block and every window
    at its first place; a block that a smaller document has is a match, and so
    is each window outside these; matches that go on at one source are joined."""
    words = {d: t.encode().split() for d, t in rows}
    cut, first_block, first_window = {}, {}, {}
    for d, t in rows:
        chunk = next(iter(chunks(pa.array([t]))))
        _, lo, hi = Parsed(chunk, window).blocks()
        cut[d] = list(zip(lo.tolist(), hi.tolist(), strict=True))
        for a, b in cut[d]:
            key = tuple(words[d][a : b + window - 1])
            first_block[key] = min(first_block.get(key, (d, a)), (d, a))
    unmatched = {}
    for d in words:
        unmatched[d] = []
        for a, b in cut[d]:
            if first_block[tuple(words[d][a : b + window - 1])][0] == d:
                unmatched[d] += range(a, b)
        for a in unmatched[d]:
            key = tuple(words[d][a : a + window])
            first_window[key] = min(first_window.get(key, (d, a)), (d, a))
    out = {}
    for d in words:
        pieces = [(a, b, *first_block[tuple(words[d][a : b + window - 1])]) for a, b in cut[d]]
        pieces += [(a, a + 1, *first_window[tuple(words[d][a : a + window])]) for a in unmatched[d]]
        parsed = []
        for a, b, source, at in sorted(p for p in pieces if p[2] < d):
            if parsed and parsed[-1][1] == a and parsed[-1][2] == source and parsed[-1][3] + a - parsed[-1][0] == at:
                parsed[-1] = (parsed[-1][0], b, source, parsed[-1][3])
            else:
                parsed.append((a, b, source, at))
        if parsed:
            out[d] = [(a, b + window - 1, source, at) for a, b, source, at in parsed]
    return out, words


def test_factors_against_a_naive_parse(spark):
    for seed, window in ((3, 50), (4, 12)):
        rows = [(d, t) for d, t in dict(corpus(seed, 90)).items() if d is not None and t]
        want, words = naive_factors(rows, window)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: [tuple(f) for f in r.factors] for r in duplicate_spans(df, window=window).collect()}
        assert got == want and len(got) > 20
        lengths = [stop - start for f in got.values() for start, stop, *_ in f]
        assert min(lengths) >= window and max(lengths) > 3 * window
        for d, parsed in got.items():
            for start, stop, source, at in parsed:
                assert source < d and words[d][start:stop] == words[source][at : at + stop - start]


def test_factors_join_matches():
    a = np.array
    first = factors(a([0, 5, 9, 20]), a([5, 9, 12, 21]), a([1, 1, 2, 2]), a([7, 7, 7, 7]), a([10, 15, 3, 14]))
    assert first.tolist() == [0, 2, 3]
    assert factors(*[a([], dtype=np.int64)] * 5).tolist() == []


def test_thinned_anchors():
    """Blocks are some ``CUT`` anchors long, of about 20 words each."""
    rnd = random.Random(1)
    chunk = next(iter(chunks(pa.array([" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60_000))]))))
    _, lo, hi = Parsed(chunk, 50).blocks()
    assert lo[0] == 0 and (lo[1:] == hi[:-1]).all() and hi[-1] == 60_000 - 49
    assert 15 * substring.CUT < np.mean(hi - lo) < 30 * substring.CUT
