import pickle
import random

import numpy as np
import pytest

from ridgeline.llm import decontaminate as dc
from ridgeline.llm.common import PLAIN
from ridgeline.llm.decontaminate import (
    HALF,
    LIMITS,
    Limits,
    Queries,
    Vocabulary,
    common_subsequence,
    cut_items,
    decontaminate,
    find_leaks,
    nystroem,
    vocabulary_of,
    _hashes,
    _masks,
)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain(text):
    return bytes(PLAIN[np.frombuffer((text or "").encode(), np.uint8)]).split()


def queries(docs, items, limits=LIMITS):
    items = [(i, t) for i, t in items if t is not None]
    words = Vocabulary(vocabulary_of(items))
    cut = cut_items(items, words, limits)
    df, total = np.zeros(len(words)), 0
    for _, t in docs:
        w = plain(t)
        for i in range(0, len(w), HALF):
            df[np.unique(words.find(_hashes([b" ".join(w[i : i + HALF]).decode()])[0])[1])] += 1
            total += 1
    return words, Queries(cut, df, total, limits)


def regions(text, words):
    h = _hashes([text or ""])[0]
    for at in range(0, len(h), HALF):
        lo = max(0, at - HALF // 2)
        place, word = words.find(h[lo : at + 2 * HALF + HALF // 2])
        yield word.tolist(), (place + lo).tolist()


def brute(docs, items, limits=LIMITS):
    """Every passage against every piece, without a candidate search."""
    words, q = queries(docs, items, limits)
    found = set()
    for d, t in docs:
        for region in regions(t, words):
            found |= {(d, int(q.item[k])) for k in range(len(q)) if q.piece(k).matches(*region)[1]}
    return found


#: No paraphrase: what the exact way alone must find.
COPIES = Limits(paraphrase=9.0)


def corpus(seed):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rnd.randrange(14, 120)))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "c1 c2"), (43, "c3 c4 q5 c6 c7")]
    docs = [(900, None), (901, ""), (902, "word " * 5), (903, items[43][1]), (904, "c3 c4 and q5 c6 c7")]
    for i in range(250):
        t = [word() for _ in range(rnd.randrange(5, 400))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            x = rnd.choice(items[:40])[1].split()
            kind = rnd.random()
            if kind < 0.5:
                x = [w for w in x if rnd.random() < 0.85]
                x = [w.upper() + rnd.choice(["", ",", "."]) for w in x]
            elif kind < 0.7:
                x = x[: max(4, len(x) // 3)]
            at = rnd.randrange(len(t) + 1)
            t[at:at] = x
        docs.append((i, " ".join(t)))
    docs.append((950, " ".join(word() for _ in range(60_000)) + " " + items[3][1]))
    return docs, items


def test_against_all_passages(spark):
    docs, items = corpus(4)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs + docs[:9]], "doc_id long, text string, item_id int, th string").repartition(4)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    rows = find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got) == len(rows)
    want = brute(docs, items)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100
    assert brute(docs, items, COPIES) <= got
    assert {i for d, i in got if d in (903, 904)} == {43} and (904, 43) not in got
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns
    bad = {d for d, _ in got}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs + docs[:9] if d not in bad)


def test_empty(spark):
    df = spark.createDataFrame([(1, "some text here now"), (None, "a b c d e f g h i")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(df, none).count() == 0 and decontaminate(df, none).count() == 2
    one = spark.createDataFrame([(7, "a b c d e f g h i")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(df, one).collect()] == [(None, 7)]
    assert find_leaks(df.limit(0), one).count() == 0 and decontaminate(df.limit(0), one).count() == 0
    assert [r.doc_id for r in decontaminate(df, one).collect()] == [1]


def test_common_subsequence():
    rnd = random.Random(2)
    for _ in range(200):
        a = [rnd.randrange(6) for _ in range(rnd.randrange(1, 80))]
        b = [rnd.randrange(8) for _ in range(rnd.randrange(0, 90))]
        assert common_subsequence(b, _masks(a), len(a)) == lcs(a, b)


def test_nystroem_finds_leading_vectors():
    rnd = np.random.default_rng(0)
    a = rnd.normal(size=(400, 8)) @ np.diag([90, 70, 50, 30, 20, 1, 1, 1]) @ rnd.normal(size=(8, 60)) + rnd.normal(size=(400, 60)) * 0.1
    start = rnd.normal(size=(60, 20))
    got = nystroem(a.T @ (a @ start), start, 5)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(got.values, s[:5], rtol=0.02)
    assert np.linalg.norm(got.basis.T @ vt[:5].T) > 2.2


def test_no_passage_is_lost(spark):
    """More items than the basis has directions, of words that many share."""
    rnd = random.Random(6)
    words = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(6, 90)))) for i in range(700)]
    items.append((700, "twice " * 30 + "once more"))
    docs = []
    for i in range(300):
        t = [rnd.choice(words) for _ in range(rnd.randrange(0, 300))]
        x = items[rnd.randrange(len(items))][1].split()
        t[len(t) // 2 : len(t) // 2] = x if i % 2 else [w for w in x if rnd.random() < 0.8]
        docs.append((i, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    assert brute(docs, items, COPIES) <= got <= brute(docs, items) and len(got) > 250


def paraphrase(rnd, words, part):
    """Some words replaced by others, one by one."""
    return [f"r{rnd.randrange(4000)}" if rnd.random() < part else w for w in words]


@pytest.mark.parametrize("n_items,part", [(200, 0.4), (200, 0.5), (5000, 0.4)])
def test_paraphrases(spark, n_items, part):
    """Of the passages that the confirmation would accept, planted with replaced
    words, nine in ten at least are found."""
    rnd = random.Random(n_items)
    words = [f"v{i}" for i in range(6000)]
    word = lambda: words[int(len(words) * rnd.random() ** 2)]
    items = [(i, " ".join(word() for _ in range(rnd.randrange(25, 60)))) for i in range(n_items)]
    docs, planted = [], []
    for i in range(800):
        t = [word() if rnd.random() < 0.6 else f"r{rnd.randrange(4000)}" for _ in range(rnd.randrange(40, 300))]
        if i % 2:
            k = rnd.randrange(n_items)
            at = rnd.randrange(len(t))
            t[at:at] = paraphrase(rnd, items[k][1].split(), part)
            planted.append((i, k))
        docs.append((i, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    vocabulary, q = queries(docs, items)
    of_item = {}
    for k, i in enumerate(q.item.tolist()):
        of_item.setdefault(i, []).append(q.piece(k))
    text = dict(docs)
    want = {(d, k) for d, k in planted if any(p.matches(*r)[1] for r in regions(text[d], vocabulary) for p in of_item[k])}
    print(n_items, part, "planted", len(planted), "accepted", len(want), "found", len(want & got), "others", len(got - want))
    assert len(want & got) >= 0.9 * len(want) and len(want) > (0.5 if part < 0.5 else 0.2) * len(planted)
    # What tasks are sent stays small, and nothing of it grows with the documents.
    assert len(pickle.dumps(q)) < 100 * sum(len(t.split()) for _, t in items)


def test_blocks_and_vocabularies(spark, monkeypatch):
    """Many blocks of items, over several vocabularies, find what one finds."""
    docs, items = corpus(8)
    df = spark.createDataFrame(docs[:120], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    exact = Limits(near=9.0)
    one = {(r.doc_id, r.item_id) for r in find_leaks(df, bench, limits=exact).collect()}
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(dc, "VOCABULARY", 700)
    many = {(r.doc_id, r.item_id) for r in find_leaks(df, bench, limits=exact).collect()}
    # The rarest words of a piece are the same, as frequencies are of the documents.
    assert one == many and len(one) > 20


def test_short_items_if_asked_for(spark):
    df = spark.createDataFrame([(1, "x the end y"), (2, "the x end"), (3, "The END.")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "the end")], "item_id long, text string")
    assert find_leaks(df, bench).count() == 0
    assert sorted(r.doc_id for r in find_leaks(df, bench, limits=Limits(least_words=1)).collect()) == [1, 3]
