import random
import zlib

import numpy as np

from ridgeline.llm.gbt import Booster, Isotonic
from ridgeline.llm.toxicity import FEATURES, NEAR, SECOND_PERSON, SEED_LEXICON, STEMS, Lexicon, fit, score, train

TESTDATA = "/root/testdata/sf0.1"


def test_booster_and_calibration():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    flip = rnd.random(1500) < 0.1
    y[flip] = 1 - y[flip]
    b = Booster().fit(x[:1000], y[:1000])
    m = b.margin(x[1000:])
    assert ((m > 0) == y[1000:]).mean() > 0.85
    iso = Isotonic().fit(m, y[1000:])
    p = iso.apply(np.linspace(-6, 6, 50))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1
    assert Isotonic().apply(np.zeros(2)).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet")
    out = score(docs, train(docs, labels))
    assert out.count() == docs.count()
    got = out.join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    right = np.mean([r.predicted == r.toxic for r in got])
    pos = [r.score for r in got if r.toxic]
    neg = [r.score for r in got if not r.toxic]
    auc = np.mean([np.mean([(p > n) + (p == n) / 2 for n in neg]) for p in pos])
    brier = np.mean([(r.score - r.toxic) ** 2 for r in got])
    recall = np.mean([p >= 0.5 for p in pos])
    clean = np.mean([n < 0.5 for n in neg])
    print("held out", len(got), "accuracy", right, "auc", auc, "brier", brier, "recall", recall, "clean kept", clean)
    assert right > 0.95 and auc > 0.9 and clean > 0.97


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "you idiot", "x"), (3, "word " * 200_000, "y"), (4, "a b", None), (4, "a b", None)]
    docs = spark.createDataFrame([(d, t, s, 0.5, True) for d, t, s in rows], "doc_id long, text string, source string, score double, held_out boolean")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score(docs, train(docs, none)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert score(docs.limit(0), train(docs.limit(0), none)).count() == 0
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    assert score(docs, train(docs, one)).count() == 6


def test_learns_unknown_words():
    rnd = random.Random(1)
    word = lambda: "w" + str(rnd.randrange(500))
    texts, y = [], []
    for _ in range(900):
        t = [word() for _ in range(60)]
        bad = rnd.random() < 0.2
        if bad:
            t[rnd.randrange(60)] = "zorg" + str(rnd.randrange(9))
        texts.append(" ".join(t).encode())
        y.append(float(bad))
    model = fit(texts[:700], np.array(y[:700]))
    p = model.score(texts[700:])
    assert ((p >= 0.5) == np.array(y[700:])).mean() > 0.95


MARKS = ".,;:!?\"'()[]{}<>|*#%&$-_~/\\“”„«»‘’‚‹›¡¿…–—"
LOOKS = dict(zip("013457@$!", "oleastasi", strict=True))


def naive(text, lexicon):
    """The features word by word, as the module's text describes them."""
    raw = text.split()
    rows = []
    for w in raw:
        core = w
        while core and core[0] in MARKS:
            core = core[1:]
        while core and core[-1] in MARKS:
            core = core[:-1]
        core = core.lower()
        learned = lexicon.words.get(core)
        stem = None
        for k in STEMS:
            if learned is None and stem is None and len(core) >= k:
                stem = lexicon.stems.get(core[:k])
        known = core in SEED_LEXICON or learned is not None or stem is not None
        odd = False
        for i in range(len(core)):
            j = i + 1
            while j < len(core) and core[j] in "0123456789@$*!#":
                j += 1
            odd = odd or (core[i].isalpha() and i + 1 < j < len(core) and core[j].isalpha())
        odd = odd and not known
        plain = "".join(LOOKS.get(ch, ch) for ch in core)
        leet = odd and (plain in SEED_LEXICON or plain in lexicon.words)
        rows.append((core, core in SEED_LEXICON, learned, stem, odd, leet, core in SECOND_PERSON, len(w) > 1 and w.isupper()))
    n = len(raw)
    d = max(n, 1)
    weight = [r[2] if r[2] is not None else r[3] for r in rows]
    strength = sum(x for x in weight if x is not None)
    hit = [r[1] or r[2] is not None or r[3] is not None or r[5] for r in rows]
    near, waiting, you_at = 0, [], None
    for i, r in enumerate(rows):
        if r[6]:
            near += sum(i - j <= NEAR for j in waiting)
            waiting, you_at = [], i
        elif hit[i]:
            if you_at is not None and i - you_at <= NEAR:
                near += 1
            else:
                waiting.append(i)
    seed, learned, stems = sum(r[1] for r in rows), sum(r[2] is not None for r in rows), sum(r[3] is not None for r in rows)
    return [
        n, np.log1p(n), seed, seed / d, learned, learned / d, stems, stems / d, len({r[0] for r, h in zip(rows, hit, strict=True) if h}),
        near, near / d, sum(r[6] for r in rows) / d, sum(r[7] for r in rows) / d, sum(text.count(m) for m in ".,;:?!") / d,
        text.count("!") / d, sum(r[4] for r in rows) / d, sum(r[5] for r in rows), strength, strength / d, max([0.0, *[x for x in weight if x is not None]]),
    ]


def test_features_against_naive():
    rnd = random.Random(3)
    parts = ["idiot", "IDIOT!", "«idiot»", "canoë", "crû", "IMBÉCILE", "Scheiße", "¡ESTÚPIDO!", "you", "You,", "du", "tu", "id1ot", "st*pid", "m0r0n", "zorgling", "zorgle", "plain", "A", "ÀÉ", "x", "...", "b4d", "été3é", "\u2028", "日本語"]
    lexicon = Lexicon({"zorgling": 2.5, "plain": 1.0, "moron": 0.5}, {"zorg": 1.5, "cano": 0.7, "idiot": 9.0})
    for _ in range(400):
        text = rnd.choice([" ", "\n", "  "]).join(rnd.choice(parts) for _ in range(rnd.randrange(0, 60)))
        got = lexicon.features(text.encode())
        assert np.allclose(got, naive(text, lexicon)), text
    assert len(FEATURES) == len(got)


def test_four_languages():
    lexicon = Lexicon()
    at = {n: i for i, n in enumerate(FEATURES)}
    for text in ("»idiot« says", "un IMBÉCILE parle", "¿Estúpido? no", "Du SCHEISSE scheiße,"):
        assert lexicon.features(text.encode())[at["seed"]] == 1, text
    words = lexicon.judge("canoë"), lexicon.judge("crû")
    assert words == (None, None)
    assert lexicon.features("ÀÉÎ abc".encode())[at["capitals"]] == 0.5
