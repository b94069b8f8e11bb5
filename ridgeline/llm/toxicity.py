"""Toxicity scores by gradient-boosted trees over dense features.

Features of a text: densities of lexicon words (a short seed list of insults,
and words and word beginnings that labelled rows show to be toxic), their
proximity to the second person, the rates of capitals, of punctuation and of
obfuscated words, and lengths. Boosted trees give a margin; isotonic regression
on rows that the trees have not seen turns it into a probability.

The lexicon, the trees and the calibration are fitted in one task on at most
``max_rows`` labelled rows, those of the smallest hash of the id; rows whose
``crc32(doc_id)`` is divisible by five are never among them. Every document is
scored over its whole text, in one pass without a shuffle.

Words are compared as Unicode: lower case, without marks and quotes around
them, in whatever language.

Defined results: null and empty texts are scored as texts without words. A row
with a null id is not held out. Labels that are null, or whose id has no
document, are not used; without any usable label the score is 0.5. Repeated
rows are each scored. Other columns of the input are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, read_table
from .gbt import Booster, Isotonic

#: Common insults of the languages at hand; the learned lexicon adds to them.
SEED_LEXICON = frozenset(
    "idiot idiots moron morons stupid scum trash worthless pathetic disgusting loser losers clown dumb "
    "filth vermin imbecile bastard bitch crap damn jerk freak hate kill ugly "
    "connard salope imbécile ordure crétin abruti "
    "arschloch dummkopf trottel abschaum scheiße "
    "pendejo cabrón estúpido basura imbécil".split()
)
SECOND_PERSON = frozenset("you your you're yours yourself u ur tu te toi vous votre ton du dich dir dein ihr usted vos tus".split())
#: Characters of the word beginnings that may enter the lexicon.
STEMS = (4, 5, 6)
MAX_LEXICON = 3000
NEAR = 6
#: Words whose judgement a task keeps.
KNOWN_WORDS = 300_000
_LEET = str.maketrans("013457@$!", "oleastasi")
_EDGE = ".,;:!?\"'()[]{}<>|*#%&$-_~/\\“”„«»‘’‚‹›¡¿…–—"
_ODD = re.compile(r"[^\W\d_][0-9@$*!#]+[^\W\d_]")

FEATURES = (
    "words", "log_words", "seed", "seed_density", "learned", "learned_density", "stems", "stem_density", "distinct",
    "near_you", "near_density", "you_density", "capitals", "punctuation", "exclaims", "obfuscated", "leet_hits",
    "strength", "strength_density", "top",
)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _core(word: str) -> str:
    return word.strip(_EDGE).lower()


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


@dataclass
class Lexicon:
    """Log-odds of toxic words and stems; both bounded by ``MAX_LEXICON``."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._known: dict[str, tuple] = {}
        self._plain: set[str] = set()
        self._heads = {s[: STEMS[0]] for s in self.stems}

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems}

    def __setstate__(self, state):
        self.__init__(**state)

    def judge(self, word: str) -> tuple | None:
        """What a word counts for, or None if for nothing: its core, and whether
        it is a seed word, its learned weight, its stem's weight, if it is
        obfuscated, obfuscates a known word, is second person, in capitals."""
        core = word.strip(_EDGE).lower()
        seed, weight = core in SEED_LEXICON, self.words.get(core)
        stem, odd, leet = None, False, False
        # Stems of all lengths begin with one of these.
        if weight is None and core[: STEMS[0]] in self._heads:
            for k in STEMS:
                stem = self.stems.get(core[:k]) if len(core) >= k else None
                if stem is not None:
                    break
        if not (seed or weight is not None or stem is not None or core.isalpha()) and _ODD.search(core):
            odd = True
            plain = core.translate(_LEET)
            leet = plain in SEED_LEXICON or plain in self.words
        you, capital = core in SECOND_PERSON, len(word) > 1 and word.isupper()
        if not (seed or weight is not None or stem is not None or odd or you or capital):
            return None
        return core, seed, weight, stem, odd, leet, you, capital

    def features(self, raw: bytes) -> list[float]:
        text = _text(raw)
        split = text.split()
        n = len(split)
        known, plain = self._known, self._plain
        if len(known) + len(plain) > KNOWN_WORDS:
            known.clear()
            plain.clear()
        # Most words are known to count for nothing and are looked at no further.
        found = {}
        for w in set(split) - plain:
            judged = known.get(w)
            if judged is None:
                judged = self.judge(w)
                if judged is None:
                    plain.add(w)
                    continue
                known[w] = judged
            found[w] = judged
        places = [(i, found[w]) for i, w in enumerate(split) if w in found] if found else []
        hits, seed, learned, stems, leet, you, near = set(), 0, 0, 0, 0, 0, 0
        strength, top, odd, capitals, last = 0.0, 0.0, 0, 0, -NEAR - 1
        pending: list[int] = []
        for i, (core, is_seed, weight, stem, is_odd, is_leet, is_you, capital) in places:
            seed += is_seed
            if weight is not None:
                learned += 1
            elif stem is not None:
                stems += 1
                weight = stem
            if weight is not None:
                strength += weight
                top = max(top, weight)
            odd += is_odd
            leet += is_leet
            capitals += capital
            hit = is_seed or weight is not None or is_leet
            if hit:
                hits.add(core)
            if is_you:
                you += 1
                last = i
                near += sum(i - j <= NEAR for j in pending)
                pending.clear()
            elif hit:
                if i - last <= NEAR:
                    near += 1
                else:
                    pending.append(i)
        marks = sum(text.count(p) for p in ".,;:?!")
        exclaims = text.count("!")
        d = max(n, 1)
        return [
            n, float(np.log1p(n)), seed, seed / d, learned, learned / d, stems, stems / d, len(hits),
            near, near / d, you / d, capitals / d, marks / d, exclaims / d, odd / d, leet,
            strength, strength / d, top,
        ]


class Counted:
    """The different words of texts, and their beginnings, as numbers: some
    bytes each, where sets of strings would take a hundred times the text."""

    def __init__(self, texts: list[bytes]):
        numbers: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.rows: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for raw in texts:
            words = {_core(w) for w in set(_text(raw).split())} - {""}
            for items, number, rows in zip((words, {w[:k] for w in words for k in STEMS if len(w) >= k}), numbers, self.rows, strict=True):
                rows.append(np.fromiter((number.setdefault(w, len(number)) for w in items), np.int32, len(items)))
        self.names = tuple(list(n) for n in numbers)

    def texts_with(self, kind: int, at: np.ndarray) -> np.ndarray:
        """In how many of the texts ``at`` each word, or beginning, occurs."""
        rows = [self.rows[kind][i] for i in at]
        return np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=len(self.names[kind]))


def learn_lexicon(counted: Counted, y: np.ndarray, at: np.ndarray, least: int = 3, odds: float = 6.0) -> Lexicon:
    """Words and stems that occur in several toxic texts, of the texts ``at``,
    and hardly in the others."""
    toxic, clean = at[y[at] > 0], at[y[at] <= 0]
    words, stems = {}, {}
    for kind, into in ((0, words), (1, stems)):
        c = counted.texts_with(kind, toxic)
        ratio = ((c + 0.1) / max(len(toxic), 1)) / ((counted.texts_with(kind, clean) + 0.5) / max(len(clean), 1))
        names = counted.names[kind]
        scored = [(float(np.log(ratio[i])) * min(int(c[i]), 50), names[i], float(np.log(ratio[i]))) for i in np.flatnonzero((c >= least) & (ratio >= odds))]
        for _, w, weight in sorted(scored, reverse=True)[:MAX_LEXICON]:
            into[w] = weight
    return Lexicon(words, stems)


@dataclass
class Model:
    lexicon: Lexicon
    booster: Booster
    calibration: Isotonic

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.array([self.lexicon.features(t) for t in texts])
        return self.calibration.apply(self.booster.margin(x))


def fit(texts: list[bytes], y: np.ndarray) -> Model:
    """Cross-fitted over thirds: a row's lexicon features come from a lexicon of
    the other two thirds, and its calibration margin from trees that did not
    see it. The model then has the lexicon and the trees of all rows."""
    y = np.asarray(y, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        iso = Isotonic(np.zeros(1), np.full(1, 0.5 if not len(y) else (y.sum() + 0.5) / (len(y) + 1)))
        return Model(Lexicon(), Booster().fit(np.zeros((0, 1)), y[:0]), iso)
    every = np.arange(len(y))
    fold = every % 3
    counted = Counted(texts)
    x = np.zeros((len(y), len(FEATURES)))
    for f in range(3):
        lexicon = learn_lexicon(counted, y, every[fold != f])
        for i in every[fold == f]:
            x[i] = lexicon.features(texts[i])
    margin = np.zeros(len(y))
    for f in range(3):
        margin[fold == f] = Booster().fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    calibration = Isotonic().fit(margin, y)
    return Model(learn_lexicon(counted, y, every), Booster().fit(x, y), calibration)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows that are not held out."""
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    ids = ids.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(3)).alias("h"))
    ids = ids.orderBy("h", "doc_id", "toxic").limit(max_rows)
    # Bounded by max_rows, so it may be broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Model:
    rows = training_rows(docs, labels, max_rows).select(
        "h", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "toxic"
    )
    return _fit_on(rows)


def _fit_on(rows: DataFrame) -> Model:
    """Fits in one task of the cluster, from a stored sample."""
    table = materialize(rows, "toxicity-sample")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            got += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (t.encode() for t in b.column(2).to_pylist()), b.column(3).to_pylist(), strict=True)
        got.sort()
        model = fit([g[2] for g in got], np.array([g[3] for g in got], dtype=np.float64))
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    stored = table.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(stored[0].model) if stored else fit([], np.empty(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                p = model.score([chunk.text(r) for r in range(len(chunk.rows))])
                at, n = chunk.rows.start, len(chunk.rows)
                yield pa.record_batch(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model scores 0.5 or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for chunk in chunks(batch.column(at)):
                keep.append(model.score([chunk.text(r) for r in range(len(chunk.rows))]) < 0.5)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    # Columns go by place, so equal names do no harm.
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return named.mapInArrow(run, named.schema).toDF(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
