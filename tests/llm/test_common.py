import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import common
from ridgeline.llm.common import chunks, connected_components, materialize, read_table
from ridgeline.runtime import clear_scratch, scratch_dir


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\r\x1c é𝄞\x85", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_are_split_at_six_blanks(texts, limit):
    got, hashes = [], {}
    for c in chunks(pa.array(texts, pa.string()), limit=limit):
        for r in range(len(c.rows)):
            words = c.words(r)
            got.append(words)
            for w, h in zip(words, c.hashes[c.first[r] : c.first[r + 1]]):
                assert hashes.setdefault(w, h) == h
    assert got == [(t or "").encode().split() for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_sliced_columns_and_long_words():
    col = pa.array(["drop", None, "x " + "y" * (common.HASH_BLOCK + 9) + " z", "a b"]).slice(1)
    out = [c.words(r) for c in chunks(col) for r in range(len(c.rows))]
    assert [len(w) for w in out] == [0, 3, 2]
    assert len({int(h) for c in chunks(col) for h in c.hashes}) == 5


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 400)]
    pairs += [(2000 + i, 2001 + i) for i in range(120)] + [(5, 5), (None, 4), (7, None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(df.limit(0)).count() == 0


def test_scratch_is_cleared(spark):
    df = materialize(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and scratch_dir(spark) == scratch_dir(spark)
    with pytest.raises(Exception):
        read_table(spark, "/nowhere", "documents")
    clear_scratch(spark)
    assert np.array_equal(common.powers(3, 4), np.array([1, 3, 9, 27], dtype=np.uint64))


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    common.bound_batches(spark)
    assert spark.conf.get(key) == str(common.BATCH_ROWS)
    spark.conf.set(key, "7")
    common.bound_batches(spark)
    assert spark.conf.get(key) == "7"
    spark.conf.unset(key)
