import random

import corpus_pipeline
from ridgeline.llm.toxicity import train
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_mixing import fill

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture():
    rnd = random.Random(9)
    bad = ["idiot", "moron", "scum", "trash"]
    word = lambda: f"w{rnd.randrange(1500)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)]
    shared = [" ".join(word() for _ in range(7)) for _ in range(12)]
    docs, labels = [], []
    for i in range(500):
        lines = [" ".join(word() for _ in range(rnd.randrange(3, 15))) for _ in range(rnd.randrange(1, 10))]
        if rnd.random() < 0.2:
            a = rnd.randrange(8)
            lines[1:1] = shared[a : a + 4]
        toxic = rnd.random() < 0.15
        if toxic:
            lines = [x + f" {rnd.choice(bad)} " + word() for x in lines]
        if rnd.random() < 0.1:
            lines.insert(0, rnd.choice(items)[1])
        if i > 20 and rnd.random() < 0.15:
            lines = [(docs[rnd.randrange(10, i)][1] or "").replace("\n", " ") + " " + word()]
        if i > 20 and rnd.random() < 0.08:
            lines = (docs[rnd.randrange(10, i)][1] or "").split("\n")
        text = None if i in (3, 4) else "" if i == 5 else "\n".join(lines)
        docs.append((i, text, "en", rnd.choice(["a", "b", "c", None]), len(text or "")))
        if rnd.random() < 0.7:
            labels.append((i, 1, int(any(b in (text or "").split() for b in bad))))
    return docs, labels, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in df.select(*COLUMNS).collect()]
        out = stage(spark, df, sf)
        if name != "mixing":
            assert out.columns == COLUMNS
            out.write.parquet(f"{sf}/{name}")
            df = spark.read.parquet(f"{sf}/{name}")
            after = {r.doc_id: r for r in df.collect()}
            assert len(after) == df.count()
            state[name] = (len(before), len(after))
        if name == "toxicity":
            model = train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r[0] for r in before if model.score([(r[1] or "").encode()])[0] < 0.5}
            assert set(after) == want
            truth = {r[0] for r in before if not {"idiot", "moron", "scum", "trash"} & set((r[1] or "").split())}
            assert truth <= want and len(want - truth) < 10
        elif name == "line_dedup":
            want = {d: t for d, t, n, gone in brute_lines([r[:2] for r in before]) if not gone or gone < n}
            assert {d: r.text for d, r in after.items()} == want
            assert all(r.n_chars == len(r.text or "") for r in after.values())
        elif name == "minhash_near_dedup":
            assert set(after) == {d for d, _, _, kept in brute_near([r[:2] for r in before], 5, 80) if kept}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in before} - {d for d, _ in brute_leaks([r[:2] for r in before], items)}
        else:
            got = out.collect()
            sizes = {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
            want = fill(sizes)
            by_id = {r[0]: r for r in before}
            assert {r.doc_id for r in got} == set(by_id)
            taken = dict.fromkeys(sizes, 0)
            for r in got:
                s = by_id[r.doc_id][3]
                taken[s] += r.taken
                assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
            assert all(abs(taken[s] - want[s]) < 150 for s in sizes)
    assert all(a > b for a, b in state.values()), state
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted(again) == sorted(got)


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
