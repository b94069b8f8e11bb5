import hashlib
import random
import re
import time

from ridgeline.llm import secret_scan
from ridgeline.llm.common import scratch_path
from ridgeline.llm.secret_scan import BASE_RULES, read_ledger, scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def texts():
    rnd = random.Random(7)
    parts = ["password", "PassWD", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "abcdefgh", "a1-_/+=", "AKIA", "AKIA1234567890AB", "f" * 31, "0a" * 16, "é", "𝄞", "\u0001", "\u0002", "\n", "x.y", "K"]
    out = [None, "", "\u0001", "password: token: abcdefgh1", "é𝄞 token==abcdefgh", "AKIA" * 9, "secret='" + "ab" * 40_000]
    out += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(600)]
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "b", "c", 1) for i, t in rows], "doc_id long, text string, blob string, content string, at int").repartition(3)
    path = scratch_path(spark, "ledger")
    got = scan(df, path, "doc_id", "text", rules=BASE_RULES)
    got = {r.path: [tuple(s) for s in r.spans] for r in got.collect()}
    for i, t in rows:
        assert got[i] == brute(t), t
    n_blobs = len({hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows})
    assert read_ledger(spark, path).count() == n_blobs


def test_increment(spark, monkeypatch):
    path = scratch_path(spark, "ledger")
    key = "token=abcdefgh12"
    one = spark.createDataFrame([("a", key), ("b", "none"), ("c", key), ("c", key), (None, key)], "path string, content string")
    first = scan(one, path)
    assert sorted((r.path or "", len(r.spans)) for r in first.collect()) == [("", 1), ("a", 1), ("b", 0), ("c", 1), ("c", 1)]
    before = read_ledger(spark, path).count()
    two = spark.createDataFrame([("d", key), ("e", "new AKIA1234567890ABCD")], "path string, content string")
    second = scan(two, path)
    assert sorted((r.path, [s.kind for s in r.spans]) for r in second.collect()) == [("d", ["assign"]), ("e", ["access"])]
    assert read_ledger(spark, path).count() == before + 1
    third = scan(two, path, rule_version="next")
    assert third.count() == 2 and read_ledger(spark, path).count() == before + 3
    assert scan(two.limit(0), path).count() == 0


def test_query_digest(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[:60])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secret_scan.op9_secret_scan(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = brute(t)
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, _, k, _ in want) for x in ("assign", "access", "hex"))
        assert set(base.split(",")) <= set(got[i].spans.split(",")) | {""}


def test_one_row_is_scanned_a_blob(spark, tmp_path):
    rows = [(1, "token=abcdefgh1")] * 50 + [(i, "token=abcdefgh1") for i in range(20)] + [(None, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    ledger = scratch_path(spark, "ledger")
    spark.conf.set("spark.ridgeline.ledger", ledger)
    try:
        for _ in range(2):
            got = secret_scan.op9_secret_scan(spark, str(tmp_path)).collect()
            assert len(got) == len(rows) and sum(r.n_assign for r in got) == 70
            assert read_ledger(spark, ledger).count() == 2
    finally:
        spark.conf.unset("spark.ridgeline.ledger")


def test_many_matches_in_one_text(spark):
    text = "x token=abcdefgh1 é" * 32_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scan(df.limit(0), scratch_path(spark, "ledger"), "doc_id", "text").collect()
    began = time.perf_counter()
    spans = scan(df, scratch_path(spark, "ledger"), "doc_id", "text").first().spans
    assert time.perf_counter() - began < 5
    assert [tuple(s) for s in spans] == brute(text)
