import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalog, duplicates, embedding, lexical, ranking, vectors

TEXTS = ["install the module in a nested folder", "Modules are nested; install_config works", "", "Größe und Länge", "target arch and target_archive", "module module module", None]


def test_bm25_against_sqlite(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    db.executemany("insert into f(rowid, text) values (?, ?)", [(i, t or "") for i, t in rows])
    df = spark.createDataFrame(rows, "id long, text string")
    for terms in (["install", "module"], ["target_arch"], ["grosse", "nest"]):
        match = " OR ".join(f'"{t}"*' if "_" in t else f"{t}*" for t in terms).replace("_", " ")
        want = dict(db.execute("select rowid, bm25(f) from f where f match ?", (match,)).fetchall())
        got = dict(lexical.bm25(df, "id", ["text"], terms).collect())
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
        tokens = lexical.tokens_of(df, "id", ["text"])
        index = lexical.bm25_of_postings(lexical.postings(tokens, "id"), lexical.lengths(tokens, "id"), "id", terms)
        again = dict(index.collect())
        assert again.keys() == want.keys() and all(math.isclose(again[k], want[k], rel_tol=1e-9) for k in want)


def test_bm25_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert lexical.bm25(df, "id", ["text"], ["a"]).collect() == [] and lexical.bm25(df, "id", ["text"], []).collect() == []


def test_minmax_of_one_and_equal(spark):
    for rows in ([(1, -2.0)], [(1, -2.0), (2, -2.0)]):
        df = lexical.minmax(spark.createDataFrame(rows, "id long, rank double"))
        assert {r["lexical"] for r in df.collect()} == {1.0}


def test_hybrid_code(spark):
    semantic = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "id string, cosine double")
    words = spark.createDataFrame([("a", 1.0), ("c", 0.5)], "id string, lexical double")
    rows = {r["id"]: r for r in ranking.hybrid_code(semantic, words, "id", 10).collect()}
    assert rows["a"]["kind"] == "hybrid" and math.isclose(rows["a"]["score"], 0.93)
    assert math.isclose(rows["b"]["score"], 0.6) and math.isclose(rows["c"]["score"], 0.425)
    assert ranking.hybrid_code(semantic, words, "id", 0).count() == 1


def test_diversify_and_merge(spark):
    hits = spark.createDataFrame([("p1", 1, 0), ("p1", 2, 1), ("p2", 3, 2)], "page string, id int, pos int")
    assert [r["id"] for r in ranking.diversified(hits, ["page"], "pos", 2).orderBy("pos").collect()] == [1, 3]
    other = spark.createDataFrame([("p1", 1, 0), ("p3", 9, 1)], "page string, id int, pos int")
    assert [r["id"] for r in ranking.merged(hits, other, "id").orderBy("pos").collect()] == [1, 2, 3, 9]
    assert [r["id"] for r in ranking.in_order([3, 1, 3, 7], hits, "id").collect()] == [3, 1]


def test_cosines(spark):
    rows = [([1.0, 0.0], [0.5, 0.5]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([float("nan"), 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(vectors.cosine_or_null(F.col("a"), F.col("b")), vectors.cosine_or_zero(F.col("a"), F.col("b"))).collect()
    assert math.isclose(got[0][0], math.sqrt(0.5)) and [g[0] for g in got[1:]] == [None] * 4 and [g[1] for g in got[1:]] == [0.0] * 4


def test_pairs_above(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.01]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("a", [1.0, 0.0])], "id string, v array<double>")
    for block in (2, 100):
        assert [(r[0], r[1]) for r in vectors.pairs_above(df, "id", "v", 0.9, block).collect()] == [("a", "b")]
    empty = spark.createDataFrame([], "id string, v array<double>")
    assert vectors.pairs_above(empty, "id", "v", 0.9).collect() == []


def test_duplicates(spark):
    assert duplicates.parse_levels(["function,class", "file"]) == ("function", "class", "file") and duplicates.parse_levels(None) == ("function",)
    for bad in ("", "nope", "-0.1", "1.1"):
        with pytest.raises(ValueError):
            duplicates.parse_threshold(bad)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, v array<double>")
    got = duplicates.bounded_pairs(same, "id", "id", "v", 0.9, 2).collect()
    assert got and all(r["cosine"] >= 0.99 for r in got)
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(duplicates.signature_keys(F.col("v"))).first()[0]
    assert zero == ["zero-vector"]
    pairs = spark.createDataFrame([(i, i + 1, 0.95) for i in range(40)] + [(100, 101, 0.99)], "a long, b long, cosine double")
    assert {r["cluster"] for r in duplicates.clusters(pairs).collect()} == {0, 100}
    units = spark.createDataFrame([(i, f"f{i}") for i in range(102)], "id long, file_path string")
    report = duplicates.report(pairs, units, "id", ["file_path"])
    assert {(r["id"], r["links"]) for r in report.where("cluster = 0 and links = 1").collect()} == {(0, 1), (40, 1)}
    assert {tuple(r) for r in duplicates.summary(report).collect()} == {(0, 41, 40, 0.95, 0, 1), (100, 2, 1, 0.99, 100, 101)}


def test_near_pairs_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(60, 16)), 5, axis=0) + rng.normal(size=(300, 16)) * 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist()) for i in range(300)] + [(900, [1.0, 2.0]), (901, [1.0, 2.0]), (902, None), (903, []), (904, [0.0] * 16), (905, [float("nan")] * 16), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("cell", F.lit("clash"))
    for threshold in (0.9, 0.2):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if unit[i] @ unit[j] >= threshold} | {(900, 901)}
        for size in (12, 50, 5000):
            got = [(r[0], r[1]) for r in vectors.pairs_above(df, "id", "v", threshold, size).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    asked = df.where("id % 10 = 0")
    got = {(r[0], r[1]) for r in vectors.near_pairs(df, "id", "v", 0.9, asked, 12).collect()}
    assert got == {(i, j) for i in range(0, 300, 10) for j in range(300) if unit[i] @ unit[j] >= 0.9} | {(900, 900), (900, 901)}


def test_transient_pairs_leave_own_file(spark):
    given = spark.createDataFrame([("t", [1.0, 0.0], "x.py")], "id string, v array<double>, path string")
    stored = spark.createDataFrame([("s", [1.0, 0.0], "x.py"), ("o", [1.0, 0.0], "y.py")], "id string, v array<double>, path string")
    assert [(r[0], r[1]) for r in duplicates.transient_pairs(given, stored, "id", "v", "path", 0.9).collect()] == [("t", "o")]


def test_signatures_against_a_loop(spark, monkeypatch):
    """The windowed candidates equal those of a loop over entries and buckets."""
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, -1.0, 2.0]) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    keys = dict(df.select("id", duplicates.signature_keys(F.col("v"))).collect())
    want, buckets = set(), {}
    for i, _ in rows:
        k = max(1, -(-8 // (2 * len(keys[i]))))
        seen = []
        for phase in (0, 1):
            for key in keys[i]:
                bucket = buckets.get(key, [])
                for c in (bucket[::-1] if phase == 0 else bucket)[:k]:
                    if c not in seen and len(seen) < 8:
                        seen.append(c)
        want |= {(c, i) for c in seen}
        for key in keys[i]:
            buckets.setdefault(key, []).append(i)
    norms = {i: sum(x * x for x in v) for i, v in rows}
    for ranges, hot in ((100_000, 100_000), (9, 5)):  # whole buckets, and buckets in ranges with crowded ones
        monkeypatch.setattr(duplicates, "RANGE_ROWS", ranges)
        monkeypatch.setattr(duplicates, "HOT_ROWS", hot)
        got = {(r[0], r[1]) for r in duplicates.bounded_pairs(df, "id", "id", "v", -2.0, 8).collect()}
        assert got == {(a, b) for a, b in want if norms[a] and norms[b]}


def test_catalog(spark):
    docsets = spark.createDataFrame(
        [("python~3.13", "Python", None, "3.13", ["py"]), ("python~3.14", "Python", None, "3.14", ["py"]), ("node", "Node.js", "node", None, [" JS "])], "slug string, name string, type string, version string, aliases array<string>"
    )
    asked = spark.createDataFrame([("py",), ("nodejs",), ("PYTHON",), ("js",), ("what",)], "request string")
    assert dict(catalog.resolved(asked, docsets).collect()) == {"py": "python~3.14", "nodejs": "node", "PYTHON": "python~3.14", "js": "node"}
    rows = spark.createDataFrame([("node", 1), ("other", 2)], "docset_slug string, id int")
    assert catalog.in_scope(rows, docsets, ["what"]).count() == 0 and catalog.in_scope(rows, docsets, []).count() == 2


def test_embedding(spark):
    assert embedding.request_ranges(list("abcde"), 2, 100) == [(0, 2), (2, 4), (4, 5)]
    assert embedding.request_ranges(["aa", "bbb", "cccc", "d"], 9, 6, True)[:2] == [(0, 2), (2, 4)]
    for bad in ([], [{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [1]}], [{"index": 0, "embedding": ["x"]}, {"index": 1, "embedding": [1]}], [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1, 2]}]):
        with pytest.raises(ValueError):
            embedding.checked_vectors(bad, 2)
    df = spark.createDataFrame([(1, "aa"), (2, None), (3, "b")], "id long, text string")
    rows = {r["id"]: r for r in embedding.embedded(df, "text", lambda ts: [[float(len(t)), 0.0] for t in ts]).collect()}
    assert rows[1]["vector"] == [2.0, 0.0] and rows[2]["vector"] is None and rows[3]["norm"] == 1.0
