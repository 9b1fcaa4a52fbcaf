"""Operators over DataFrames: brute force, exact round trips, held-out accuracy, and awkward inputs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, components, handwritten, markup, neighbours, packing, reading, splitting, syntax


def brute_groups(edges):
    parent = {}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in parent}


@pytest.mark.parametrize("case", ["chain", "random", "hub", "empty"])
def test_components(spark, case, monkeypatch):
    rng = random.Random(2)
    ids = [f"{i:04d}" for i in range(400)]
    rng.shuffle(ids)
    edges = {
        "chain": list(zip(ids, ids[1:])),
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(180)] + [(None, "x"), ("y", None), ("z", "z")],
        "hub": [("hub", i) for i in ids] * 2 + [("a", "b")],
        "empty": [],
    }[case]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("cell", F.lit("clash")).withColumn("v", F.lit(1))
    monkeypatch.setattr(components.core, "MIN_CELL_LINKS", 20)
    for size in (40, 10_000, 3):  # a grid, one cell, and cells that are cut
        monkeypatch.setattr(components.core, "CELL_LINKS", size)
        assert dict(components.connected_components(df, cell_edges=size).collect()) == brute_groups(edges)


def test_links(spark):
    rows = [("a", "b", 0.92), ("a", "a", 1.0), ("c", "d", float("nan")), ("e", "f", None), ("g", None, 1.0), ("h", "i", 0.9199)]
    df = spark.createDataFrame(rows, "x string, y string, s double")
    assert components.links(df, "x", "y", "s", 0.92).collect() == [("a", "b")]


def test_neighbours_against_brute_force(spark, monkeypatch):
    """Families of near copies, exact copies, few cells: recall over all rows, and all ties by the smaller id."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 30)
    monkeypatch.setattr(neighbours, "PART_ROWS", 120)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(90, 64))
    x = np.repeat(centres, 10, axis=0) + rng.normal(size=(900, 64)) * 0.08
    x[5:13] = x[5]  # more copies than are asked for
    x[700] = 3 * x[701]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    rows += [rows[3], (2000, None), (2001, [1.0] * 63), (2002, [0.0] * 64), (2003, [float("nan")] + [1.0] * 63), (2004, [None] + [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("key", F.lit("clash"))
    got = neighbours.nearest_neighbours(neighbours.usable_vectors(df, "vec_id", "vector")).collect()
    pairs = {(r["vec_id"], r["neighbour_id"]) for r in got}
    assert len(pairs) == len(got) == 900 * 5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    want = {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), -np.floor(cos[i] / 1e-9 + 0.5)))[:5]}
    assert len(pairs & want) >= 0.97 * len(want)
    assert {j for i, j in pairs if i == 9} == {5, 6, 7, 8, 10} and {j for i, j in pairs if i == 5} == {6, 7, 8, 9, 10}


def test_ties_by_difference(spark):
    edge = 0.5 + 0.5e-9
    rows = [(1, 9, edge - 1e-12), (1, 3, edge + 1e-12), (1, 2, edge - 3e-12), (1, 7, 0.9), (1, 1, 0.1), (2, 5, 0.3), (2, 4, 0.3 - 2e-9)]
    df = spark.createDataFrame(rows, "q long, n long, cos double")
    assert [(r["q"], r["n"]) for r in neighbours._ranked(df, "q", "n", 3).orderBy("q", "cos", ascending=[True, False]).collect()] == [(1, 7), (1, 3), (1, 2), (2, 5), (2, 4)]


def test_neighbours_of_many_copies_and_divided_cells(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 60), ("LIST_ROWS", 20), ("PART_ROWS", 100), ("MIN_SAMPLE", 600)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 64)), np.ones((200, 64)), rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.05])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    run = lambda: {(r[0], r[1]) for r in neighbours.nearest_neighbours(neighbours.usable_vectors(df, "vec_id", "vector")).collect()}
    usual = run()
    monkeypatch.setattr(neighbours, "MANY_COPIES", 50)
    monkeypatch.setattr(neighbours, "MANY_SHARE", 0.0)
    assert run() == usual and len(usual) == 5 * len(x)
    cos = (u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T
    np.fill_diagonal(cos, -9)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -np.floor(cos[i] / 1e-9 + 0.5)))[:5]}
    assert len(usual & want) >= 0.95 * len(want)


def test_neighbours_of_lone_vectors(spark, monkeypatch):
    """Vectors without others near them are found whole, and are not sent to all cells."""
    for name, value in (("CELL_ROWS", 40), ("LIST_ROWS", 20), ("MIN_SAMPLE", 1000), ("TILE_LEADERS", 150), ("TILE_ROWS", 30)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(150, 64)), 8, axis=0) + rng.normal(size=(1200, 64)) * 0.1, rng.normal(size=(60, 64))])
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    written = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", kept)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got = {(r[0], r[1]) for r in neighbours.nearest_neighbours(neighbours.usable_vectors(df, "vec_id", "vector")).collect()}
    cos = (u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T
    np.fill_diagonal(cos, -9)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-cos[i])[:5]}
    lone = {(i, j) for i, j in want if i >= 1200}
    assert len(got) == 5 * len(x) and len(got & want) >= 0.99 * len(want) and len(got & lone) >= 0.95 * len(lone)
    sent = tables["own"].where("n = -1").groupBy("q").count().agg(F.max("count")).first()[0]
    assert sent <= 18  # to 16 parts, or to the leaders, and once as a leader
    assert "within" in tables


def test_leaders_reach_their_lists():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(60, 64)), 5, axis=0) + rng.normal(size=(300, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scan = neighbours.Scanner(x, np.arange(300), 5)
    rows, reach, held = scan.leaders()
    assert held.sum() == 300 and len(rows) < 300
    for members in scan.members:
        mine = np.isin(rows, members)
        far = np.linalg.norm(x[members][:, None] - x[rows[mine]][None], axis=2)
        assert (far <= reach[mine] + 1e-3).any(axis=1).all()
    q = rng.normal(size=(40, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    cos = q @ x[rows].T
    top, at = neighbours.highest(q.astype(np.float32), x[rows].astype(np.float32), np.full(40, -1.0), 6)
    assert np.allclose(-np.sort(-top, axis=1), -np.sort(-cos, axis=1)[:, :6], atol=1e-5) and np.allclose(np.take_along_axis(cos, at, axis=1), top, atol=1e-5)
    many = rng.normal(size=(9000, 64)).astype(np.float32) / 8  # several blocks, with few and with many above what is known
    for least in (-9.0, 1.2):
        some, at_some = neighbours.highest(q.astype(np.float32), many, np.full(40, least), 6)
        right = np.concatenate([np.full((40, 6), least), q @ many.T], axis=1)
        assert np.allclose(-np.sort(-some, axis=1), -np.sort(-right, axis=1)[:, :6], atol=1e-5)
        assert np.allclose(np.where(at_some >= 0, np.take_along_axis(q @ many.T, at_some, axis=1), least), some, atol=1e-5)
    bounds = neighbours.ranked_bounds(np.full(40, 2.0), top, at, reach, held, 6)
    assert (np.sort(np.linalg.norm(q[:, None] - x[None], axis=2), axis=1)[:, :6] <= bounds).all() and (bounds < 2).any()
    a, b = neighbours.reached(q, np.full(40, 1.2), x[rows], reach)
    sure, may = (np.sqrt(2 - 2 * cos) <= 1.2 + neighbours.REACH * reach + e for e in (-1e-5, 1e-4))
    hit = np.zeros_like(sure)
    hit[a, b] = True
    assert (hit | ~sure).all() and (may | ~hit).all() and hit.any()


def test_neighbours_of_few(spark):
    make = lambda rows: neighbours.usable_vectors(spark.createDataFrame(rows, "vec_id long, vector array<float>"), "vec_id", "vector")
    assert neighbours.nearest_neighbours(make([])).collect() == [] and neighbours.nearest_neighbours(make([(1, [1.0] * 64)])).collect() == []
    two = neighbours.neighbour_pairs(neighbours.nearest_neighbours(make([(1, [1.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)])))
    assert two.collect() == [(1, 2)]


def test_packing(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 8, 100, 300, 700, 1024, 2047, 2048, 2049, 9000, rng.randrange(2500)]) for _ in range(3000)] + [None, -3]
    rows = [(i % 2900, s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("container_id", F.lit("clash"))
    for capacity in (2048, 100):
        made = packing.pack(df, "doc_id", "n_tokens", capacity).toPandas()
        load = made.groupby("container_id").tokens.sum()
        total = sum(s for s in sizes if s and s > 0)
        assert load.max() <= capacity and made.tokens.sum() == total and (made.tokens <= capacity).all()
        assert capacity < 2048 or total / capacity / len(load) > 0.97
        whole = made[made.n_pieces > 1]
        assert (whole.tokens[whole.piece < whole.n_pieces - 1] == capacity).all() and (whole["first"] == whole.piece * capacity).all()
    assert packing.pack(df.where("false"), "doc_id", "n_tokens", 2048).count() == 0


@pytest.mark.parametrize("capacity,low,high,fill", [(256, 0, 256, 0.97), (2048, 3, 13, 0.99), (2048, 9, 26, 0.99), (2048, 20, 900, 0.99), (101, 1, 60, 0.98), (7, 1, 8, 0.9)])
def test_plan_uses_every_item_once(capacity, low, high, fill):
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(low, high, 20_000), minlength=capacity + 1)
    used, containers = np.zeros(capacity + 1, int), 0
    for need, times in packing.plan(histogram):
        assert sum(s * n for s, n in need.items()) <= capacity and times > 0
        containers += times
        for s, n in need.items():
            used[s] += n * times
    assert (used[1:] == histogram[1:]).all() and (histogram * np.arange(capacity + 1)).sum() >= fill * capacity * containers
    assert packing.plan(np.zeros(capacity + 1, int)) == []


def test_combinations_fill():
    lengths, times = packing.combinations(50, np.isin(np.arange(51), [3, 5, 11, 20, 34]))
    made = {tuple(sorted((int(s), int(n)) for s, n in zip(a, b) if s)) for a, b in zip(lengths, times)}
    assert len(made) == len(lengths) and ((5, 10),) in made and ((5, 1), (11, 1), (34, 1)) in made and ((5, 2), (20, 2)) in made
    assert all(sum(s * n for s, n in c) == 50 for c in made)


def test_nnls():
    rng = np.random.default_rng(2)
    present = np.isin(np.arange(51), [3, 5, 11, 14, 20, 34])
    lengths, times = packing.combinations(50, present)
    x = rng.integers(0, 9, len(lengths))
    target = np.zeros(51)
    np.add.at(target, lengths, times * x[:, None])
    made = packing.nnls((lengths, times), target, 5000)
    got = np.zeros(51)
    np.add.at(got, lengths, times * made[:, None])
    assert (made >= 0).all() and np.allclose(got[1:], target[1:], atol=1e-2)


def test_tokens_of_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "x" * 50_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = bpe.encode_texts(df, "doc_id", "text").collect()
    assert sorted((r[0] or 0, len(r[1])) for r in rows if r[0]) == [(1, 2), (2, 0), (3, 0), (3, 0)] and len(rows) == 5
    counts = bpe.token_counts(df, "doc_id", "text").collect()
    assert sorted(c["n_tokens"] for c in counts)[:4] == [0, 0, 0, 2]
    assert bpe.encode_texts(df.where("false"), "doc_id", "text").count() == 0


def test_splitting(spark):
    rows = [(1, "s", "p", 0, "word " * 100), (1, "s", "p", 0, "word " * 100), (2, "s", "p", 1, " \r\n x \r"), (3, "t", None, None, None), (4, None, "p", 2, "y" * 3000), (None, "s", "p", 0, "z")]
    chunks = spark.createDataFrame(rows, "id long, docset_slug string, page_id string, ordinal int, text string").withColumn("body", F.lit("clash"))
    config = spark.createDataFrame([("s", 120, 20, None, 3), ("t", None, None, None, None), ("t", None, None, None, None)], "docset_slug string, max_chunk_chars int, overlap_chars int, min_chunk_chars int, max_chunks_per_page int")
    made = splitting.split_chunks(chunks, config)
    got = made.toPandas()
    assert sorted(got[got.oversized & (got.piece == 0)].chunk_id) == [1, 4] and (got.text.str.len() <= got.chunk_id.map({1: 120, 2: 120, 3: 2400, 4: 2400})).all()
    assert got[got.chunk_id == 2].text.tolist() == ["x"] and got[got.chunk_id == 3].text.tolist() == [""]
    capped = splitting.cap_pages(made, splitting.largest_cap(config)).toPandas()
    assert len(capped[(capped.docset_slug == "s")]) == 3 and len(got[got.docset_slug == "s"]) > 3
    assert splitting.split_chunks(chunks.where("false"), config).count() == 0 and splitting.split_chunks(chunks, config.where("false")).count() > 0


def test_syntax(spark):
    rows = [("r/a.py", "r", "x = (", "h"), ("r/a.py", "r", "x = (", "h"), ("r/b.py", "r", "x = 1", None), ("r/c.go", None, None, None), ("r/d.js", "r", "(", "h"), (None, "r", "(", "h"), ("r/e.py", "r", "", "h")]
    df = spark.createDataFrame(rows, "path string, repo string, contents string, hash string").withColumn("language", F.lit("clash"))
    checked = syntax.check_files(df)
    got = {r["path"]: r for r in checked.collect()}
    assert {p: r["sound"] for p, r in got.items()} == {"r/a.py": False, "r/b.py": True, "r/c.go": False, "r/e.py": True}
    assert got["r/a.py"]["cause"] == "cut off" and got["r/a.py"]["faults"][0]["line"] == 1 and got["r/a.py"]["n_faults"] >= 1
    rate = {(r["repo"], r["language"]): (r["files"], r["unsound"]) for r in syntax.rates(checked).collect()}
    assert rate == {("r", "python"): (3, 1), (None, "go"): (1, 1)}
    assert syntax.check_files(df.where("false")).count() == 0


def test_undecided_files(spark):
    deep = "class A { int x = " + "(" * 20_000 + "1" + ")" * 20_000 + "; }"
    df = spark.createDataFrame([("r/A.java", "r", deep, "h"), ("r/B.java", "r", "class B {", "h")], "path string, repo string, contents string, hash string")
    checked = syntax.check_files(df)
    assert {r["path"]: (r["sound"], r["undecided"]) for r in checked.collect()} == {"r/A.java": (None, "nesting too deep"), "r/B.java": (False, None)}
    assert [r["path"] for r in checked.where("not sound").collect()] == ["r/B.java"]
    assert [(r["files"], r["unsound"], r["rate"], r["undecided"]) for r in syntax.rates(checked).collect()] == [(2, 1, 1.0, 1)]


CODE = "def walk(tree):\n    for node in tree:\n        yield node.name\n" * 5


def test_shared_trees(spark):
    names = ["one-api/lib/x/a.py", "one-api/lib/x/b.py", "two-web/copied/a.py", "two-web/copied/b.py", "one-web/own/a.py", "xlib/a.py", "xlib/b.py", "three/a.py"]
    rows = [(p, p.split("/")[0], CODE + "# " + p[-4], None) for p in names[:7]] + [("three/a.py", "three", CODE + "# other", None), ("three/e.py", "three", "", None), (None, "three", CODE, None)]
    df = spark.createDataFrame(rows, "path string, repo string, contents string, hash string").withColumn("digest", F.lit("clash"))
    seen = handwritten.not_by_hand(df)
    found = {r["path"] for r in handwritten.found_files(seen).collect()}
    assert found == {"one-api/lib/x/a.py", "one-api/lib/x/b.py", "two-web/copied/a.py", "two-web/copied/b.py", "one-web/own/a.py"}  # xlib is the source
    nodes = {r["node_path"]: r for r in handwritten.merkle_nodes(seen.select("repo", "path", "hash", "bytes")).collect()}
    assert nodes["one-api/lib/x"]["digest"] == nodes["two-web/copied"]["digest"] == nodes["xlib"]["digest"] and nodes["one-api"]["files"] == 2
    assert handwritten.found_files(handwritten.not_by_hand(df.where("false"))).count() == 0


def test_shared_trees_mark_small_files(spark):
    tree = {"lib/a.py": CODE, "lib/__init__.py": "", "lib/sub/b.h": "int b(void);\n"}
    alone = [("four/b.h", "int b(void);\n"), ("four/c.py", CODE + "# c"), ("four/__init__.py", "")]
    rows = [(f"{repo}/{p}", repo, c, None) for repo, up in (("one-api", ""), ("two-web", "src/")) for p, c in {up + k: v for k, v in tree.items()}.items()]
    rows += [(f"{repo}/own.py", repo, CODE + repo, None) for repo in ("one-api", "two-web")] + [(p, "four", c, None) for p, c in alone]
    df = spark.createDataFrame(rows, "path string, repo string, contents string, hash string")
    found = {r["path"] for r in handwritten.found_files(handwritten.not_by_hand(df)).collect()}
    assert found == {f"one-api/{p}" for p in tree} | {f"two-web/src/{p}" for p in tree}


def test_near_copies_of_trees(spark):
    """Copies with other line ends, in directories with a file that was changed and one that was added; small files of a tree count by its weight."""
    tree = {f"lib/{c}.py": f"value_{c} = compute(1, 2)\n\n\nname_{c} = 'some {c}'\n" for c in "abcdefghi"}
    rows = [(f"one-api/{p}", "one-api", c, None) for p, c in tree.items()] + [(f"two-web/x/y/{p}", "two-web", c.replace("\n", " \r\n"), None) for p, c in tree.items()]
    rows += [(f"two-web/x/y/lib/sub/{p}", "two-web", c, None) for p, c in (("a.py", "import lib\n"),)] + [("two-web/x/own.py", "two-web", "import y\n", None), ("one-api/own.py", "one-api", "import lib\n" * 9, None)]
    six = [(f"{repo}/{d}/{k}.py", repo, f"from . import other_module_{k}  # re-exported here as well\n", None) for repo, d in (("three-a", "p"), ("four-b", "q")) for k in range(6)]
    own = [("three-a/main.py", "three-a", "import p\n", None), ("four-b/main.py", "four-b", "import q, sys\n", None)]
    df = spark.createDataFrame(rows + six + own, "path string, repo string, contents string, hash string")
    found = {r["path"] for r in handwritten.shared_files(handwritten.not_by_hand(df).select("repo", "path", "hash", "bytes")).collect()}
    assert {p for p in found if p.split("/")[0] in ("three-a", "four-b")} == {r[0] for r in six}
    big = {f"lib/{c}.py": CODE + f"# {c}" for c in "abcdefghi"}
    rows = [(f"one-api/{p}", "one-api", c, None) for p, c in big.items()] + [(f"two-web/x/{p}", "two-web", c.replace("\n", " \r\n"), None) for p, c in big.items()]
    rows += [("two-web/x/lib/local.py", "two-web", CODE + "# local", None), ("one-api/own.py", "one-api", "import lib\n", None), ("two-web/own.py", "two-web", "import lib\n", None)]
    df = spark.createDataFrame(rows, "path string, repo string, contents string, hash string")
    found = {r["path"] for r in handwritten.shared_files(handwritten.not_by_hand(df).select("repo", "path", "hash", "bytes")).collect()}
    assert found == {r[0] for r in rows if r[0] not in ("one-api/own.py", "two-web/own.py")}  # with the file that was added


def test_markup_of_table(spark):
    same = "Home | Docs &amp; more"
    rows = [(i, "s", f"p{i}", 0, f"{same}\n\nOwn **words** of page {i}.") for i in range(30)] + [(5, "s", "p5", 0, f"{same}\n\nOwn **words** of page 5."), (99, None, None, None, None), (98, "s", "p1", 1, "plain"), (None, "s", "p", 0, "x")]
    df = spark.createDataFrame(rows, "id long, docset_slug string, page_id string, ordinal int, text string").withColumn("kinds", F.lit("clash"))
    got = {r["chunk_id"]: r for r in markup.clean_chunks(df).collect()}
    assert len(got) == 32 and got[7]["text"] == "Own words of page 7." and got[7]["removed"] == 1 and sorted(got[7]["kinds"]) == ["html", "markdown"]
    assert got[99]["text"] == "" and got[99]["kinds"] == [] and got[98]["text"] == "plain"
    assert markup.clean_chunks(df.where("false")).count() == 0


def test_markup_branches(spark):
    """Navigation goes as a branch, with its headings and lists and although its links vary a little; the same lists elsewhere stay."""
    def page(i):
        links = "".join(f"<li>{name}</li>\n" for name in ("Home", "Guide", "Blog", f"Page {i}"))
        return f'<div class="menu">\n<h3>Site</h3>\n<ul>\n{links}</ul>\n</div>\n<div class="body">\n<h1>About {i}</h1>\n<p>Text of page {i} <b>here</b>.</p>\n<ul>\n<li>Home</li>\n<li>own {i}</li>\n</ul>\n</div>'

    rows = [(i, "d", f"p{i}", 0, page(i)) for i in range(40)] + [(100 + i, "other", f"p{i}", 0, page(i)) for i in range(2)]
    got = {r["chunk_id"]: r for r in markup.clean_chunks(spark.createDataFrame(rows, "id long, docset_slug string, page_id string, ordinal int, text string")).collect()}
    assert got[7]["text"] == "# About 7\n\nText of page 7 here.\n\n- Home\n- own 7" and got[7]["removed"] == 5 and got[7]["kinds"] == ["html"]
    assert "Guide" in got[100]["text"] and got[100]["removed"] == 0  # two pages prove nothing


def test_markup_signs(spark):
    text = "Docset: D\nPage: p\n\n# Title\n\nSome *text*.\n\n## Sub\n\n- one\n- two\n\n```py\nif a:\n    b()\n```\n\n$$a_1$$\n\n<!-- note -->"
    row = markup.clean_chunks(spark.createDataFrame([(1, "d", "p", 0, text)], "id long, docset_slug string, page_id string, ordinal int, text string")).first()
    assert row["text"] == "Docset: D\nPage: p\n\n# Title\n\nSome text.\n\n## Sub\n\n- one\n- two\n\n    if a:\n        b()\n\na_1"
    assert row["kinds"] == ["html", "markdown", "latex"] and [b["kind"] for b in row["blocks"]] == ["heading1", "paragraph", "heading2", "list", "list", "code", "formula"]


def test_markup_of_long_blocks():
    begin = time.time()
    markup.Document("text of a line\n> quote\n" * 20_000)
    markup.Document("x = 1;\n# not a heading. \nplain words here\n" * 20_000)
    deep = markup.Document("<div>" * 5_000 + "deep" + "</div>" * 5_000)
    assert time.time() - begin < 20 and max(n[3].count("/") for n in deep.nodes) <= markup.DEPTH + 1


def test_markup_keeps_common_blocks(spark):
    same = "# Parameters\n\n```py\nrun(1)\n```\n\n- one\n- two\n\n$$a_1 \\le b$$"
    rows = [(i, "d", f"p{i}", 0, f"{same}\n\nPage number {i}.\n\n{'Often said.' if i < 60 else f'Said {i}.'}\n\nOn all pages.") for i in range(200)]
    got = markup.clean_chunks(spark.createDataFrame(rows, "id long, docset_slug string, page_id string, ordinal int, text string")).collect()
    for r in got:
        assert "Parameters" in r["text"] and "run(1)" in r["text"] and "- one" in r["text"] and "a_1" in r["text"]
        assert ("Often said." in r["text"]) == (r["chunk_id"] < 60)


def test_reading_levels(spark):
    rng = random.Random(8)
    words = {level: [f"{'abcdefgh'[level]}{a}{b}" for a in "klmn" for b in "opqrst"] for level in range(1, 6)}
    text = lambda level: " ".join(rng.choice(words[level]) + " the of and" for _ in range(60))
    truth = {i: 1 + i % 5 for i in range(500)}
    rows = [(i, text(level)) for i, level in truth.items()] + [(900, None), (901, ""), (902, "Der Befehl legt eine neue Datei an und die Liste ist nicht leer"), (903, "漢字 漢字"), (0, "x")]
    labels = [(i, level + (i % 17 == 0) * (1 if level < 5 else -1)) for i, level in truth.items() if i % 6 == 0] + [(0, 1), (77777, 3), (None, 2), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {r["doc_id"]: r for r in reading.levels(docs, spark.createDataFrame(labels, "doc_id long, level int")).collect()}
    held_out = [i for i in truth if i % 6]
    assert len(got) == 504 and sum(got[i]["level"] == truth[i] for i in held_out) >= 0.95 * len(held_out)
    assert [got[i]["level"] for i in (900, 901, 902, 903)] == [None] * 4
    assert reading.levels(docs.where("false"), spark.createDataFrame([], "doc_id long, level int")).count() == 0
    assert {r["level"] for r in reading.levels(docs.where("doc_id < 20"), spark.createDataFrame([], "doc_id long, level int")).collect()} == {3}
