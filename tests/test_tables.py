import io
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import incremental, queueing, report, store
from corpusloom.plans import indexing
from corpusloom.sources import docsets, files


def test_snapshot_and_queue(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, s string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "path string, s string")
    assert dict(queueing.snapshot_diff(before, now, "path", "s").collect()) == {"b": "changed", "d": "added"}
    empty = spark.createDataFrame([], "path string, delete boolean, priority int, status string")
    ask = lambda p: spark.createDataFrame([("x", False, p)], "path string, delete boolean, priority int")
    queue = queueing.enqueue(queueing.enqueue(empty, ask(0)), ask(100))
    assert [(r["priority"], r["status"]) for r in queue.collect()] == [(100, "pending")]
    running = queue.withColumn("status", F.lit("in_progress"))
    assert queueing.enqueue(running, ask(0)).count() == 2


def test_stale_claims(spark):
    rows = [(1, 0, "in_progress", "other", "2024-01-01 00:00:00", 1), (2, 100, "in_progress", "me", "2024-01-01 00:00:00", 1), (3, 0, "pending", None, None, 0)]
    queue = spark.createDataFrame(rows, "id int, priority int, status string, owner string, claimed_at string, attempts int").withColumn("claimed_at", F.col("claimed_at").cast("timestamp"))
    now = F.lit("2024-01-01 00:00:30").cast("timestamp")
    after = queueing.reclaimed(queue, "me", now)
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "pending", 2: "in_progress", 3: "pending"}
    taken = queueing.claim(after, "me", now)
    assert {r["id"]: r["attempts"] for r in taken.collect()} == {1: 2, 2: 1, 3: 0}
    outcomes = spark.createDataFrame([(1, True), (3, True), (2, False), (2, True), (None, True)], "id int, done boolean")
    after = queueing.finished(taken, "me", outcomes)
    assert {r["id"]: (r["status"], r["owner"]) for r in after.collect()} == {2: ("pending", None), 3: ("pending", None)}
    again = queueing.renewed(queue, "me", spark.createDataFrame([(1,), (2,), (3,)], "id int"), F.lit("2024-01-01 00:00:20").cast("timestamp"))
    assert {r["id"]: str(r["claimed_at"])[-2:] for r in again.where("claimed_at is not null").collect()} == {1: "00", 2: "20"}
    assert queueing.lease(("you", 10.0), "me", 5.0) == (("you", 10.0), False) and queueing.lease(("you", 10.0), "me", 10.0)[1]


def test_batches(spark):
    rows = spark.createDataFrame([("l", i, s) for i, s in enumerate([3, 3, 9, 1, 1, 1])], "lane string, pos int, size int")
    made = queueing.batches(rows, "pos", "size", 2, 6, "lane").orderBy("pos").collect()
    assert [r["batch"] for r in made] == [0, 0, 1, 2, 2, 3]


def test_file_batches(spark):
    rows = spark.createDataFrame([("l", "a", 0, 3), ("l", "b", 1, 1), ("l", "a", 2, 3), ("l", "c", 3, 9), ("l", "d", 4, 1), ("m", "d", 5, None)], "lane string, file string, pos int, size int")
    made = queueing.file_batches(rows, "file", "pos", "size", 3, 7, "lane").collect()
    assert {(r["lane"], r["file"]): r["batch"] for r in made} == {("l", "a"): 0, ("l", "b"): 0, ("l", "c"): 1, ("l", "d"): 2, ("m", "d"): 0} and len(made) == 6


def test_lease(spark, tmp_path):
    path = f"file://{tmp_path}/lease"
    assert indexing.acquire(spark, path, "a", 10.0) and not indexing.acquire(spark, path, "b", 12.0) and indexing.acquire(spark, path, "a", 20.0)
    assert not indexing.acquire(spark, path, "b", 34.0) and indexing.acquire(spark, path, "b", 35.0) and not indexing.acquire(spark, path, "a", 36.0)


def test_ignore_rules(spark, tmp_path):
    for name, text in {".gitignore": "*.log\n/only\nout/\n!keep.log\n# x\ndocs/**/*.tmp\n", "sub/.gitignore": "local.*\n!a.log\n", "a.log": "", "keep.log": "", "only/x": "", "sub/only": "", "sub/out/y": "", "sub/a.log": "", "sub/local.py": "", "local.py": "", "docs/p/q/z.tmp": "", "z.tmp": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "x")
    got = {r["path"] for r in files.ignored_paths(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.log", "only/x", "sub/out/y", "sub/local.py", "docs/p/q/z.tmp"}


def test_escapes(spark):
    rows = spark.createDataFrame([("a/b",), ("../a",), ("a/../../b",), ("/a",), ("a/../b",), ("C:/x",), ("a\\b",), ("",), (".",), (None,)], "p string")
    assert [r[0] for r in rows.select(paths.escapes(F.col("p"))).collect()] == [False, True, True, True, False, True, True, True, True, True]


def test_download(tmp_path):
    target = str(tmp_path / "t")
    digest = docsets.download("u", target, None, lambda u: io.BytesIO(b"abc"), 0, 2)
    assert open(target).read() == "abc" and docsets.download("u", target, digest.upper(), lambda u: io.BytesIO(b"abc"), 0)
    with pytest.raises(ValueError):
        docsets.download("u", target, "0" * 64, lambda u: io.BytesIO(b"other"), 0)
    assert open(target).read() == "abc" and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_index_loop(spark, tmp_path):
    """Prepare, embed, recheck, commit: files that changed or went meanwhile aren't committed, failures are noted."""
    contents = {"a.py": "def f():\n    return 1\n", "b.py": "x = 1\n", "c.py": "y = 2\n", "bad.py": "boom\n"}
    read = lambda names: spark.createDataFrame([(p, contents[p]) for p in names if p in contents], "path string, contents string")
    store_ = indexing.Index(spark, str(tmp_path / "index"))

    def embedder(texts):
        contents["b.py"] = "changed = 1\n"
        contents.pop("c.py", None)
        if any("boom" in t for t in texts):
            raise ValueError("no vector")
        return [[float(len(t)), 1.0] for t in texts]

    done = store_.run(["a.py", "b.py", "c.py", "bad.py"], read, embedder)
    assert done == {"a.py": "indexed", "b.py": "requeued", "c.py": "deleted", "bad.py": "error"}
    units, vectors = store_.read("units"), store_.read("vectors")
    assert {r["file_path"] for r in units.collect()} == {"a.py"} and vectors.count() == units.count() == 1
    assert store_.run(["b.py", "a.py"], read, lambda ts: [[1.0, 2.0] for _ in ts]) == {"a.py": "indexed", "b.py": "indexed"}
    assert {(r["path"], r["status"], r["error"] is None) for r in store_.read("files").collect()} == {("a.py", "indexed", True), ("b.py", "indexed", True), ("bad.py", "error", False)}
    assert store_.purge(F.col("path") == "a.py") == 1 and {r["file_path"] for r in store_.read("vectors").collect()} == {"b.py"}


def test_docset_operations(spark, tmp_path):
    catalog_ = spark.createDataFrame([("py~3", 5, "r1", "3"), ("node", 7, "r1", None)], "slug string, mtime long, release string, version string")
    payload = lambda slug, text: spark.createDataFrame([(slug, json.dumps({"entries": [{"name": "A", "path": "a"}, {"name": "B", "path": "b"}]}), json.dumps({"a": f"<p>{text}</p>", "b": "<p>same</p>"}))], "slug string, index string, db string")
    shelf = indexing.Shelf(spark, str(tmp_path / "shelf"))
    assert shelf.install("py~3", catalog_, payload("py~3", "one")) and not shelf.install("py~3", catalog_, payload("py~3", "two"))
    assert shelf.install("py~3", catalog_, payload("py~3", "two"), force=True) and shelf.install("node", catalog_, payload("node", "n"))
    assert {(r["docset_slug"], r["name"]) for r in shelf.read("pages").collect()} == {("py~3", "A"), ("py~3", "B"), ("node", "A"), ("node", "B")}
    assert shelf.update(catalog_.withColumn("mtime", F.col("mtime") + 1).where("slug = 'node'"), lambda slug: payload(slug, "new")) == ["node"]
    assert "new" in shelf.read("pages").where("docset_slug = 'node' and name = 'A'").first()["markdown"]
    assert shelf.remove("py~3") == 2 and shelf.remove("py~3") == 0 and shelf.read("docsets").count() == 1
    with pytest.raises(KeyError):
        shelf.install("none", catalog_, payload("none", "x"))


def test_upsert_with_nulls(spark):
    table = spark.createDataFrame([("a", 1, "e"), ("b", 2, "e")], "k string, n int, error string")
    new = spark.createDataFrame([("a", None, None), ("c", 3, None)], "k string, n int, error string")
    assert {tuple(r) for r in store.upsert(table, new, "k", ("error",)).collect()} == {("a", 1, None), ("b", 2, "e"), ("c", 3, None)}


def test_store(spark, tmp_path):
    table = spark.createDataFrame([("a/__pycache__/x", 1), ("a/b", 2), ("c", None)], "path string, n int")
    assert {r["path"] for r in store.remove(table, "path", component="__pycache__").collect()} == {"a/b", "c"}
    new = spark.createDataFrame([("c", 5), ("d", 6)], "path string, n int")
    assert dict(store.upsert(table, new, "path").collect()) == {"a/__pycache__/x": 1, "a/b": 2, "c": 5, "d": 6}
    assert {r["side"] for r in store.drift(table, new, ["path"]).collect()} == {"missing", "orphan"}
    with pytest.raises(ValueError):
        store.checked_replace(table, new, "path", spark.createDataFrame([("d",)], "path string"), "path")
    store.rewrite(spark, table, str(tmp_path / "t"))
    store.rewrite(spark, new, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert store.needs_reset(["a"], ["a", "b"], ["b"]) == (False, ["b"]) and store.needs_reset(["a"], ["a", "c"], ["b"])[0]
    versions = [dict(store.index_version(df, ["g"], ["x"]).collect())["g"] for df in (spark.createDataFrame([("g", 1), ("g", 2)], "g string, x int"), spark.createDataFrame([("g", 2), ("g", 1)], "g string, x int"), spark.createDataFrame([("g", 2)], "g string, x int"))]
    assert versions[0] == versions[1] != versions[2]


def test_incremental_table(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    t = incremental.IncrementalTable(spark, str(tmp_path / "inc"), ["k"], ["v"], partitions=8)
    rows = [(f"k{i}", str(i)) for i in range(100)]
    calls = []

    def compute(df):
        calls.append(df.select("part").distinct().count())
        return df.withColumn("twice", F.concat("v", "v"))

    assert len(t.refresh(make(rows), compute)) == 8 and t.refresh(make(rows[::-1]), compute) == []
    rows[3] = ("k3", None)
    assert len(t.refresh(make(rows), compute)) == 1 and calls == [8, 1]
    assert {(r["k"], r["v"]) for r in t.read().collect()} == set(rows)
    kept = [r for r in rows if r[0] in ("k1", "k2")]
    t.refresh(make(kept), compute)
    assert {(r["k"], r["v"]) for r in t.read().collect()} == set(kept)

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t.refresh(make(kept + [("new", "1")]), broken)
    t.refresh(make(kept + [("new", "1")]), compute)
    assert t.read().count() == 3


def test_stale_records(spark):
    present = spark.createDataFrame([("a", "1"), ("b", None), ("c", "2"), ("d", "9")], "k string, v string")
    committed = spark.createDataFrame([("a", "1"), ("b", None), ("c", "x"), ("gone", "1")], "k string, v string")
    for size in (1, 1000):
        assert {r[0] for r in incremental.stale_records(present, committed, ["k"], "v", size).collect()} == {"b", "c", "d"}
    none = spark.createDataFrame([], "k string, v string")
    assert incremental.stale_records(none, committed, ["k"], "v").count() == 0
    assert incremental.stale_records(present, none, ["k"], "v").count() == 4


def test_refresh_that_leaves_nothing(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    t = incremental.IncrementalTable(spark, str(tmp_path / "inc"), ["k"], ["v"], partitions=4)
    some = lambda df: df.where("v <> 'no'")
    rows = [(f"k{i}", str(i)) for i in range(40)]
    t.refresh(make(rows), some)
    part = {r["k"]: r["part"] for r in t.read().collect()}
    gone = {k for k in part if part[k] == part["k0"]}
    now = [(k, "no" if k in gone else v) for k, v in rows]
    assert t.refresh(make(now), some) == [part["k0"]] and {r["k"] for r in t.read().collect()} == set(part) - gone
    assert t.refresh(make(now), some) == []
    t.refresh(make([(k, "no") for k, _ in rows]), some)
    assert t.read().count() == 0 and set(t.read().columns) == {"k", "v", "part"}
    t.refresh(make(rows), some)
    assert t.read().count() == 40


def test_records_that_arrive_during_a_refresh(spark, tmp_path):
    feed = tmp_path / "feed.txt"
    feed.write_text("".join(f"k{i} 1\n" for i in range(20)))

    def read(batches):
        for _ in batches:
            yield pd.DataFrame([line.split() for line in feed.read_text().splitlines()], columns=["k", "v"])

    records = lambda: spark.range(1).coalesce(1).mapInPandas(read, "k string, v string")  # noqa: E731  read anew each time
    t = incremental.IncrementalTable(spark, str(tmp_path / "inc"), ["k"], ["v"], partitions=2)

    def late(df):
        feed.write_text(feed.read_text() + "".join(f"late{i} 1\n" for i in range(20)))
        return df

    t.refresh(records(), late)
    assert t.read().count() == 20
    again = incremental.IncrementalTable(spark, str(tmp_path / "inc"), ["k"], ["v"], partitions=99)
    assert again.partitions == 2 and again.refresh(records(), lambda df: df) == [0, 1] and again.read().count() == 40
    assert again.refresh(records(), lambda df: df) == []


def test_refresh_of_nothing(spark, tmp_path):
    t = incremental.IncrementalTable(spark, str(tmp_path / "inc"), ["k"], ["v"])
    none = spark.createDataFrame([], "k string, v string, part_ string")
    assert t.refresh(none, lambda df: df) == [] and t.read().count() == 0
    odd = spark.createDataFrame([(None, None, "x"), ("", "", "x"), ("a", "1", None), ("a", "1", None)], "k string, v string, part_ string")
    t.refresh(odd, lambda df: df)
    assert t.read().count() == 4 and t.refresh(odd, lambda df: df) == []


def test_present_rows(spark):
    feed = spark.createDataFrame([("a", "old", None, 9), ("a", "new", "2024-01-01", 1), ("a", "later", "2024-01-01", 2), (None, "x", "2024-01-01", 3)], "k string, v string, updated_at string, seq long").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert incremental.present_rows(feed, ["k"], "v").collect() == [("a", "later")]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in {"src/a.py": b"x = 1\n", "src/nul.bin": b"a\x00b", "src/bad.txt": b"\xff\xfe\xff", "src/big.txt": b"x" * 600_000, "node_modules/m.js": b"1", "src/uv.lock": b"1", "src/ign.txt": b"1"}.items():
        (tmp_path / name).write_bytes(data)
    ignored = spark.createDataFrame([("src/ign.txt",)], "path string")
    rows = files.scan_tree(spark, f"file://{tmp_path}", ignored).collect()
    assert [(r["path"], r["contents"], r["size_bytes"]) for r in rows] == [("src/a.py", "x = 1\n", 6)]
    assert files.snapshot(spark, str(tmp_path)).count() == 7


def test_docsets(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps([{"name": "Python", "slug": "python~3.14", "alias": "Py", "mtime": 5}, {"name": "No slug"}, {"name": "Node", "slug": "node", "aliases": ["JS", " "]}]))
    rows = docsets.read_catalog(spark, str(tmp_path / "catalog.json")).collect()
    assert [(r["slug"], r["aliases"]) for r in rows] == [("node", ["js"]), ("python~3.14", ["py"])]
    index = json.dumps({"entries": [{"name": "A", "path": "a#x", "type": "T"}, {"path": "b"}, {"name": "none"}, {"name": "lost", "path": "zz"}]})
    db = json.dumps({"a": "<h1>A</h1><p>one</p>", "b": "<p>two</p>"})
    pages = docsets.pages_of(spark.createDataFrame([("s", index, db)], "slug string, index string, db string")).orderBy("pos").collect()
    assert [(p["name"], p["source_key"], p["type"]) for p in pages] == [("A", "a", "T"), ("b", "b", None)] and "one" in pages[0]["markdown"]
    texts = [json.dumps({"schema_version": 1, "docs": {"react_native": {"name": "R", "pageCount": 3, "content_format": "md"}}}), "nonsense", json.dumps({"schemaVersion": 9, "docs": {}})]
    got = docsets.manifest_docsets(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [(r["slug"], r["page_count"], r["content_format"]) for r in got] == [("react_native", 3, "md")]
    value, warning = docsets.catalog_or_copy(lambda: (_ for _ in ()).throw(OSError("no net")), lambda: b"[]")
    assert value == [] and "no net" in warning


def test_report(spark):
    df = spark.createDataFrame([("a<b", 1, None), ("c", 22, "x")], "name string, n int, gone string")
    assert df.select(report.as_json(["name", "gone"], {"name": "theName"})).first()[0] == '{"theName":"a<b"}'
    assert df.select(report.as_json(["gone"], drop_nulls=False)).first()[0] == '{"gone":null}'
    assert df.select(report.as_xml({"n": F.col("n")}, F.col("name"))).first()[0] == '<result n="1">a&lt;b</result>'
    assert [r["line"] for r in report.aligned(df, ["name", "n"]).orderBy("n").collect()] == ["a<b   1", "c     22"]
    assert report.joined(df, "name", "n", "[", ",", "]").first()[0] == "[a<b,c]"
