import json
import os

from corpusloom.streaming import watch, work


def test_listing_and_offsets(tmp_path):
    """The source's reader: what changed between listings, again the same after a failure, nothing when all is still."""
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "m.js").write_text("1")
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "b.txt").write_text("1")
    reader = watch.WatchReader({"path": str(tmp_path)})
    changes = lambda rows: sorted((r[0], r[1]) for r in rows)
    rows, first = reader.read(reader.initialOffset())
    assert changes(rows) == [("a.txt", False), ("b.txt", False)]
    rows, same = reader.read(first)
    assert changes(rows) == [] and same == first
    (tmp_path / "a.txt").write_text("22")
    os.remove(tmp_path / "b.txt")
    rows, second = reader.read(first)
    assert changes(rows) == changes(reader.readBetweenOffsets(first, second)) == [("a.txt", False), ("b.txt", True)]


def test_watched_tree(spark, tmp_path):
    root, seen = tmp_path / "tree", []
    root.mkdir()
    (root / "a.txt").write_text("1")
    query = watch.watch(spark, str(root), lambda df, n: seen.extend((r["path"], r["delete"]) for r in df.collect()), str(tmp_path / "point"), "1 second")
    try:
        for _ in range(120):
            if seen or query.exception():
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert query.exception() is None and seen[:1] == [("a.txt", False)]


def test_coalesced_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", []
    inbox.mkdir()
    schema = "path string, delete boolean, priority int, kind string"

    def send(n, *rows):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "delete", "priority", "kind"), r))) for r in rows))
        stream = work.coalesced_stream(spark.readStream.schema(schema).json(str(inbox)))
        keep = lambda df, i: out.extend((r["path"], r["priority"], r["event"]) for r in df.collect())
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        try:
            query.awaitTermination(60)
        finally:
            query.stop()

    send(1, ("x", False, 0, "enqueue"), ("x", False, 100, "enqueue"), (None, False, 0, "enqueue"))
    send(2, ("x", False, 0, "claim"))
    send(3, ("x", False, 0, "enqueue"))
    send(4, ("x", False, 0, "complete"))
    assert [(p, e) for p, _, e in out] == [("x", "pending"), ("x", "claimed"), ("x", "pending"), ("x", "completed")] and out[0][1] == 100
