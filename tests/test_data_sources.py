"""Pages, SQLite tables and file events as data sources."""

import json
import os
import sqlite3
import time
from pathlib import Path

import pytest

from stowage.sources import events, paged, sqlite


def service(folder, pages, per_page=10, refuse=()):
    """A service that logs each request as a file; pages in ``refuse`` are over the limit at first."""

    def fetch(url, headers):
        page = int(url.rsplit("=", 1)[1])
        log = Path(folder) / f"{page}"
        log.mkdir(parents=True, exist_ok=True)
        asked = len(list(log.iterdir()))
        (log / f"{time.time_ns()}-{os.getpid()}").touch()
        if page in refuse and not asked:
            return 429, {"Retry-After": "7"}, b""
        if page > pages:
            return 500, {}, b""
        rows = [{"id": (page - 1) * per_page + i, "basic_information": {"title": f"T{(page - 1) * per_page + i}"}} for i in range(per_page)]
        return 200, {}, json.dumps({"releases": rows, "pagination": {"pages": pages}}).encode()

    return fetch


def asked(folder):
    return {int(p.name): len(list(p.iterdir())) for p in Path(folder).iterdir()} if Path(folder).exists() else {}


def test_a_thousand_pages_are_read_by_tasks_and_asked_once(spark, tmp_path):
    log, waits = str(tmp_path / "log"), tmp_path / "waits"
    waits.mkdir()
    pause = lambda s: (waits / f"{time.time_ns()}-{os.getpid()}-{s:.1f}").touch()
    paged.register(spark, "pages_a", service(log, 1000, refuse={1, 500}), pause)
    options = {"url": "http://x/?page={page}", "cache": f"file://{tmp_path}/cache", "streams": 8, "requestsPerMinute": 6e9}
    got = paged.releases(spark, per_page=10, name="pages_a", **options)
    assert got.rdd.getNumPartitions() == 8
    rows = {(r["ordinal"], r["id"], r["basic_information"]["title"]) for r in got.collect()}
    assert rows == {(i, i, f"T{i}") for i in range(10_000)}
    assert asked(log) == {p: 1 + (p in (1, 500)) for p in range(1, 1001)}
    assert sum(p.name.endswith("-7.0") for p in waits.iterdir()) == 2
    assert len({p.name.split("-")[1] for p in Path(log).glob("*/*")}) > 1 or spark.sparkContext.defaultParallelism == 1
    # Again: from the cache, fresh or at any age, and only what is missing is asked for.
    os.remove(tmp_path / "cache" / "page-00000007.json")
    (tmp_path / "cache" / "page-00000008.json").write_text('{"cut')
    assert got.count() == 10_000 and asked(log)[7] == 2 and asked(log)[8] == 2 and asked(log)[9] == 1
    paged.register(spark, "pages_b", service(str(tmp_path / "none"), 3), pause, clock=lambda: time.time() + 10 * 24 * 3600)
    assert paged.releases(spark, name="pages_b", mode="cached", **options).count() == 10_000 and not asked(tmp_path / "none")
    assert paged.releases(spark, name="pages_b", **options).count() == 30 and asked(tmp_path / "none") == {1: 1, 2: 1, 3: 1}
    assert paged.releases(spark, name="pages_b", mode="refresh", **options).count() == 30 and asked(tmp_path / "none")[2] == 2
    assert paged.releases(spark, name="pages_b", mode="cached", url="", cache=f"file://{tmp_path}/empty").count() == 0


def test_streams_keep_within_one_budget():
    """Requests of all streams, put in order of time, are a pace apart, whichever stream is slow."""
    made = []
    for first in (1, 2, 3):
        now = [100.0]
        reader = paged.PageReader({"url": "{page}", "requestsPerMinute": "60", "mode": "refresh"}, lambda url, h: made.append((now[0], int(url))) or (200, {}, b'{"pagination": {"pages": 9}}'), lambda s: now.__setitem__(0, now[0] + s), lambda: now[0])
        list(reader.read(paged.Streamed(first, 3, 9)))
    times = sorted(t for t, _ in made)
    assert [p for _, p in sorted(made)] == list(range(1, 10)) and all(b - a >= 1.1 - 1e-9 for a, b in zip(times, times[1:]))


def test_options_are_known_in_any_case(spark, tmp_path):
    """Spark hands options over in lower case; a rate or an age that is given must not fall back on the default."""
    fetch = service(str(tmp_path / "log"), 3)

    def no_wait(seconds):
        assert seconds < 1, f"waits {seconds} s at 6e9 requests a minute"

    paged.register(spark, "pages_c", fetch, no_wait)
    options = {"url": "http://x/?page={page}", "cache": f"file://{tmp_path}/cache", "streams": 2, "requestsPerMinute": 6e9, "ttlHours": 300}
    assert paged.releases(spark, per_page=10, name="pages_c", **options).count() == 30
    paged.register(spark, "pages_d", fetch, no_wait, clock=lambda: time.time() + 10 * 24 * 3600)
    assert paged.releases(spark, per_page=10, name="pages_d", **options).count() == 30 and set(asked(tmp_path / "log").values()) == {1}
    assert paged.PageReader({"useragent": "me"}, None, None, None).headers["User-Agent"] == "me"


@pytest.mark.parametrize("status, said", [(404, "no such collection"), (401, "needs a token"), (403, "needs a token"), (503, "HTTP 503"), (429, "rate limit")])
def test_what_a_page_says_is_told(status, said):
    waits = []
    reader = paged.PageReader({"url": "u{page}", "attempts": "3"}, lambda url, h: (status, {"retry-after": "soon"}, b""), waits.append, lambda: 0.0)
    with pytest.raises(paged.FetchError, match=said):
        reader.partitions()
    assert waits == ([60.0, 60.0] if status == 429 else [])
    with pytest.raises(paged.FetchError, match="is no page"):
        paged.PageReader({"url": "u{page}"}, lambda url, h: (200, {}, b"<html>"), waits.append, lambda: 0.0).partitions()
    with pytest.raises(ValueError, match="known"):
        paged.PageReader({"mode": "maybe"}, None, None, None)


def test_waits():
    now = 1_700_000_000.0
    assert [paged.wait_for({"Retry-After": v}, now) for v in ("5", "1e9", "-3", "", "soon", "nan", "Tue, 14 Nov 2023 22:13:50 GMT")] == [5.0, 300.0, 0.0, 60.0, 60.0, 60.0, 30.0]


def test_sqlite_tables_in_ranges(spark, tmp_path):
    path = str(tmp_path / "lib #1?.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, path BLOB, note TEXT, score REAL)")
        db.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", [(i * 3, f"/m/{i}é".encode() if i % 2 else f"/m/{i}é", None if i % 5 else f"n{i}", i / 2) for i in range(5000)] + [(99_999, None, None, None), (99_998, b"", None, None)])
        db.execute('CREATE TABLE "odd ""name" (k TEXT PRIMARY KEY, "a b" INTEGER) WITHOUT ROWID')
        db.execute('INSERT INTO "odd ""name" VALUES (\'x\', 4)')
        db.execute("CREATE TABLE bare (id INTEGER)")
    before = os.stat(path).st_mtime_ns
    got = sqlite.foreign_items(spark, path, partitions=6)
    assert got.rdd.getNumPartitions() == 6 and got.schema.simpleString() == "struct<path:binary,item_id:bigint>"
    assert {(bytes(r["path"]).decode(), r["item_id"]) for r in got.collect()} == {(f"/m/{i}é", i * 3) for i in range(5000)}
    read = lambda table, **o: spark.read.format("sqlite_table").options(path=path, table=table, **o).load()
    whole = read("items")
    assert [f.dataType.simpleString() for f in whole.schema] == ["bigint", "binary", "string", "double"] and whole.count() == 5002
    assert whole.where("note is not null").selectExpr("sum(score)").first()[0] == sum(i / 2 for i in range(0, 5000, 5))
    assert [tuple(r) for r in read('odd "name').collect()] == [("x", 4)] and read("bare").count() == 0
    assert os.stat(path).st_mtime_ns == before
    with sqlite3.connect(path) as db:
        db.executemany("INSERT INTO bare VALUES (?)", [("text",), (7,), (1.5,), (b"b",), (1 << 62,)])
    cells = lambda kind: sorted((r[0] for r in spark.read.format("sqlite_table").schema(f"id {kind}").options(path=path, table="bare").load().collect()), key=repr)
    assert cells("int") == [7, None, None, None, None] and cells("double") == [1.5, 4.611686018427388e18, 7.0, None, None] and cells("string") == sorted(["text", "7", "1.5", "b", str(1 << 62)], key=repr)


def test_a_foreign_catalog_that_cannot_be_read_is_empty(spark, tmp_path):
    (tmp_path / "text.db").write_text("no database" * 1000)
    with sqlite3.connect(tmp_path / "other.db") as db:
        db.execute("CREATE TABLE items (name TEXT)")
        db.execute("INSERT INTO items VALUES ('x')")
    for name in ("missing.db", "text.db", "other.db"):
        assert sqlite.foreign_items(spark, f"file://{tmp_path}/{name}").count() == 0
    with pytest.raises(Exception, match="there is no file"):
        spark.read.format("sqlite_table").schema("id long").options(path=str(tmp_path / "missing.db"), table="items", strict="true").load().count()


def test_changes_tell_renames_from_new_files():
    before = {"a": (False, 5, 1), "b": (False, 6, 2), "same": (False, 1, 1), "d": (True, 0, 1), "twin1": (False, 9, 9), "twin2": (False, 9, 9), "empty": (False, 0, 3)}
    after = {"a2": (False, 5, 1), "b": (False, 7, 3), "same": (False, 1, 1), "d": (True, 0, 2), "twin3": (False, 9, 9), "void": (False, 0, 3), "c": (False, 4, 4)}
    assert [(e[0], e[1], e[2]) for e in events.changes(before, after)] == [("renamed", "a2", "a"), ("updated", "b", None), ("created", "c", None), ("updated", "d", None), ("created", "twin3", None), ("created", "void", None)]
    assert events.changes(after, after) == []


def run(spark, root, state, out, fail=None):
    """One start of the query: all that is new, then it stops."""

    def keep(batch, number):
        if fail and fail(number):
            raise RuntimeError("lost")
        batch.selectExpr("event", "rel_path", "old_path", "is_dir", f"{number} AS batch").write.mode("append").json(str(out))

    flow = spark.readStream.format("file_events").options(path=str(root), state=f"{state}/journal").load().writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    flow.awaitTermination()


def test_a_restarted_watch_misses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(events, "PART", 2)
    events.register(spark)
    root, state, out = tmp_path / "import", tmp_path / "state", tmp_path / "out"
    (root / "Album").mkdir(parents=True)
    for name in ("a.log", "b.log", "c.log", "Album/x.flac", "._a.log"):
        (root / name).write_text(name)
    seen = lambda: {(r["event"], r["rel_path"], r["old_path"] if "old_path" in r else None) for r in rows()} if out.exists() else set()
    rows = lambda: [r.asDict() for r in spark.read.json(str(out)).collect()]
    run(spark, root, state, out)
    first = {("created", p, None) for p in ("a.log", "b.log", "c.log", "Album", "Album/x.flac")}
    assert seen() == first and len(rows()) == 5
    run(spark, root, state, out)
    assert len(rows()) == 5
    (root / "d.log").write_text("new")
    (root / "a.log").rename(root / "z.log")
    (root / "b.log").write_text("longer than before")
    with pytest.raises(Exception, match="lost"):
        run(spark, root, state, out, fail=lambda number: True)
    (root / "e.log").write_text("while it was down")
    (root / "c.log").unlink()
    run(spark, root, state, out)  # the batch that was lost, as it was planned
    assert seen() == first | {("created", "d.log", None), ("renamed", "z.log", "a.log"), ("updated", "b.log", None)}
    run(spark, root, state, out)
    later = {("created", "d.log", None), ("renamed", "z.log", "a.log"), ("updated", "b.log", None), ("created", "e.log", None)}
    assert seen() == first | later and len(rows()) == 9
    (root / "c.log").write_text("c.log")
    run(spark, root, state, out)
    assert seen() == first | later | {("created", "c.log", None)} and len(rows()) == 10
