"""File and catalog sources on small folders; streams against their batch counterparts."""

import json

import pytest
from pyspark.sql import functions as F

from stowage.operators import lineage as batch
from stowage.sources import catalogs, files
from stowage.streaming import flows


@pytest.fixture
def folder(tmp_path):
    for name, content in {
        "A/X/01. One.flac": b"1", "A/X/01. One.lrc": b"[00:01.00]x\n", "A/X/02.MP3": b"22", "A/X/.nolrc": b"", "A/X/02.nolrc": b"", "A/X/Cover.jpg": b"j", "A/X/._01.flac": b"x", "A/X/notes.txt": b"t",
        "B/rip.log": b"l", "B/a.flac": b"1", "B/b.log": b"l", ".hidden/a.flac": b"1", "C/scan.png": b"p", "root.log": b"l", "loose.flac": b"1",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path)


def test_trees(spark, folder):
    listed = files.listing(spark, folder).cache()
    got = {(r["rel_path"], r["kind"], r["role"]) for r in files.tree(listed).where("rel_path like 'A/%'").collect()}
    assert got == {("A/X/01. One.flac", "audio", None), ("A/X/01. One.lrc", "sidecar", "lrc"), ("A/X/02.MP3", "audio", None), ("A/X/.nolrc", "sidecar", "nolrc"), ("A/X/02.nolrc", "sidecar", "nolrc"), ("A/X/Cover.jpg", "sidecar", "cover")}
    assert [r["rel_path"] for r in files.audio_in(listed, "A/X").collect()] == ["A/X/01. One.flac", "A/X/02.MP3"]
    assert [r["directory"] for r in files.album_directories(listed).collect()] == ["", ".hidden", "A/X", "B"]
    flat = listed.withColumn("rel_path", F.regexp_replace("rel_path", "^A/X", "A"))
    assert [tuple(r) for r in files.staging(flat).collect()] == [("dir", "A"), ("log", "B/b.log"), ("log", "root.log")]
    assert files.has_files(listed) and not files.has_files(listed.where("rel_path like '%.nolrc' and rel_path like '%/.%'"))
    marks = listed.select("rel_path", files.is_track_marker(F.col("rel_path")).alias("t"))
    assert {r["rel_path"] for r in marks.where("t").collect()} == {"A/X/02.nolrc"}
    assert [r["text"].rstrip("\n") for r in files.texts(spark, folder).collect()] == ["[00:01.00]x"]
    assert dict(listed.dtypes)["mtime_ns"] == "bigint" and listed.where("rel_path = 'A/X/02.MP3'").first()["byte_size"] == 2


@pytest.mark.parametrize(
    "text, want",
    [
        ("X Lossless Decoder\n\nXLD log\n\nPink / Animals (2018)\nUsed drive : A / B\n", ("Pink", "Animals (2018)")), ("Art / Alb : Sub\n", ("Art", "Alb : Sub")), ("Used drive : A / B\nPink / Animals\n", None),
        ("\n" * 20 + "Pink / Animals", None), ("no identity", None), (" / x\nA / B", ("A", "B")), ("A / B / C", ("A", "B / C")), ("", None),
    ],
)
def test_rip_logs(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(files.rip_identity(F.col("t")).alias("v")).first()["v"]
    assert (tuple(got) if got else None) == want


def test_listings_and_collections(spark, tmp_path):
    lines = spark.createDataFrame([(0, "A\x1fX\x1f1999\x1fid1"), (1, "A\x1f\x1f\x1f"), (2, "short\x1fx"), (3, "B\x1fY\x1f0\x1f")], "ordinal long, value string")
    assert [tuple(r) for r in catalogs.parse_listing(lines).orderBy("ordinal").collect()] == [(0, "A", "X", 1999, "id1"), (3, "B", "Y", None, None)]
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"items": [{"title": "T", "artist": " A ", "media": ["CD", "wax"], "year": "1991", "artist_alts": "B"}, {"title": " "}, {"id": 7, "title": "U", "media": "vinyl", "mb_release_id": "m"}]}))
    got = [(r["source_id"], r["artist"], r["media"], r["year"], r["artist_alts"], r["ext_id"]) for r in catalogs.read_hand_written(spark, str(path)).orderBy("ordinal").collect()]
    assert got == [("0", "A", ["cd", "other"], 1991, ["B"], None), ("7", "", ["vinyl"], None, [], "m")]
    path.write_text('[{"title": "T", "year": "soon"}]')
    with pytest.raises(Exception, match="invalid year"):
        catalogs.read_hand_written(spark, str(path)).collect()
    path.write_text('"nothing"')
    with pytest.raises(Exception, match="must be a list"):
        catalogs.read_hand_written(spark, str(path)).collect()


def test_cache_and_pages(spark, tmp_path):
    path = tmp_path / "cache.json"
    assert catalogs.cached_releases(spark, str(path), 0, 1) is None
    path.write_text(json.dumps({"fetched_utc": 1000.0, "releases": [{"id": 5, "basic_information": {"title": "T", "year": 0, "artists": [{"name": "A"}], "formats": [{"name": "CD"}], "labels": []}}]}))
    fresh = catalogs.cached_releases(spark, str(path), 1000.0 + 3599, 1)
    assert fresh.first()["id"] == 5
    assert catalogs.cached_releases(spark, str(path), 1000.0 + 3601, 1) is None and catalogs.cached_releases(spark, str(path), 9e9, 1, True) is not None
    path.write_text("corrupt")
    assert catalogs.cached_releases(spark, str(path), 0, 1, True) is None
    pauses, asked = [], []

    def fetch(page):
        asked.append(page)
        return {"retry_after": 300} if len(asked) == 2 else {"releases": [{"id": page}], "pagination": {"pages": 2}}

    assert catalogs.fetch_pages(fetch, pause=pauses.append) == [{"id": 1}, {"id": 2}] and asked == [1, 2, 2] and pauses == [pytest.approx(2.64), 300.0]
    with pytest.raises(RuntimeError):
        catalogs.fetch_pages(lambda page: {"retry_after": 1})
    with pytest.raises(ValueError, match="known"):
        catalogs.provider("nope", catalogs.PROVIDERS)


def test_ignore_list(spark, tmp_path):
    path = tmp_path / "ignored.json"
    assert catalogs.read_ignored(spark, str(path)).count() == 0
    rows = spark.createDataFrame([("b:1", "A", "T", "why", 5), ("a:1", None, "U", None, 6)], catalogs.IGNORED)
    path.write_text(catalogs.ignored_document(rows).first()["value"])
    assert {tuple(r) for r in catalogs.read_ignored(spark, str(path)).collect()} == {tuple(r) for r in rows.collect()}
    path.write_text("[1]")
    with pytest.raises(Exception, match="malformed"):
        catalogs.read_ignored(spark, str(path)).collect()


def test_stored_and_foreign_tables(spark, tmp_path):
    spark.createDataFrame([("A", "X"), ("A", ""), ("A", None)], "albumartist string, album string").write.parquet(str(tmp_path / "albums"))
    assert catalogs.stored_albums(spark, str(tmp_path / "albums")).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalogs.stored_albums(spark, str(tmp_path / "none")).count()
    assert catalogs.foreign_index(spark, str(tmp_path / "none")).count() == 0
    report = spark.createDataFrame([("k", "owned", "exact", 0.66666, False, "A", "X")], "item_key string, status string, reason string, score double, ignored boolean, albumartist string, album string")
    assert json.loads(catalogs.report(report).first()["value"])["score"] == 0.667


def test_config():
    got = catalogs.parse_config('[sync]\nmin_copies = 2\n[core]\nname = "x"\n', {"STOWAGE_SYNC_DRY_RUN": "yes", "STOWAGE_SYNC_MIN_COPIES": "3"}, {"sync": {"dry_run": False, "min_copies": 1}})
    assert got == {"sync": {"dry_run": True, "min_copies": 3}, "core": {"name": "x"}}


def stream(spark, frame, path, parts):
    """A file stream of ``frame`` in as many batches, by its column ``part``."""
    for i in range(parts):
        frame.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(spark, df, mode, name, path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_lineage_stream_equals_batches(spark, tmp_path):
    passes = [[(1, 1, "a", "s1"), (1, 2, "b", "s1"), (2, 1, "a", "t1")], [(1, 1, "a", "s2")], [(1, 2, "b", "s3"), (2, 1, "a", "t2")]]
    frame = spark.createDataFrame([(*r, i) for i, rows in enumerate(passes) for r in rows], "doc_id long, location_id long, actor string, sha string, part int")
    out = collected(spark, flows.lineage(stream(spark, frame, str(tmp_path / "in"), 3)), "append", "held_now", str(tmp_path / "cp")).collect()
    for doc in (1, 2):
        held, _, head = batch.folded_batches([[(p, a, s) for d, p, a, s in rows if d == doc] for rows in passes if any(r[0] == doc for r in rows)])
        last = {tuple(r)[1:] for r in out if r["doc_id"] == doc and r["sha"] == held[-1][2]}
        assert (*held[-1], head) in last
    late = [r for r in out if r["sha"] == "s3"]
    assert late[0]["is_concurrent"] and not late[0]["is_head"]


def test_completeness_stream(spark, tmp_path):
    frame = spark.createDataFrame([("k", 1, 2, 0), ("j", 1, 1, 0), ("k", 2, 2, 1)], "album_key string, disc_no int, disc_total int, part int")
    out = collected(spark, flows.completeness(stream(spark, frame, str(tmp_path / "in"), 2)), "update", "ready_now", str(tmp_path / "cp")).collect()
    assert {(r["album_key"], r["have"], r["need"], r["ready"]) for r in out} == {("k", 1, 2, False), ("j", 1, 1, True), ("k", 2, 2, True)}


def test_triggers_fire_once(spark, tmp_path):
    frame = spark.createDataFrame([("a.log", 0, 0), ("Dir", 1, 0), ("Dir/x.flac", 2, 0), ("a.log", 3, 1), (".tmp", 4, 1), ("d/b.log", 5, 1)], "rel_path string, s long, part int").select("rel_path", F.timestamp_seconds("s").alias("ts"), "part")
    rows = flows.progress(stream(spark, frame, str(tmp_path / "in"), 2), "seen")
    out = collected(spark, flows.triggers(rows), "append", "fired_now", str(tmp_path / "cp"))
    assert sorted(r["rel_path"] for r in out.collect()) == ["Dir", "a.log", "d/b.log"]


def test_listing_goes_down_until_there_are_folders_enough(spark, tmp_path, monkeypatch):
    from stowage.sources import files

    for i in range(3):
        for j in range(4):
            (tmp_path / "one" / f"a{i}" / f"b{j}" / "c").mkdir(parents=True)
            (tmp_path / "one" / f"a{i}" / f"b{j}" / "c" / "x.flac").write_text("x" * j)
            (tmp_path / "one" / f"a{i}" / "._skip").write_text("")
    (tmp_path / "top.log").write_text("t")
    want = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("._")}
    for spread in (1, 2, 5, 100):
        monkeypatch.setattr(files, "SPREAD", spread)
        got = [r["rel_path"] for r in files.listing(spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(want)
    assert [r["rel_path"] for r in files.listing(spark, str(tmp_path), recursive=False).collect()] == ["top.log"]


def test_only_one_run_flies(spark, tmp_path):
    import os
    import time

    from stowage.streaming.flows import single_flight

    path = f"file://{tmp_path}/locks/run.lock"
    with single_flight(spark, path) as first:
        with single_flight(spark, path) as second:
            assert first and not second
        assert os.path.exists(tmp_path / "locks" / "run.lock")
    with single_flight(spark, path) as again:
        assert again
    (tmp_path / "locks" / "run.lock").write_text("")
    os.utime(tmp_path / "locks" / "run.lock", (time.time() - 500, time.time() - 500))
    with single_flight(spark, path) as held, single_flight(spark, path, stale_seconds=100) as taken:
        assert not held and taken


def test_a_document_reads_each_state_once_and_none_when_new():
    """Round trips to the state: none but the head's for a new document, each value once for a known one; same fold."""
    import pandas as pd

    from stowage.operators.lineage import folded_batches
    from stowage.streaming.flows import Documents

    reads = []

    class State:
        def __init__(self, name, *_):
            self.name, self.kept, self.value = name, {}, None

        containsKey = lambda self, k: reads.append((self.name, k)) or k in self.kept
        getValue = lambda self, k: self.kept.get(k)
        updateValue = lambda self, k, v: self.kept.__setitem__(k, v)
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    class Handle:
        getMapState = getValueState = lambda self, name, *_: State(name)

    document = Documents(None)
    document.init(Handle())
    batches = [[(1, "p", "a"), (2, "q", "a"), (3, "r", "b")], [(1, "p", "c"), (2, "q", "d"), (3, "r", "b")]]
    for n in (0, 1):
        reads.clear()
        (out,) = document.handleInputRows((7,), iter([pd.DataFrame(batches[n], columns=["location_id", "actor", "sha"])]), None)
        assert len(reads) == len(set(reads)) and (n or not reads)
    held, _, head = folded_batches(iter(batches))
    assert [tuple(r)[1:] for r in out.itertuples(index=False)] == [(*h, head) for h in held]
