"""Archives: round trips, order and loser trees. Vectors: exactness, recall, ties, and vectors that take no part."""

import hashlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stowage.llm import ann, warc


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(2000):
        runs = [sorted(rng.choices(range(15), k=rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_members_and_records():
    bodies = [bytes([i]) * (i * 997) for i in range(60)]
    records = [warc.record(i if i else None, f"http://A.com/{i}\r\n", b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]
    got = list(warc.members(io.BytesIO(b"".join(records))))
    assert [n for _, n, _ in got] == [len(r) for r in records]
    assert [warc.parsed(c)["page_id"] for *_, c in got] == [None, *range(1, 60)]
    broken = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parsed(next(warc.members(io.BytesIO(broken)))[2])
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(records[5][:-4])))


def test_url_keys():
    assert warc.url_key("https://M.Example.com:443/a?B#c") == "com,example,m)/a?b"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == warc.url_key("") == "-)/"


@pytest.mark.parametrize("few", [100_000, 0])
def test_round_trip(spark, monkeypatch, few):
    """Half of the pages have one payload; repeated digests are sent to all, or meet in salted parts."""
    monkeypatch.setattr(warc, "SEGMENT", 4000)
    monkeypatch.setattr(warc, "BROADCAST", few)
    rng = random.Random(2)
    big = "é" * 700
    pages = [(i, rng.choice(["http://b.org/x", "http://a.org/y", None, "http://[bad"]), rng.choice([None, "", "tiny", big, big + "2", f"<p>{i}</p>" * 300])) for i in range(120)]
    pages += [(119, *pages[119][1:]), (None, "http://a.org/null", big), (500, "http://z.org", big), (500, "http://z.org", big)]
    pages += [(i, "http://hot.org/", big) for i in range(600, 720)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, offset string, run int").repartition(5)
    got = warc.archive_round_trip(frame).collect()
    top = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, i), i)
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        refers = top[html] if i is not None and html in top and top[html] > i else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    urls = {}
    for i, url, _ in pages:
        urls.setdefault(i, url)
    ordered = [(warc.url_key(urls[r["page_id"]]), warc.stamp(r["page_id"])) for r in sorted(got, key=lambda r: (r["range"], r["place"]))]
    assert ordered == sorted(ordered)


def test_external_merge_of_many_runs_in_small_buffers(spark, monkeypatch):
    """More runs than a task merges and runs longer than a buffer: several passes, and the order of a plain sort."""
    for name, value in {"RUN_ROWS": 40, "BLOCK_ROWS": 7, "FAN_IN": 4, "LEAST_RANGE": 50}.items():
        monkeypatch.setattr(warc, name, value)
    passes, merge_pass = [], warc.merge_pass
    monkeypatch.setattr(warc, "merge_pass", lambda *a, **b: passes.append(b["last"]) or merge_pass(*a, **b))
    rng = random.Random(8)
    hosts = ["hot.org"] * 6 + ["a.com", "b.com", "é.net", "z.io"]
    pages = [(i if i % 50 else None, f"http://{rng.choice(hosts)}/{rng.randint(0, 30)}", "x") for i in range(1200)] + [(7, "http://hot.org/1", "x")] * 60
    folder = "file:///tmp/checkpoints/warc-merge-test"
    warc.remove(spark, folder)
    blocks = warc.cut(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), folder))
    assert blocks.select("run").distinct().count() > 16 and blocks.where("captures > 7").isEmpty()
    index = warc.merge_runs(blocks, folder).collect()
    assert passes[-1] and passes.count(False) >= 2
    assert len({r["range"] for r in index}) > 2
    got = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0, r["segment"], r["offset"]) for r in sorted(index, key=lambda r: (r["range"], r["place"]))]
    assert got == sorted(got)
    assert Counter(g[:4] for g in got) == Counter((warc.url_key(u), warc.stamp(i), i is not None, i or 0) for i, u, _ in pages)
    places = Counter((r["range"], r["place"]) for r in index)
    assert max(places.values()) == 1
    warc.remove(spark, folder)


def test_a_merge_reads_one_block_of_each_run_at_a_time(tmp_path):
    import pyarrow.fs as pafs

    store, held = pafs.LocalFileSystem(), []
    rows = sorted((f"k{i % 13}", "2020", True, i, "s", i, 1) for i in range(5000))
    writer = warc.RunWriter(store, str(tmp_path), "a.run", 1)
    for r in rows:
        writer.add(r)
    blocks = [(file, at, size) for _, file, at, size, *_ in writer.close()]
    assert len(blocks) == -(-5000 // warc.BLOCK_ROWS)

    class Counted:
        def open_input_file(self, path):
            held.append(path)
            return store.open_input_file(path)

    stream = warc.read_blocks(Counted(), str(tmp_path), blocks, None, None)
    assert [next(stream) for _ in range(warc.BLOCK_ROWS)] == rows[: warc.BLOCK_ROWS] and len(held) == 1
    assert list(stream) == rows[warc.BLOCK_ROWS :]
    low, high = rows[1000][:4], rows[3000][:4]
    assert list(warc.read_blocks(store, str(tmp_path), blocks, low, high)) == rows[1000:3000]


def test_archives_go_once_read_unless_kept(spark):
    import glob
    import os

    from stowage.llm.common import shared_dir

    pages = spark.createDataFrame([(i, f"http://a.org/{i}", "x" * 2000) for i in range(20)], "page_id long, url string, html string")
    held = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/warc-*"))
    before = held()
    assert warc.archive_round_trip(pages).count() == 20 and held() == before
    kept = warc.archive_round_trip(pages, keep=True)
    assert kept.where("record_type = 'revisit'").count() == 19
    (folder,) = held() - before
    assert any(f.endswith(".warc.gz") for f in os.listdir(folder)) and not any(f.endswith(".part") for f in os.listdir(folder))
    warc.remove(spark, f"file://{folder}")


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute(rows, k=5):
    import numpy as np

    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-(good[q] * v).sum() / (np.sqrt((good[q] ** 2).sum()) * np.sqrt((v**2).sum())), i) for i, v in good.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("chunk", [1 << 15, 40])
def test_nearest_neighbours_are_exact_on_small_tables(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    rng = random.Random(3)
    vector = lambda: [float(rng.randint(-3, 3)) for _ in range(6)]
    rows = [(i, vector()) for i in range(300)] + [(300 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(60)]
    rows += [(1000, None), (1050, [0.0] * 6), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [float("nan")] + [1.0] * 5), (1200, [float("inf")] + [1.0] * 5), (None, vector())]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, c1 int, chunk int").repartition(4)
    got = {}
    for r in ann.search(frame, lambda c: c % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert set(got) == set(want)
    for q, found in want.items():
        assert [(i) for _, i, _ in sorted(got[q])] == [i for i, _ in found], q
        assert [s for *_, s in sorted(got[q])] == pytest.approx([s for _, s in found], abs=1e-12)


def test_recall_on_the_test_table(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    local = rows.toPandas()
    x = np.array(local["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = local["vec_id"].to_numpy()
    got = {}
    for r in ann.search(rows, lambda c: c % 50 == 0, least=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[i]
        scores[i] = -2
        hits.append(len(got[ids[i]] & set(ids[np.argsort(-scores)[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0]), (50, [0.0, 2.0])], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, lambda c: c % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert ann.search(few.limit(0), lambda c: c % 50 == 0).count() == 0
    assert ann.search(few.limit(1).select(F.lit(None).cast("long").alias("vec_id"), "embedding"), lambda c: c % 50 == 0).count() == 0


def test_vectors_of_any_size_length_and_repeats(spark):
    """Numbers whose squares vanish or overflow count, lengths do not mix, repeated ids count once each."""
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1e-200, 0.0]), (1, [3e200, 3e200]), (2, [5e-324, 0.0]), (3, [-1e300, 1e-300]), (3, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.search(spark.createDataFrame(rows, schema), lambda c: c % 50 == 0).collect()]
    half = round(0.5**0.5, 12)
    assert sorted(got) == [(0, 1, 2, 1.0), (0, 2, 1, half), (0, 3, 3, 0.0), (0, 4, 3, -1.0), (50, 1, 51, half)]


def test_walk_goes_by_rising_sum():
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = rng.random(9), rng.random(9)
    books = ann.Codebooks(None, None, np.ones((9, 9), int))
    walked = list(books.walk(a, b, 81))
    sums = [a[i] + b[j] for i, j in walked]
    assert len(set(walked)) == 81 and sums == sorted(sums)
