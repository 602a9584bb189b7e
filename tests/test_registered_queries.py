"""Every registered query against its DuckDB SQL, and the shape of the registry."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest

from stowage.plans import queries as catalog

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    frame, want = catalog.QUERIES[name](spark, FOLDER), duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES[k] for c, k in frame.dtypes} == kinds
    order = [want.columns.index(c) for c in columns]
    got = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    assert len(frame.take(1)) == 1


def brute_matches(items, library):
    """item_key -> (status, reason, score, albumartist, album), by loops over all pairs; names here are ASCII."""
    from difflib import SequenceMatcher

    def title(name):
        name = re.sub(r"[(\[][^)\]]*\b(deluxe|remaster|edition)\b[^)\]]*[)\]]", " ", name or "", flags=re.I).lower()
        return re.sub("[^a-z0-9]+", " ", name).strip()

    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    words = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) if a and b else 0.0
    within = lambda a, b: min(len(a), len(b)) >= 3 and (f" {a} " in f" {b} " or f" {b} " in f" {a} ")
    shelf = sorted((r["ordinal"], title(r["albumartist"]), title(r["album"]), r["albumartist"], r["album"], r["ext_id"]) for r in library)
    out = {}
    for r in items:
        artist, name = title(r["artist"]), title(r["title"])
        by_id = [a for a in shelf if r["ext_id"] and a[5] == r["ext_id"]]
        mine = [a for a in shelf if a[1] == artist] or [a for a in shelf if words(a[1], artist) >= 0.6 or ratio(a[1], artist) >= 0.88]
        same, part = [a for a in mine if a[2] == name], [a for a in mine if within(name, a[2])]
        if by_id or same or part:
            best = (by_id or same or part)[0]
            out[r["item_key"]] = ("owned", "mbid" if by_id else "exact" if same else "contains", 1.0, best[3], best[4])
        elif not mine:
            out[r["item_key"]] = ("missing", "no matching artist", 0.0, None, None)
        else:
            score, _, a = max((max(words(name, a[2]), ratio(name, a[2])), -a[0], a) for a in mine)
            out[r["item_key"]] = (*(("uncertain", "similar title") if score >= 0.6 else ("missing", "no matching title")), score, *((a[3], a[4]) if score > 0 else (None, None)))
    return out


def test_matches_equal_loops_over_all_pairs_in_every_tier(spark):
    found = {r["item_key"]: (r["status"], r["reason"], pytest.approx(r["score"]), r["albumartist"], r["album"]) for r in catalog.QUERIES["match_cascade"](spark, FOLDER).collect()}
    items, shelf = (catalog.bound(spark, FOLDER, n).collect() for n in ("wanted", "shelf"))
    want = brute_matches(items, shelf)
    assert found == want
    assert {v[1] for v in want.values()} == {"mbid", "exact", "contains", "similar title", "no matching title", "no matching artist"}
    ignored = {f"c:{r['ordinal']}" for r in items if r["ordinal"] % 8 == 1}
    counts = Counter("ignored" if k in ignored and v[0] != "owned" else v[0] for k, v in want.items())
    assert {r["bucket"]: r["n"] for r in catalog.QUERIES["audit_buckets"](spark, FOLDER).collect()} == counts and len(counts) == 4


def plain_alignment(lines, duration):
    """[(time, confidence)] of a text's lines against its own words, spread evenly; by the library's matcher and loops."""
    from difflib import SequenceMatcher

    import regex

    token = regex.compile(r"[\p{L}\p{N}]+'?[\p{L}\p{N}]*")
    spoken = [t.lower() for t in token.findall("\n".join(lines))]
    step = duration * 0.9 / max(len(spoken), 1)
    start = [round(duration * 0.05 + k * step, 3) for k in range(len(spoken))]
    wanted = [[t.lower() for t in token.findall(regex.sub(r"\([^)]*\)", " ", x))] for x in lines]
    flat = [(n, t) for n, tokens in enumerate(wanted) for t in tokens]
    times, hits = [None] * len(lines), [0] * len(lines)
    for m in SequenceMatcher(None, spoken, [t for _, t in flat], autojunk=False).get_matching_blocks():
        for k in range(m.size):
            n = flat[m.b + k][0]
            times[n] = start[m.a + k] if times[n] is None else min(times[n], start[m.a + k])
            hits[n] += 1
    sure = [0.9 * hits[n] / len(wanted[n]) if wanted[n] else 0.0 for n in range(len(lines))]
    times = [t if c >= 0.5 else None for t, c in zip(times, sure)]
    known = [n for n, t in enumerate(times) if t is not None]
    out, top = [], 0.0
    for n, t in enumerate(times):
        if not known:
            t = duration * (n + 1) / (len(lines) + 1)
        elif t is None:
            gap = (times[known[-1]] - times[known[0]]) / (known[-1] - known[0]) if len(known) > 1 else 3.0
            if n < known[0]:
                t = max(0.0, times[known[0]] - (known[0] - n) * gap)
            elif n > known[-1]:
                t = times[known[-1]] + (n - known[-1]) * gap
            else:
                a, b = max(k for k in known if k < n), min(k for k in known if k > n)
                t = times[a] + (n - a) / (b - a) * (times[b] - times[a])
        top = max(top, t)
        out.append((max(0.0, min(duration, top)), sure[n]))
    return out


def test_alignment_equals_a_loop_over_each_text(spark):
    got = {(r["doc_id"], r["pos"]): (r["text"], r["time"], r["confidence"]) for r in catalog.QUERIES["align_words"](spark, FOLDER).collect()}
    texts = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect():
        texts.setdefault(r["conv_id"], []).append(r["text"])
    want = {(doc, n): (lines[n], pytest.approx(t, abs=0.0051), pytest.approx(c, abs=0.00051)) for doc, lines in texts.items() for n, (t, c) in enumerate(plain_alignment(lines, 180.0))}
    assert got == want and len(got) > 50


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_containing_rows_of_one_text_are_dealt_out(spark, tmp_path):
    """A name that all parts bear gives pairs in all tasks, and the rows of the SQL."""
    from pyspark.sql import functions as F

    part = spark.read.parquet(f"{FOLDER}/part.parquet").limit(1)
    part.crossJoin(spark.range(1500).withColumnRenamed("id", "k")).withColumns({"p_partkey": F.col("k"), "p_name": F.lit("red box")}).drop("k").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = catalog.QUERIES["token_contains"](spark, str(tmp_path)).withColumn("at", F.spark_partition_id()).cache()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert Counter(map(tuple, found.select("item_key", "ordinal").collect())) == Counter(connection.sql(f"SELECT item_key, ordinal FROM ({catalog.ORACLE_SQL['token_contains']}) x").fetchall())
    held = [r["count"] for r in found.groupBy("at").count().collect()]
    assert sum(held) > 1_000_000 and max(held) < sum(held) / 2
    found.unpersist()


def test_blocks_of_containing_rows_grow_with_the_rows(spark, monkeypatch):
    """Four times the rows of a text are as many blocks, and all their pairs."""
    from pyspark.sql import functions as F

    from stowage.operators import resolve

    monkeypatch.setattr(resolve, "SPREAD", 16)
    seen, blocks = [], resolve._blocks
    monkeypatch.setattr(resolve, "_blocks", lambda *a, **k: seen.append(k["size"]) or blocks(*a, **k))
    for n in (200, 800):
        a, b = (spark.range(n).select(F.col("id").alias(c), F.lit("red box").alias("text")) for c in "xy")
        found = resolve.containing_rows(a, b)
        assert found.count() == found.distinct().count() == n * n
    assert seen == [50, 50, 200, 200]
