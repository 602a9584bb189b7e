import random

from pyspark.sql import functions as F

from stowage.operators.ordered import append_numbered, sums_before


def test_sums_before_equal_a_loop_over_ranges(spark):
    rng = random.Random(3)
    values = rng.sample(range(10_000), 500)
    rows = [(v, rng.choice([None, 1, 5, 10**12])) for v in values]
    got = sums_before(spark.createDataFrame(rows, "k long, x long").repartition(7), ["k"], {"x_before": F.col("x"), "n_before": F.lit(1).cast("long"), "d": F.col("x").cast("decimal(38,0)")}, ranges=6)
    assert got.columns == ["k", "x", "x_before", "n_before", "d"]
    total, want = 0, []
    for i, (k, x) in enumerate(sorted(rows)):
        want.append((k, x, total, i, total))
        total += x or 0
    assert sorted((k, x, a, b, int(c)) for k, x, a, b, c in map(tuple, got.collect())) == want


def test_sums_before_follow_the_order_given(spark):
    rows = spark.createDataFrame([("b", 1), (None, 2), ("a", 4), ("é", 8)], "k string, x long")
    got = sums_before(rows, [F.col("k").asc_nulls_last()], {"s": F.col("x")}, ranges=3)
    assert {r["k"]: r["s"] for r in got.collect()} == {"a": 0, "b": 4, "é": 5, None: 13}
    down = sums_before(rows, [F.col("k").desc_nulls_first()], {"s": F.col("x")}, ranges=3)
    assert {r["k"]: r["s"] for r in down.collect()} == {None: 0, "é": 2, "b": 10, "a": 11}
    assert sums_before(rows.limit(0), ["k"], {"s": F.col("x")}).count() == 0


def test_appended_rows_get_dense_ids_after_the_last(spark):
    table = spark.createDataFrame([(3, "old", 1), (41, "older", 2)], "id int, kind string, extra int")
    fresh = spark.createDataFrame([(99, f"k{i:03}") for i in range(200)], "id int, kind string").repartition(5)
    got = append_numbered(table, fresh, ["kind"])
    assert got.schema == table.schema
    rows = {r["kind"]: r["id"] for r in got.collect()}
    assert rows["old"] == 3 and [rows[f"k{i:03}"] for i in range(200)] == list(range(42, 242))
    again = {r["kind"]: r["id"] for r in append_numbered(table, fresh.repartition(3), ["kind"]).collect()}
    assert again == rows
    assert [r["id"] for r in append_numbered(table.limit(0), fresh.limit(1), ["kind"]).collect()] == [1]
    assert append_numbered(table, fresh.limit(0), ["kind"]).count() == 2


def test_spread_times_can_be_had_before_they_are_rounded(spark):
    from stowage.operators.sequence import spread_tokens

    docs = spark.createDataFrame([(1, " ".join(["w"] * 160), 180.0)], "doc_id long, text string, duration double")
    raw = {r["pos"]: r["start"] for r in spread_tokens(docs, rounded=False).collect()}
    assert raw == {i: 180.0 * 0.05 + i * (180.0 * 0.9 / 160) for i in range(160)}
    assert {r["pos"]: r["start"] for r in spread_tokens(docs).collect()}[7] == 16.088 and round(raw[7] * 1000) == 16087


def test_aligned_lines_come_in_parts(spark, monkeypatch):
    from stowage.operators import sequence

    lines = spark.createDataFrame([(d, p, f"w{p} v{d}") for d in range(5) for p in range(3)], "doc_id long, pos int, text string")
    words = spark.createDataFrame([(d, p, f"w{p}", p * 2.0, 1.0) for d in range(5) for p in range(3)], "doc_id long, pos int, text string, start double, confidence double")
    whole = sorted(sequence.align(lines, words).collect())
    monkeypatch.setattr(sequence, "LINES_AT_ONCE", 4)
    assert sorted(sequence.align(lines, words).collect()) == whole and len(whole) == 15
