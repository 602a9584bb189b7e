from collections import defaultdict
from fractions import Fraction

import pytest

from stowage.llm import mixing
from tests.llm.conftest import SCHEMA


def filled(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Targets by name: sources above their stop are set there and leave, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, found = share * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > most * sizes[s]}
        if not over:
            return found | {s: each * weight[s] for s in open_}
        for s in over:
            found[s] = Fraction(most * sizes[s])
            left -= found[s]
        open_ -= over
    return found


@pytest.mark.parametrize("sizes", [{"b": 100, "a": 10, None: 40, "é": 0, "z": 1000, "Z": 7}, {"a": 5}, {"a": 0, "b": 0}, {None: 3}, {f"s{i}": 1 + (i * i) % 97 for i in range(60)}, {f"s{i}": 10**14 for i in range(9)}])
def test_targets_equal_a_loop(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == {s: float(t) for s, t in filled(sizes).items()}


def mixed(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z", "w", "v", "u") for i, t, s in rows], SCHEMA).repartition(5)
    return [tuple(r) for r in mixing.mix(docs, **kw).collect()]


def test_sources_meet_their_targets_and_documents_their_limit(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 40)), f"s{i % 4}" if i % 3 else "hot") for i in range(900)]
    rows += [(5000, "long " * 3000, "s1"), (5001, None, "s1"), (5002, "", None), (5003, "a b\x0bc", None), (None, "x y", "s2"), (None, "x y", "s2"), (7, "x", "tail")]
    got = mixed(spark, rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {i: s for i, _, s in rows if i != 7}
    assert len(got) == len(rows)
    for doc, size, whole, goal, took in got:
        s = source.get(doc) if doc != 7 or whole != 1 else "tail"
        s = "s3" if doc == 7 and whole != 1 else s
        s = "s2" if doc is None else s
        sizes[s] += size
        taken[s] += took
        target[s] = goal
        assert 0 <= took <= 2 * size
    assert {s: float(t) for s, t in filled(dict(sizes)).items()} == target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert sorted(mixed(spark, rows[::-1]), key=repr) == sorted(got, key=repr)
    partial = [(s, r) for r in got for s in [source.get(r[0])] if r[1] and r[4] % r[1]]
    assert len(partial) <= len(target)  # only the last document of a sample gives part of its words
    assert sorted(mixed(spark, rows, seed="other"), key=repr) != sorted(got, key=repr)


def test_small_and_empty_tables(spark):
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, None, None)]) == [(1, 0, 0, 0.0, 0)]
    assert sorted(mixed(spark, [(1, "a b c d", "x")])) == [(1, 4, 4, 6.0, 6)]
    assert sorted(mixed(spark, [(i, "same text", "x") for i in range(10)], share=(1, 2)))[0][3] == 10.0


def test_the_sample_is_spread_over_documents(spark):
    got = mixed(spark, [(i, "one two", "s") for i in range(2000)], share=(1, 2))
    taken = [doc for doc, _, _, _, took in got if took]
    assert len(taken) == 1000 and all(took in (0, 2) for *_, took in got)
    assert all(100 <= sum(low <= d < low + 250 for d in taken) <= 150 for low in range(0, 2000, 250))
