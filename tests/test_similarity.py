import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stowage.functions.text import tokens
from stowage.operators import similarity
from stowage.operators.resolve import close_artists, sequence_ratio


def names(seed, n, words, spread):
    """Names of few words, some of them misspelled by up to three letters, so that many are close."""
    rng = random.Random(seed)
    out = {"a", "ab", "ba", "abc", "aab", "x" * 50, "日本語の歌手", "日本語の歌", "o" * 130 + "p" * 20}
    while len(out) < n:
        text = list(" ".join(rng.choices(words, k=rng.randint(1, spread))))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "e", "1"])
        out.add(" ".join("".join(text).split()))
    return sorted(out - {""})


WORDS = ["brand", "12", "13", "economy", "34", "35x", "the", "band", "of", "holy", "é", "ivory", "international", "orchestra", "bb", "king", "ab", "abba"]


@pytest.fixture(scope="module")
def sides():
    return names(1, 260, WORDS, 5), names(2, 220, WORDS, 5) + names(3, 30, WORDS, 24)


def frame(spark, texts, column="text"):
    return spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], f"{column} string").repartition(3)


@pytest.mark.parametrize("least", [0.88, 0.7])
def test_no_pair_that_reaches_the_ratio_is_lost(spark, sides, least):
    left, right = sides
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= least}
    met = similarity.ratio_candidates(frame(spark, left), frame(spark, right), least)
    got = [tuple(r) for r in met.collect()]
    assert want <= set(got) and len(got) == len(set(got))
    assert any(len(a) + len(b) > similarity.LETTERS_TO for a, b in want) and any(len(a) + len(b) < 8 for a, b in want)
    assert {tuple(r) for r in met.where(sequence_ratio("a", "b") >= least).collect()} == want
    if least == 0.88:
        assert len(got) < 0.1 * len(left) * len(right)


@pytest.mark.parametrize("least", [0.6, 1.0, 0.34])
def test_similar_words_equal_all_pairs(spark, sides, least):
    left, right = sides
    index = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    got = [tuple(r) for r in similarity.similar_words(frame(spark, left), frame(spark, right), least, tokens).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in left for b in right if index(a, b) >= least}


def test_close_artists_are_close_by_words_or_letters(spark, sides):
    left, right = sides
    words = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    got = {tuple(r) for r in close_artists(frame(spark, right, "key"), frame(spark, left, "key")).collect()}
    assert got == {(a, b) for a in left for b in right if words(a, b) >= 0.6 or SequenceMatcher(None, a, b).ratio() >= 0.88}


def test_pairs_meet_once_however_the_elements_are_ordered(spark):
    rows = spark.createDataFrame([("p", ["a", "b", "c", "d", "e"]), ("q", ["b", "c", "d", "e", "f"]), ("r", ["x", "y", "z", "a", "b"])], "text string, e array<string>")
    met = similarity.meeting(rows, rows, "e", lambda n: F.lit(2), 3, F.lit(True))
    assert sorted((r["a"], r["b"]) for r in met.collect()) == [("p", "p"), ("p", "q"), ("q", "p"), ("q", "q"), ("r", "r")]
    assert similarity.ratio_candidates(rows.limit(0), rows, 0.88).count() == 0


def test_closest_albums_in_blocks_equal_a_loop_over_pairs(spark, monkeypatch):
    from difflib import SequenceMatcher

    from stowage.operators import resolve

    monkeypatch.setattr(resolve, "BLOCK", 2)
    names = ["blue ring opus 1", "blue ring opus 2", "hot bolt opus 12", "hot bolt", "zq12", "", "ab"]
    shelf = [(f"a{k % 2}", t, (k, "x", t)) for k, t in enumerate(names * 2)]
    albums = spark.createDataFrame(shelf, "lib_artist string, lib_title string, m struct<ordinal:long,albumartist:string,album:string>")
    wanted = {"p": ["blue ring opus 1b"], "q": ["hot bolt opus 12 extra"], "r": ["zq21", "opus"], "s": [], "t": ["ab cd", "2 opus ring"]}
    titles = spark.createDataFrame([(i, t) for i, ts in wanted.items() for t in ts], "item_key string, title_key string")
    met = spark.createDataFrame([(i, a) for i in wanted for a in (("a0", "a1") if i != "q" else ("a1",))], "item_key string, lib_artist string")
    got = {r["item_key"]: (r["tier"], round(r["score"], 9), r["m"]["ordinal"] if r["score"] else None) for r in resolve._closest(met, titles, albums).collect()}
    for i, ts in wanted.items():
        found = [(3, 0.0, 0)]
        for a, t, m in shelf:
            for w in ts if t and (i != "q" or a == "a1") else ():
                x, y = set(w.split()), set(t.split())
                within = min(len(w), len(t)) >= 3 and (f" {w} " in f" {t} " or f" {t} " in f" {w} ")
                score = 1.0 if within else max(len(x & y) / len(x | y), SequenceMatcher(None, w, t).ratio())
                found.append((2 if within else 3, -score, m[0]))
        tier, minus, at = min(found)
        assert got[i] == (tier, round(-minus, 9), at if minus else None), i


def test_items_of_close_artists_meet_shelves_once_and_find_the_first_best(spark, monkeypatch):
    from stowage.operators import resolve

    for name, size in (("BLOCK", 2), ("SHELF", 9), ("ASKED", 1)):
        monkeypatch.setattr(resolve, name, size)
    shelf = [(f"a{k % 20}", f"{w} ring opus {k}", (k, "x", f"t{k}")) for k, w in enumerate(["blue", "hot", "old", "blue"] * 15)]
    wanted = {"p": "hot ring opus 37", "q": "hot ring opus 9 extra", "r": "zq31", "s": "old ring opus 22b", "t": None, "u": "hot ring opus 1"}
    key = {i: "far" if i in "pqrst" else "small" for i in wanted}
    close = {"far": [f"a{k}" for k in range(18)], "small": ["a3", "a2"]}
    albums = spark.createDataFrame(shelf, "lib_artist string, lib_title string, m struct<ordinal:long,albumartist:string,album:string>")
    met = spark.createDataFrame(list(key.items()), "item_key string, key string")
    titles = spark.createDataFrame([x for x in wanted.items() if x[1]], "item_key string, title_key string")
    near = spark.createDataFrame([(k, a) for k, every in close.items() for a in every], "key string, lib_artist string")
    rows = lambda equal: {r["item_key"]: (r["tier"], round(r["score"], 9), r["m"]["ordinal"] if r["score"] else None) for r in resolve._closest(met, titles, albums, near, equal).collect()}
    want = {}
    for i, w in wanted.items():
        mine = [(t, m[0]) for a, t, m in shelf if a in close[key[i]]]
        words = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
        score = lambda t: max(words(w, t), SequenceMatcher(None, w, t).ratio())
        tier, minus, at = min((2, -1.0, n) if w and (f" {w} " in f" {t} " or f" {t} " in f" {w} ") else (3, -score(t) if w else 0.0, n) for t, n in mine)
        want[i] = (tier, round(-minus, 9), at if minus else None)
    assert rows(False) == want and {v[0] for v in want.values()} == {2, 3}
    assert rows(True) == {"p": (1, 1.0, 37)}


def test_short_ratios_equal_the_library():
    from stowage.operators.resolve import _ratio

    rng = random.Random(5)
    for letters in ("ab", "abc ", "abcdefgh 12"):
        for _ in range(1500):
            a, b = ("".join(rng.choices(letters, k=rng.randint(0, 24))) for _ in "ab")
            assert _ratio(a, b) == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0), (a, b)
    assert _ratio("a" * 300, "a" * 250) == SequenceMatcher(None, "a" * 300, "a" * 250).ratio()
