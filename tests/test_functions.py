"""Scalar rules on hand-written values, and version-vector laws."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.functions import clocks, keys, releases, tags, text, timed


def value(spark, column, **cells):
    names = list(cells)
    row = spark.createDataFrame([tuple(cells[n] for n in names)], ", ".join(f"{n} {'string' if not isinstance(cells[n], bytes) else 'binary'}" for n in names))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, want",
    [("The Béatles", "beatles"), ("Ogle (2)", "ogle"), ("AC/DC & Co", "ac dc and co"), ("Theory", "theory"), ("パフューム", "パフューム"), ("Sigur Rós (Live)", "sigur ros live"), (None, ""), ("", ""), ("A+B", "a and b"), ("STRASSE ß", "strasse ss")],
)
def test_artist_keys(spark, name, want):
    assert value(spark, text.normalize_artist(F.col("n")), n=name) == want


@pytest.mark.parametrize(
    "name, want",
    [("Album (Deluxe Edition)", "album"), ("Album [2018 Remaster]", "album"), ("Album (Mixdown)", "album mixdown"), ("(What's the Story)", "what s the story"), ("The Fame", "the fame"), ("Mezzanine (remix) II", "mezzanine ii"), ("½ ② Ⅷ", "1 2 2 viii"), ("Under_score", "under score")],
)
def test_title_keys(spark, name, want):
    assert value(spark, text.normalize_title(F.col("n")), n=name) == want


def test_credits_and_feats(spark):
    split = lambda a, b, t: tuple(value(spark, text.split_feat(F.col("a"), F.col("b"), F.col("t")), a=a, b=b, t=t))
    assert split("Band feat. Guest", "", "Song") == ("Band", "", "Song (feat. Guest)")
    assert split("Band (feat. Guest & Other)", "Band", "Song") == ("Band", "Band", "Song (feat. Guest & Other)")
    assert split("Band [Feat Guest]", "Various Artists", "Song") == ("Band [Feat Guest]", "Various Artists", "Song")
    assert split("Other", "Beck (Backing Vocals: Roger)", "Song") == ("Beck", "Beck", "Song")
    assert split("Solo", "", "Song") == ("Solo", "", "Song")
    assert value(spark, text.strip_credits(F.col("a")), a="Beck (Name) (Chorus: X)") == "Beck (Name)"


def test_album_repair(spark):
    fix = lambda album, comment, folder: value(spark, text.repair_album(F.col("a"), F.col("c"), F.col("d")), a=album, c=comment, d=folder)
    assert fix("Aqu'aticos", "Visit https://x.bandcamp.com", "/in/Artist - Aquáticos/") == "Aquáticos"
    assert fix("Aqu'aticos", "none", "/in/Artist - Aquáticos") == "Aqu'aticos"
    assert fix("Other", "bandcamp.com", "/in/Artist - Aquáticos") == "Other"


def test_query_variants(spark):
    got = value(spark, text.query_variants(F.col("a"), F.col("t"), F.col("b"), F.col("p"), F.col("s"), F.col("e")), a="A", t="夜 - Night", b="昼 Day", p="x/01. Night.flac", s="Sort", e="")
    assert [tuple(x) for x in got] == [("A", "夜 - Night", "昼 Day"), ("A", "Night", "昼 Day"), ("Sort", "夜 - Night", "Day"), ("Sort", "Night", "Day")]


def test_paths_and_names(spark):
    one = lambda f, v: value(spark, f(F.col("v")), v=v)
    assert one(text.stem, "a.b/01. Song.flac") == "a.b/01. Song" and one(text.stem, "a/.nolrc") == "a/.nolrc"
    assert one(text.extension, "a/B.FLAC") == "flac" and one(text.extension, "a.b/c") == "" and one(text.extension, ".hidden") == ""
    assert one(text.parent, "a/b/c") == "a/b" and one(text.parent, "c") == ""
    assert one(text.safe_name, " ..a/b. ") == "a_b" and one(text.safe_name, " . ") == "Unknown"
    assert one(text.safe_path, "a/b") and not one(text.safe_path, "/a") and not one(text.safe_path, "a/../b") and one(text.safe_path, "a/..b")
    assert one(text.safe_url, "HTTPS://x") == "HTTPS://x" and one(text.safe_url, "javascript:x") is None
    assert one(text.collapse, "  A \t B ") == "a b" and one(text.year, " 1991 ") == 1991 and one(text.year, "0") is None and one(text.year, "x") is None
    assert one(text.title_from_file, "x/1-02. Name.mp3") == "Name" and one(text.first_number, "3/12") == 3 and one(text.date_year, "1999-01-02") == "1999"
    assert one(lambda c: text.middle_cut(c, 7), "abcdefghij") == "abc…hij" and one(text.directory_label, "Artist/Album") == "Artist - Album" and one(text.directory_label, "Album") == "Album"
    assert one(lambda c: text.human_bytes(c.cast("long")), "1536") == "1.5 KB" and one(lambda c: text.human_eta(c), "3725") == "1:02:05"
    retry = lambda v: one(lambda c: text.retry_seconds(c, F.lit(784111777 - 5)), v)
    assert [retry(v) for v in ("500", "x", "-1", "2.5", "Sun, 06 Nov 1994 08:49:37 GMT")] == [300.0, 60.0, 0.0, 2.5, 5.0]
    assert one(lambda c: text.middle_cut(c, 8), "abcdefghij") == "abc…ghij" and one(lambda c: text.middle_cut(c, 2), "abc") == "ab"
    assert value(spark, text.image_kind(F.col("v")), v=bytes.fromhex("89504E470D0A1A0A00")) == "image/png" and value(spark, text.image_kind(F.col("v")), v=b"\xff\xd8") == "image/jpeg"
    assert value(spark, text.label(F.col("a"), F.col("b"), F.col("k")), a="", b="", k="c:1") == "c:1"


def test_keys(spark):
    key = lambda a, b, x: value(spark, keys.album_key(F.col("a"), F.col("b"), F.col("x")), a=a, b=b, x=x)
    assert key(" Artist", "ALBUM ", None) == str(uuid.uuid5(uuid.NAMESPACE_URL, "stowage:album:aa:artist\x00album"))
    assert key("Artist", "Album", " X9 ") == str(uuid.uuid5(uuid.NAMESPACE_URL, "stowage:album:mb:x9"))
    assert value(spark, keys.location_key(F.col("n")), n=" Pending ") == str(uuid.uuid5(uuid.NAMESPACE_URL, "stowage:location:pending"))
    resolve = lambda t: value(spark, keys.resolve_key(F.col("t"), "src"), t=t)
    assert [resolve(t) for t in ("5", " a:b:c ", ":b", "a:", "")] == ["src:5", "a:b:c", None, None, None]
    head = b"fLaC" + bytes(22) + bytes(range(1, 17))
    assert tuple(value(spark, keys.content_identity(F.col("c")), c=head)) == (bytes(range(1, 17)).hex(), "audio_md5")
    assert value(spark, keys.content_identity(F.col("c")), c=b"fLaC" + bytes(38))["identity_kind"] == "file_sha256"


vectors = st.dictionaries(st.sampled_from("abc"), st.integers(0, 3), max_size=3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(vectors, vectors), min_size=1, max_size=8))
def test_vector_laws(spark, pairs):
    frame = spark.createDataFrame(pairs, "a map<string,bigint>, b map<string,bigint>")
    a, b = F.col("a"), F.col("b")
    got = frame.select("a", "b", clocks.merge(a, b).alias("m"), clocks.merge(b, a).alias("w"), clocks.dominates(a, b).alias("d"), clocks.concurrent(a, b).alias("c"), clocks.equal(a, b).alias("e"), clocks.to_json(a).alias("j"), clocks.from_json(clocks.to_json(a)).alias("r"), clocks.bump(a, F.lit("z")).alias("u"), clocks.relation(a, b).alias("x"), clocks.strictly_dominates(a, b).alias("s")).collect()
    for r in got:
        ks = set(r["a"]) | set(r["b"])
        ge, le = (all(r[p].get(k, 0) >= r[q].get(k, 0) for k in ks) for p, q in ("ab", "ba"))
        assert r["m"] == r["w"] == {k: max(r["a"].get(k, 0), r["b"].get(k, 0)) for k in ks if max(r["a"].get(k, 0), r["b"].get(k, 0))}
        assert (r["d"], r["c"], r["e"], r["s"]) == (ge, not ge and not le, ge and le, ge and not le)
        assert r["j"] == "{" + ",".join(f'"{k}":{r["a"][k]}' for k in sorted(r["a"]) if r["a"][k]) + "}"
        assert r["r"] == {k: n for k, n in r["a"].items() if n} and r["u"]["z"] == 1
    assert frame.select(clocks.from_json(F.lit(None).cast("string")).alias("n")).first()["n"] == {}


def test_timed_text(spark):
    raw = "[ar:Someone]\r\n[00:01.50] one\n[01:02.25]two \n[00:03.0]\nplain\n[0:59.999]x"
    got = value(spark, timed.parse_lines(F.col("t")), t=raw)
    assert [tuple(x) for x in got] == [(0, 1.5, "one"), (1, 62.25, "two"), (2, 3.0, ""), (3, 60.0, "x")]
    assert value(spark, timed.format_lines(timed.parse_lines(F.col("t"))), t=raw) == "[00:01.50]one\n[00:03.00]\n[01:00.00]x\n[01:02.25]two\n"
    assert value(spark, timed.lyric_texts(F.col("t")), t=raw) == ["one", "two", "x"]
    assert value(spark, timed.lyric_texts(F.col("t")), t="[ar:A]\n a \n\nb") == ["a", "b"]
    assert value(spark, timed.envelope(F.col("t")), t="\n a\n\nb \n") == "[00:00.00] a\n\n[00:00.00] b"
    assert value(spark, timed.tokenize(timed.strip_parentheticals(F.col("t"))), t="Don't (oh) stop_now É") == ["don't", "stop", "now", "é"]


@pytest.mark.parametrize(
    "times, duration, want",
    [
        ([], 100.0, ["no-timed-lines"]), ([5.0, 5.0], None, ["all-timestamps-identical"]), ([1.0, 2.0] * 5, None, ["low-distinct-timestamps", "non-monotonic"]),
        ([1.0, 2.0, 3.0], 100.0, ["timestamps-crammed-early"]), ([1.0, 20.0, 40.0], 100.0, []), ([3.0, 1.0], None, ["non-monotonic"]), ([1.0], 100.0, []), ([1.0, 2.0, 3.0], 0.0, []),
    ],
)
def test_timing_audit(spark, times, duration, want):
    frame = spark.createDataFrame([([(i, t, "x") for i, t in enumerate(times)], duration)], "lines array<struct<pos:int,time:double,text:string>>, duration double")
    assert frame.select(timed.audit(F.col("lines"), F.col("duration"), F.lit(True)).alias("v")).first()["v"] == want


def test_tags(spark):
    frame = spark.createDataFrame([({"ARTIST": ["Band feat. X"], "title": ["Song"], "year": ["1999"], "TotalDiscs": ["2"], "discnumber": ["1/2"], "date": ["1999-05-01"], "empty": []}, "/in/x")], "tags map<string,array<string>>, directory string")
    assert frame.select(tags.standard(F.col("tags")).alias("s")).first()["s"]["disc_no"] == 1
    lowered = spark.createDataFrame([({"artist": ["Band feat. X"], "title": ["Song"], "year": ["1999"], "totaldiscs": ["2"], "date": ["1999-05-01"]}, "/in/x")], frame.schema)
    after = tags.clean_before(lowered).first()
    assert after["changed"] and after["tags"] == {"artist": ["Band"], "title": ["Song (feat. X)"], "date": ["1999-05-01"]}
    post = tags.clean_after(lowered).first()
    assert post["changed"] and post["tags"]["date"] == ["1999"] and "year" not in post["tags"] and "totaldiscs" in post["tags"]
    disc = lambda m: tuple(spark.createDataFrame([(m,)], "t map<string,array<string>>").select(tags.disc(F.col("t")).alias("d")).first()["d"])
    assert [disc(m) for m in ({"disctotal": ["3"], "discnumber": ["2"]}, {"TPOS": ["2/4"]}, {"disctotal": ["x"]}, {}, {"TPOS": ["2"]})] == [(2, 3), (2, 4), (1, 1), (1, 1), (2, 1)]


def test_releases(spark):
    schema = "ordinal int, " + releases.RELEASE
    artist = lambda name, anv="", join="": (name, anv, join, 1)
    info = lambda title, artists, formats=("CD",), catno="none", year=0: (1, title, year, " ", [(f, "1", [], None) for f in formats], [("L", "none"), ("L", catno)], artists)
    rows = [
        (0, 10, 1, None, info("夜 = Night", [artist("A", "Ay", ","), artist("B", "", "&")], ("SACD", "Box Set"), "X-1", 1990)), (1, None, 1, None, info("T", [artist("Various")], ("Vinyl",))),
        (2, 12, 1, None, info("  ", [artist("A")])), (3, 13, 1, None, None),
    ]
    got = releases.to_items(spark.createDataFrame(rows, schema), "svc", "https://e/").orderBy("ordinal").collect()
    assert [(r["item_key"], r["artist"], r["media"], r["year"], r["catno"]) for r in got] == [("svc:10", "Ay, B", ["cd", "other"], 1990, "X-1"), ("svc:1", "Various", ["vinyl"], None, None)]
    assert got[0]["artist_alts"] == ["A B", "Ay", "A"] and got[0]["title_alts"] == ["夜", "Night"] and got[1]["artist_alts"] == ["Various Artists"]
