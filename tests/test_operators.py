"""Operators against plain Python."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stowage.functions.text import EDITION, _folded
from stowage.operators import gates, lineage, relational, resolve, sequence
from stowage.plans import inventory, reconcile

LOCATION = "location_id long, name string, is_authoritative boolean, is_retention boolean, enabled boolean"
PRESENCE = "content_id long, location_id long, present boolean, rel_path string, file_sha256 string, byte_size long, observed_utc long"


def test_upsert_policies(spark):
    table = spark.createDataFrame([(1, 10, "a", 5), (2, 20, None, 6), (None, 1, "n", 7)], "id long, first long, note string, seen long")
    changes = spark.createDataFrame([(1, 99, None, 8), (3, 30, "c", 9), (None, 2, "m", 3)], table.schema)
    got = {r["id"]: tuple(r)[1:] for r in relational.upsert(table, changes, ["id"], keep_first=["first"], never_clear=["note"]).collect()}
    assert got == {1: (10, "a", 8), 2: (20, None, 6), 3: (30, "c", 9), None: (1, "m", 3)}
    fresh = relational.insert_missing(table, changes, ["id"])
    assert sorted((r["id"] or 0, r["first"]) for r in fresh.collect()) == [(0, 1), (1, 10), (2, 20), (3, 30)]
    assert relational.upsert(table.limit(0), changes, ["id"]).count() == 3 and relational.upsert(table, changes.limit(0), ["id"]).count() == 3


def test_latest_breaks_ties_and_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (None, 1, "x"), (2, None, "n")], "k long, t long, v string")
    assert {(r["k"], r["v"]) for r in relational.latest(rows, ["k"], ["t"]).collect()} == {(1, "b"), (None, "x"), (2, "n")}
    assert relational.top(rows, ["k"], [F.desc("t"), "v"]).where("k = 1").first()["v"] == "a"


def test_merge_keeps_conflicts(spark):
    schema = "directory string, name string, sha256 string"
    incoming = spark.createDataFrame([("d", "a.lrc", "1"), ("d", "b.lrc", "2"), ("d", "c.lrc", "3"), ("e", "x", "9")], schema)
    existing = spark.createDataFrame([("d", "a.lrc", "1"), ("d", "b.lrc", "0"), ("d", "b (2).lrc", "0"), ("d", "b (4).lrc", "0")], schema)
    got = {(r["directory"], r["name"]): (r["outcome"], r["stored_as"]) for r in relational.merge_keeping_conflicts(incoming, existing).collect()}
    assert got == {("d", "a.lrc"): ("dropped", "a.lrc"), ("d", "b.lrc"): ("parked", "b (3).lrc"), ("d", "c.lrc"): ("moved", "c.lrc"), ("e", "x"): ("moved", "x")}


def test_paths_acknowledgement_and_media(spark):
    rows = spark.createDataFrame([("/old/a/old/b",), ("/x/old/a",), (None,)], "p string")
    assert [r["p"] for r in relational.move_prefix(rows, "p", "/old/", "/new/").collect()] == ["/new/a/old/b", "/x/old/a", None]
    actions = spark.createDataFrame([(1, True, 3), (2, False, None)], "id long, acknowledged boolean, acknowledged_utc long")
    once = relational.acknowledge(actions, F.col("id") > 0, 9)
    assert once.where("changed").count() == 1 and relational.acknowledge(once.drop("changed"), F.col("id") > 0, 10).where("changed").count() == 0
    assert relational.known_media(["CD", " vinyl"]) == ["cd", "vinyl"]
    with pytest.raises(ValueError, match="known"):
        relational.known_media(["tape"])


def world(spark, rng, contents=12, places=6):
    locations = [(i, f"L{i}", i % 4 == 1, i % 3 == 0, i != 5) for i in range(places)]
    presence = [(c, p, rng.random() < 0.8, f"a/{c}", rng.choice("xy"), 10 * c, rng.randrange(100)) for c in range(contents) for p in range(places) if rng.random() < 0.7]
    return locations, presence, spark.createDataFrame(locations, LOCATION), spark.createDataFrame(presence, PRESENCE)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("dry_run", [True, False])
def test_delete_gate_equals_one_at_a_time(spark, seed, dry_run):
    rng = random.Random(seed)
    locations, presence, loc, pres = world(spark, rng, 25)
    requests = [(i, "audio" if rng.random() < 0.9 else "sidecar", rng.randrange(26), rng.randrange(7), rng.choice(["a/1", "a/1", "/a", "a/../b", None])) for i in range(300)]
    retention = {p[0] for p in locations if p[3]}
    state, want = {(c, p): here for c, p, here, *_ in presence}, {}
    for i, kind, c, p, path in requests:
        if kind != "audio":
            want[i] = "skipped"
        elif p not in {x[0] for x in locations} or path is None or path.startswith("/") or ".." in path.split("/"):
            want[i] = "error"
        elif p not in retention:
            want[i] = "refused"
        else:
            copies = sum(state.get((c, q), False) for q in retention) - state.get((c, p), False)
            want[i] = "deleted" if copies >= 1 else "refused"
            if want[i] == "deleted" and not dry_run:
                state[c, p] = False
    frame = spark.createDataFrame(requests, "id long, content_kind string, content_id long, location_id long, rel_path string")
    assert {r["id"]: r["verdict"] for r in reconcile.delete_gate(frame, pres, loc, 1, dry_run).collect()} == want


def test_plans(spark):
    locations, presence, loc, pres = world(spark, random.Random(5))
    by = {(c, p): (here, path, sha, seen) for c, p, here, path, sha, _, seen in presence}
    want = {}
    for c in range(12):
        if not by.get((c, 3), (False,))[0]:
            sources = sorted((not locations[p][2], p) for p in range(6) if p != 3 and by.get((c, p), (False,))[0])
            if sources:
                want[c] = sources[0][1]
    assert {r["content_id"]: r["source_location_id"] for r in reconcile.copy_plan(pres, loc, 3).collect()} == want
    assert reconcile.copy_plan(pres, loc, 1).count() == 0  # an authoring location is not filled
    scans = spark.createDataFrame([(3, 1, 50, "ok"), (3, 2, 60, "running")], "location_id long, id long, started_utc long, status string")
    for strict, cutoff in ((False, 60), (True, 50)):
        stale = {c for (c, p), (here, _, _, seen) in by.items() if p == 3 and here and seen < cutoff}
        assert {r["content_id"] for r in reconcile.missing_plan(pres, loc, scans, require_ok=strict).collect()} == stale
    none = spark.createDataFrame([], "doc_id long, winner_location long")
    side = pres.limit(0)
    assert reconcile.reconcile(3, pres, side, loc, scans.limit(0), none).count() == 0
    assert reconcile.reconcile(3, pres, side, loc, scans, none).where("action_kind = 'copy'").count() == len(want)
    kept = {(p, c) for (c, p), (here, path, sha, _) in by.items() if here and p == 1 and any(by.get((c, q), (0,))[0] and by[c, q][1:3] == (path, sha) for q in (0, 3))}
    assert {(r["location_id"], r["content_id"]) for r in reconcile.prunable(pres, loc).collect()} == kept


def test_registry(spark):
    schema = "ordinal int, name string, kind string, root_path string, is_authoritative boolean, is_retention boolean, enabled boolean"
    own = spark.createDataFrame([(0, "Drive", "local_drive", "/a", False, True, True), (1, "Off", "local_drive", "/b", False, True, False)], schema)
    old = spark.createDataFrame([(0, "drive ", "local_drive", "/z", False, True, True), (1, "Off", "rclone", "/c", False, True, True), (2, "No", "rclone", None, False, True, False)], schema)
    assert {(r["name"], r["root_path"]) for r in reconcile.registry(own, old).collect()} == {("Pending", None), ("Drive", "/a"), ("Off", "/c")}


def brute_match(item, library):
    def title(t):
        t = re.sub(EDITION, " ", t or "")
        return re.sub(r"[\W_]+", " ", _folded(t).replace("&", " and ").replace("+", " and ")).strip()

    def artist(a):
        a = re.sub(EDITION, " ", re.sub(r"\s*\(\d+\)\s*$", "", a or ""))
        a = _folded(a).replace("&", " and ").replace("+", " and ")
        return re.sub(r"[\W_]+", " ", a[4:] if a.startswith("the ") else a).strip()

    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) if a and b else 0
    seq = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0
    key, own_artist, own_title, ext = item
    if ext:
        for n, a, t, x in library:
            if x == ext:
                return key, "owned", "mbid", 1.0, t
    k = artist(own_artist)
    cand = [r for r in library if k and artist(r[1]) == k] or [r for r in library if k and (jac(artist(r[1]), k) >= 0.6 or seq(artist(r[1]), k) >= 0.88)]
    if not cand:
        return key, "missing", "no matching artist", 0.0, None
    mine = title(own_title)
    for r in cand:
        if mine and title(r[2]) == mine:
            return key, "owned", "exact", 1.0, r[2]
    for r in cand:
        a, b = mine, title(r[2])
        if a and b and min(len(a), len(b)) >= 3 and (f" {a} " in f" {b} " or f" {b} " in f" {a} "):
            return key, "owned", "contains", 1.0, r[2]
    best, album = 0.0, None
    for r in cand:
        s = max(jac(mine, title(r[2])), seq(mine, title(r[2])))
        if s > best:
            best, album = s, r[2]
    return (key, "uncertain", "similar title", best, album) if best >= 0.6 else (key, "missing", "no matching title", best, album)


def test_matching_equals_all_pairs(spark):
    rng = random.Random(11)
    artists = ["Pulselovers", "Pulse Lovers", "The Ogle", "Ogle (2)", "Björk", "Bjork", "Sigur Rós", "Rós Sigur", "Massive Attack", "Massive Atack", "パフューム", "Boards of Canada", "Boards Canada", "", "Xy", "Kruder & Dorfmeister", "Kruder and Dorfmeisterr"]
    titles = ["Mezzanine", "Mezzanine (Deluxe Edition)", "Mezzanine Mad Professor", "Homogenic", "Homogenik", "Vespertine Live", "JPN", "Geogaddi [Remaster]", "Music Has the Right", "Right the Has Music", "()", "ab", "Ágætis byrjun"]
    library = [(i, rng.choice(artists), rng.choice(titles), rng.choice([None, None, "x1", "x2"])) for i in range(40)]
    items = [(f"k{i}", rng.choice(artists), rng.choice(titles), rng.choice([None, None, None, "x2", "zz"])) for i in range(60)]
    frame = spark.createDataFrame([(*i, [], []) for i in items], "item_key string, artist string, title string, ext_id string, artist_alts array<string>, title_alts array<string>")
    got = {r["item_key"]: (r["item_key"], r["status"], r["reason"], round(r["score"], 9), r["album"]) for r in resolve.match(frame, spark.createDataFrame(library, "ordinal long, albumartist string, album string, ext_id string")).collect()}
    for item in items:
        want = brute_match(item, library)
        assert got[item[0]] == (*want[:3], round(want[3], 9), want[4]), item


def test_close_artists_lose_no_pair(spark):
    rng = random.Random(12)
    names = {"".join(rng.choices("abcde ", k=rng.randint(1, 24))).strip() for _ in range(60)}
    for n in list(names):
        for _ in range(3):
            at = rng.randrange(len(n) + 1)
            names.add((n[:at] + rng.choice(["", "x", "xy"]) + n[at + rng.randint(0, 2) :]).strip())
    names = sorted(n for n in names if n)
    frame = spark.createDataFrame([(n,) for n in names], "key string")
    got = {(r["a"], r["b"]) for r in resolve.close_artists(frame, frame).collect()}
    words = lambda n: set(n.split())
    want = {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= 0.88 or len(words(a) & words(b)) / len(words(a) | words(b)) >= 0.6}
    assert got == want


def test_audit_report(spark):
    items = spark.createDataFrame([("a", "Art", "One", None, [], [], ["cd"], 0), ("b", "Art", "Two", None, [], [], ["vinyl"], 1), ("c", "Art", "Onee", None, [], [], ["cd"], 2)], "item_key string, artist string, title string, ext_id string, artist_alts array<string>, title_alts array<string>, media array<string>, ordinal int")
    library = spark.createDataFrame([(0, "Art", "One", None)], "ordinal long, albumartist string, album string, ext_id string")
    ignored = spark.createDataFrame([("a",), ("c",)], "item_key string")
    got = {r["item_key"]: (r["status"], r["ignored"]) for r in resolve.audit(items, library, ignored).collect()}
    assert got == {"a": ("owned", False), "b": ("missing", False), "c": ("uncertain", True)}
    assert resolve.audit(items, library, ignored, ["cd"], strict=True).where("item_key = 'c'").first()["status"] == "missing"
    assert {r["bucket"]: r["n"] for r in resolve.buckets(resolve.audit(items, library, ignored)).collect()} == {"owned": 1, "missing": 1, "ignored": 1}
    with pytest.raises(ValueError):
        resolve.union_catalogs(library.limit(0), library.limit(0))


def test_interpolation_equals_the_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    for d in range(40):
        n, duration = rng.randint(1, 9), rng.choice([None, 0.0, 60.0])
        times = [rng.choice([None, None, round(rng.uniform(0, 60), 2)]) for _ in range(n)]
        rows += [(d, i, t, duration) for i, t in enumerate(times)]
        anchors = [(i, t) for i, t in enumerate(times) if t is not None]
        for i in range(n):
            if not anchors:
                v = duration * (i + 1) / (n + 1) if duration else i * 3.0
            else:
                (fi, ft), (li, lt) = anchors[0], anchors[-1]
                gap = (lt - ft) / (li - fi) if li > fi else 3.0
                if times[i] is not None:
                    v = times[i]
                elif i < fi:
                    v = max(0.0, ft - (fi - i) * gap)
                elif i > li:
                    v = lt + (i - li) * gap
                else:
                    p, q = max(a for a in anchors if a[0] < i), min(a for a in anchors if a[0] > i)
                    v = p[1] + (i - p[0]) / (q[0] - p[0]) * (q[1] - p[1])
            want[d, i] = v
    frame = spark.createDataFrame(rows, "doc_id long, pos int, time double, duration double")
    got = {(r["doc_id"], r["pos"]): r["time"] for r in sequence.interpolate(frame, duration="duration").collect()}
    assert got == pytest.approx(want)
    top = {}
    for r in sorted(sequence.monotonic(sequence.interpolate(frame)).collect(), key=lambda r: (r["doc_id"], r["pos"])):
        assert r["time"] >= top.get(r["doc_id"], r["time"])
        top[r["doc_id"]] = r["time"]


def test_alignment(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["walk away", "(walk away)", "stay here now", "walk away"])], "doc_id long, pos int, text string")
    words = spark.createDataFrame([(1, i, w, float(i * 2), 0.9) for i, w in enumerate(["walk", "away", "stay", "here", "now", "walk", "Away!"])], "doc_id long, pos int, text string, start double, confidence double")
    got = {r["pos"]: (r["time"], r["confidence"]) for r in sequence.align(lines, words).collect()}
    assert got == {0: (0.0, 0.9), 1: (2.0, 0.0), 2: (4.0, 0.9), 3: (10.0, 0.9)}
    texts = spark.createDataFrame([(1, "[00:00.00]walk away\n[00:01.00]stay here now\n[00:59.00]\n")], "doc_id long, text string")
    assert sequence.retime(texts, words).first()["retimed"] == "[00:00.00]walk away\n[00:04.00]stay here now\n[00:59.00]\n"


def test_lineage_scenarios():
    held, versions, head = lineage.fold([(1, "a", "s1"), (2, "b", "s1")], [], {}, None)
    assert head == 1 and [h[3] for h in held] == [True, True] and versions == [(1, "s1", '{"a":1}', True)]
    known, prior = [v[:3] for v in versions], {1: 1, 2: 1}
    held, versions, head = lineage.fold([(1, "a", "s2"), (2, "b", "s1")], known, prior, head)
    assert head == 2 and [(h[3], h[4], h[5]) for h in held] == [(True, False, False), (False, True, False)]
    known, prior = [v[:3] for v in versions], {1: 2, 2: 1}
    held, versions, head = lineage.fold([(1, "a", "s2"), (2, "b", "s3")], known, prior, head)
    assert head == 2 and held[1][5] and versions[2] == (3, "s3", '{"a":1,"b":1}', True)
    again = lineage.fold([(1, "a", "s2"), (2, "b", "s3")], [v[:3] for v in versions], {1: 2, 2: 3}, head)
    assert not any(v[3] for v in again[1]) and again[2] == 2
    assert lineage.fold([(1, "a", "s2")], [(1, "s1", "{}"), (4, "s2", None)], {}, None)[2] == 4


def test_lineage_frames(spark):
    seen = spark.createDataFrame([(1, 1, "a", "s1"), (1, 3, "c", "s2"), (2, 3, "c", "s1")], "doc_id long, location_id long, actor string, sha string")
    versions = spark.createDataFrame([(1, 1, "s1", '{"a":1}')], "doc_id long, version_id long, sha string, vclock string")
    prior = spark.createDataFrame([], "doc_id long, location_id long, version_id long")
    heads = spark.createDataFrame([(1, 1)], "doc_id long, version_id long")
    held = lineage.lineage(seen, versions, prior, heads)
    assert {(r["doc_id"], r["location_id"]) for r in lineage.concurrent(held).collect()} == {(1, 3)} and lineage.behind(held).count() == 0
    found = lineage.conflicts(held, 3, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert [(r["doc_id"], r["winner_location"], r["opens"]) for r in found] == [(1, 1, False)]
    assert lineage.lineage(seen, versions, prior, heads, want="versions").where("is_new").count() == 2


def test_log_gate(spark):
    batch = lambda *rows: spark.createDataFrame(rows, "batch_id long, artist string, album string")
    logs = lambda *rows: spark.createDataFrame(rows, "artist string, album string")
    state = lambda b, g: {r["batch_id"]: r["state"] for r in gates.log_gate(b, g).collect()}
    two = batch((1, "A", "Hits"), (2, "B", "Hits"))
    assert state(two, spark.createDataFrame([], "artist string, album string")) == {1: "ready", 2: "ready"}
    assert state(two, logs((None, None))) == {1: "ready", 2: "ready"}
    assert state(batch((1, "A", "X")), logs(("Q", "Y"))) == {1: "ready"}
    assert state(two, logs(("a ", "HITS"))) == {1: "ready", 2: "held"}
    assert state(batch((1, "VA", "Mix"), (2, "B", "Other"), (3, "C", "")), logs(("Various", "Mix"), ("Z", ""))) == {1: "ready", 2: "held", 3: "held"}


def test_completeness_and_discs(spark):
    tracks = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True), (3, "a", False)], "group_id long, track string, marked boolean")
    markers, groups = spark.createDataFrame([(3,)], "group_id long"), spark.createDataFrame([(4,), (1,)], "group_id long")
    got = {r["group_id"]: (r["waiting"], r["complete"]) for r in gates.completeness(tracks, markers).collect()}
    assert got == {1: (1, False), 2: (0, True), 3: (0, True)}
    assert gates.completeness(tracks, markers, groups=groups).where("group_id = 4").first()["complete"]
    assert [r["track"] for r in gates.incomplete_tracks(tracks, markers).collect()] == ["b"]
    assert gates.sweep_totals(gates.promotion(gates.completeness(tracks, markers))).first().asDict() == {"scanned": 3, "promoted": 2, "waiting": 1}
    files = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 2, 2), (4, None, None), (5, 1, 2), (5, 1, 3)], "k long, disc_no int, disc_total int")
    assert {r["k"]: r["verdict"] for r in gates.disc_wait(files, ["k"]).collect()} == {1: "WAIT:1:2", 2: None, 3: None, 4: None, 5: None}


def test_inventory(spark):
    track = "rel_path string, identity string, identity_kind string, artist string, albumartist string, album string, title string, ext_id string, file_sha256 string, byte_size long, mtime_ns long"
    tracks = spark.createDataFrame([("A/X/01.flac", "i1", "audio_md5", "A", None, "X", "One", None, "h1", 5, 7), ("A/X/02.flac", "i2", "audio_md5", "A", None, "X", "Two", None, "h2", 6, None)], track)
    sidecars = spark.createDataFrame([("A/X/01.lrc", "lrc", "s1"), ("A/X/cover.jpg", "cover", "s2"), ("A/Z/09.lrc", "lrc", "s3"), ("A/X/02.nolrc", "nolrc", "s4"), ("A/cover.jpg", "cover", "s5")], "rel_path string, role string, file_sha256 string")
    audio = spark.createDataFrame([], "content_id long, identity string, identity_kind string, artist string, album string, title string, first_seen_utc long, last_seen_utc long")
    presence = spark.createDataFrame([], PRESENCE + ", mtime_ns long")
    albums = spark.createDataFrame([], "album_id long, album_key string, albumartist string, album string, ext_id string, first_seen_utc long, last_seen_utc long")
    links = spark.createDataFrame([], "album_id long, content_id long")
    first = inventory.inventory(1, 100, tracks, sidecars, audio, presence, albums, links)
    assert {k: v.count() for k, v in first.items()} == {"audio": 2, "albums": 1, "links": 2, "presence": 2, "sidecars": 3}
    assert {(r["rel_path"], r["parent_kind"]) for r in first["sidecars"].collect()} == {("A/X/01.lrc", "track"), ("A/X/02.nolrc", "track"), ("A/cover.jpg", "album")}
    second = inventory.inventory(1, 200, tracks.limit(1), sidecars.limit(0), first["audio"], first["presence"], first["albums"], first["links"])
    assert {(r["first_seen_utc"], r["last_seen_utc"]) for r in second["audio"].collect()} == {(100, 200), (100, 100)}
    assert inventory.scan_counts(audio, tracks).first().asDict() == {"new": 2, "updated": 0, "scanned": 2}
    steps = [(2, inventory.add_columns(root_path="string")), (1, lambda t: t)]
    table, version = inventory.migrate(links, 0, steps)
    assert version == 2 and table.columns[-1] == "root_path" and inventory.migrate(table, 2, steps)[0] is table


def test_incoming_files_of_one_name_do_not_replace_each_other(spark):
    from stowage.operators.relational import merge_keeping_conflicts

    rows = [("d", "x.lrc", "h1"), ("d", "x.lrc", "h2"), ("d", "x.lrc", "h3"), ("d", "x.lrc", "h1"), ("d", "x (3).lrc", "h9"), ("e", "y", "h1"), ("e", "y", "h1"), ("f", "z.a.lrc", "h2"), ("f", "z.a.lrc", "h2")]
    held = [("d", "x (2).lrc", "h0"), ("f", "z.a.lrc", "h1")]
    schema = "directory string, name string, sha256 string"
    got = merge_keeping_conflicts(spark.createDataFrame(rows, schema), spark.createDataFrame(held, schema)).collect()
    stored = [(r["directory"], r["stored_as"]) for r in got if r["outcome"] != "dropped"] + [h[:2] for h in held]
    assert len(stored) == len(set(stored))
    assert sorted(tuple(r) for r in got) == sorted([
        ("d", "x.lrc", "h1", "moved", "x.lrc"), ("d", "x.lrc", "h1", "dropped", "x.lrc"), ("d", "x.lrc", "h2", "parked", "x (4).lrc"), ("d", "x.lrc", "h3", "parked", "x (5).lrc"), ("d", "x (3).lrc", "h9", "moved", "x (3).lrc"),
        ("e", "y", "h1", "moved", "y"), ("e", "y", "h1", "dropped", "y"), ("f", "z.a.lrc", "h2", "parked", "z.a (2).lrc"), ("f", "z.a.lrc", "h2", "dropped", "z.a.lrc"),
    ])


def test_order_folds_only_ascii(spark):
    from stowage.operators.relational import nocase_order

    rows = spark.createDataFrame([(1, "Éa"), (2, "b"), (3, "A"), (4, "éa"), (5, "a")], "ordinal long, name string")
    assert [r["ordinal"] for r in nocase_order(rows, "name", ordinal="ordinal").collect()] == [3, 5, 2, 1, 4]


def test_texts_within_others_equal_brute_force(spark):
    import random

    from stowage.operators.resolve import containing

    rng = random.Random(3)
    make = lambda n: [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(1, 4))) for _ in range(n)] + ["", None, "x"]
    a, b = make(40), make(60)
    want = {(x, y) for x in a for y in b if x and y and min(len(x), len(y)) >= 3 and (f" {x} " in f" {y} " or f" {y} " in f" {x} ")}
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "text string")
    assert {tuple(r) for r in containing(frame(a), frame(b)).collect()} == want


def test_items_added_before_a_batch_are_added_up_across_slices_of_time(spark):
    from stowage.operators import gates

    times = [0, 5, 9_999, 10_000, 10_000, 25_000, 40_001]
    library = spark.createDataFrame([("x" if i % 2 else None, "a", "t", f"d{i}", at, len(times) - i) for i, at in enumerate(times)], "ext_id string, artist string, album string, directory string, added_utc long, ordinal int")
    asked = [(0, None, 0), (1, None, 6), (2, None, 10_000), (3, None, 10_001), (4, None, 50_000), (5, "x", 10_000), (6, "x", 30_000), (7, "y", 50_000)]
    batches = spark.createDataFrame([(i, "a", "t", x, before) for i, x, before in asked], "batch_id long, artist string, album string, ext_id string, before long")
    frame = gates.duplicate_decision(batches, library, batches.where("batch_id = 4"))
    got = {r["batch_id"]: (r["decision"], r["existing_dir"], r["n_tracks"]) for r in frame.collect()}
    rows = [(r["ext_id"], r["directory"], r["added_utc"], r["ordinal"]) for r in library.collect()]
    for i, x, before in asked:
        mine = sorted((o, d) for e, d, at, o in rows if at < before and (x is None or e == x))
        assert got[i] == ("added" if i == 4 else "duplicate" if mine else "no_match", mine[0][1] if mine else None, len(mine))
    # No pairs of batches and items: nothing joins on the key alone.
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "_k" in plan and "added_utc" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_an_upsert_leaves_rows_where_their_fold_put_them(spark):
    """Neither the folded table nor the folded changes are shuffled again to be joined, and null keys still match."""
    rows = spark.range(40).selectExpr("coalesce(id % 7, 0) AS k", "coalesce(id % 3, 0) AS l", "id AS at", "CAST(id AS STRING) AS note")
    folded = relational.latest(rows, ["k", "l"], ["at"])
    changed = relational.upsert(folded, relational.latest(rows.where("k > 3"), ["k", "l"], ["at"]).withColumn("note", F.lit("new")), ["k", "l"])
    assert changed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted((r["k"], r["l"], r["note"] == "new") for r in changed.collect()) == [(k, lo, k > 3) for k in range(7) for lo in range(3)]
    table, changes = (spark.createDataFrame(r, "k long, l long, v string") for r in ([(1, None, "a"), (None, None, "b"), (2, 2, "c")], [(1, None, "x"), (None, None, "y"), (None, 2, "z"), (2, 2, None)]))
    assert sorted(map(repr, map(tuple, relational.upsert(table, changes, ["k", "l"]).collect()))) == sorted(map(repr, [(1, None, "x"), (None, None, "y"), (None, 2, "z"), (2, 2, None)]))


def test_the_delete_gate_sorts_requests_once_for_their_place(spark):
    """Of its two windows, the first takes the order of the join before it; so a task holds two sorts of its requests, not four."""
    requests = spark.range(40).selectExpr("id", "'audio' AS content_kind", "id % 5 AS content_id", "id % 3 AS location_id", "'a/b' AS rel_path").hint("merge")
    presence = spark.createDataFrame([(c, k, True, "a/b", "h", 7, 1) for c in range(5) for k in range(3)], PRESENCE).hint("merge")
    locations = spark.createDataFrame([(k, f"l{k}", False, True, True) for k in range(3)], LOCATION)
    judged = reconcile.delete_gate(requests, presence, locations, 1, dry_run=False)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and "dense_rank" in windows[0]
    assert {r["verdict"]: r["count"] for r in judged.groupBy("verdict").count().collect()} == {"deleted": 30, "refused": 10}
