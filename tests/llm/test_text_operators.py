"""Operators over documents against brute force: edge cases, random small vocabularies, all code paths."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stowage.llm import bpe, decontam, langid, linededup, secrets, simhash, substring, toxicity
from stowage.llm.common import crc_mod

from .conftest import SCHEMA, documents

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def found(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# BPE


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, edge_rows):
    lib, want = library(), Counter()
    for doc_id, text, *_ in edge_rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[doc_id, len(ids), hashlib.sha256(packed).hexdigest(), sha(lib.decode(ids, skip_special_tokens=False))] += 1
        assert bpe.decode_ids(packed) == lib.decode(ids, skip_special_tokens=False)
    assert found(bpe.encode_documents(documents(spark, edge_rows)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_on_random_texts_in_small_chunks(monkeypatch):
    lib, rng = library(), random.Random(2)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    machine = bpe.Transducer(open(bpe.default_path()).read())
    parts = ["a", "the", "'ll", "'", " ", "  ", "\n", "é", "ß", "日本", "\x1c", "\x85", "\xa0", "½", "2", "--", "<|endoftext|>", "<", "🙂", "́", "______", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        ids = lib.encode(text, add_special_tokens=False).ids
        packed = b"".join(machine.encode(text))
        assert list(memoryview(packed).cast("I")) == ids, text
        assert "".join(machine.decode(iter([packed]))) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_buffer_stays_small_on_endless_pretokens():
    lib, machine = library(), bpe.Transducer(open(bpe.default_path()).read())
    text = "abcdefgh" * 5000 + " x" + "é" * 3000
    bound, stream, ids, most = 4 * (machine.lookahead + machine.longest), bpe.Stream(machine), [], 0
    for at in range(0, 40_000, 100):
        ids += stream.push(text[at : at + 100].encode())
        most = max(most, len(stream.last))
    assert most <= bound and len(ids) > 4000
    assert ids + stream.finish() == lib.encode(text[:40_000], add_special_tokens=False).ids
    blocks = list(machine.encode(text * 4))
    assert list(memoryview(b"".join(blocks)).cast("I")) == lib.encode(text * 4, add_special_tokens=False).ids


def test_bpe_pretokens_longer_than_a_chunk_leave_in_blocks(monkeypatch):
    lib, machine = library(), bpe.Transducer(open(bpe.default_path()).read())
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    for text in ("ab" * 9000 + "'ll go", "日本" * 4000 + "x", " " * 5001 + "x", "\n" * 5000, "-" * 4000 + " 12" * 2000):
        blocks = list(machine.encode(text))
        assert list(memoryview(b"".join(blocks)).cast("I")) == lib.encode(text, add_special_tokens=False).ids
    assert max(map(len, machine.encode("ab" * 9000))) <= 4 * (1000 + 2 * (machine.lookahead + machine.longest))


def test_bpe_table_of_pretokens_keeps_to_its_bytes(monkeypatch):
    machine = bpe.Transducer(open(bpe.default_path()).read())
    monkeypatch.setattr(bpe, "CACHED_BYTES", 20_000)
    for i in range(3000):
        b"".join(machine.encode(f"w{i} x{i}"))
    size = lambda d: sum(bpe.ENTRY_BYTES + 2 * len(k) + len(v) for k, v in d.items())
    assert size(machine.cache) <= 20_000 and size(machine.cache.before) <= 20_000 and len(machine.cache.before) > 50


def test_bpe_empty_table(empty):
    assert bpe.encode_documents(empty).count() == 0


# SimHash


def brute_simhash(rows, words=3, bits=3):
    import xxhash

    def fp(text):
        w = SPACE.findall(lower(text or ""))
        if not w:
            return 0
        shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for i in range(64):
                counts[i] += h >> i & 1
        return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))

    fps = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows)], [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("crowded", [128, 1])
def test_simhash_components(spark, edge_rows, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = list(edge_rows)
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(300)] = f"v{i}"
        rows.append((1000 + i, " ".join(copy)))
    want, _ = brute_simhash(rows)
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    assert got == Counter(want)


def test_simhash_of_a_hot_fingerprint_and_a_crowd_around_it(spark, monkeypatch):
    """More copies of one text than a chunk holds, and more near copies than that, are one component."""
    for name, value in {"CROWDED": 4, "CHUNK": 8}.items():
        monkeypatch.setattr(simhash, name, value)
    rng, base = random.Random(3), [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 120):
        near = list(base)
        near[rng.randrange(400)] = f"v{i}"
        rows.append((i, " ".join(near)))
    want, _ = brute_simhash(rows)
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    assert got == Counter(want) and sum(c[2] == 0 for c in got) > 100


def test_simhash_keeps_one_of_each_group(spark, edge_rows):
    kept = simhash.drop_near_duplicates(documents(spark, edge_rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    want, groups = brute_simhash(edge_rows)
    assert kept.count() == len(set(groups))
    assert {r["doc_id"] for r in kept.collect()} == {min((want[i][0] for i in range(len(groups)) if groups[i] == g and want[i][0] is not None), default=None) for g in groups}


def test_simhash_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 400), (600, 500)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 400: 400, 500: 400, 600: 400}


# Substrings


def brute_substring(rows, window):
    words, places = [SPACE.findall(r[1] or "") for r in rows], defaultdict(list)
    for d, w in enumerate(words):
        for p in range(len(w) - window + 1):
            places[tuple(w[p : p + window])].append((d, p))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for d, p in at:
                gone[d].update(range(p, p + window))
    return Counter((rows[d][0], len(w), len(gone[d]), sha(" ".join(x for i, x in enumerate(w) if i not in gone[d]))) for d, w in enumerate(words))


def test_substring_edge_cases(spark, edge_rows):
    assert found(substring.remove_repeats(documents(spark, edge_rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(edge_rows, 35)


@pytest.mark.parametrize("seed", range(4))
def test_substring_random(spark, monkeypatch, seed):
    """Hashes of one byte or two mix edges up all the time, half of the minimizers are hot, equal records are merged."""
    for name, value in {"BLOCK_WORDS": 40, "MANY": 1, "WIDTH": 1 + seed % 2, "HOT_SHARE": [0.3, 2][seed // 2], "PATHS_AT_ONCE": 7}.items():
        monkeypatch.setattr(substring, name, value)
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices("ab" if i % 3 else "abcdefgh", k=rng.randint(0, 60)))) for i in range(60)]
    assert found(substring.remove_repeats(documents(spark, rows), window=6, anchor=3), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows, 6)


def test_substring_hot_line_in_different_surroundings(spark):
    """A line shorter than a window is in all texts: its minimizers are hot, and nothing is removed on its account."""
    rng = random.Random(7)
    line, own = [f"l{i}" for i in range(20)], lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = own(60)
    rows = [(i, " ".join(own(30) + line + own(30) + (shared if i % 10 == 0 else []) + own(5))) for i in range(200)]
    docs = documents(spark, rows)
    assert len(substring.hot_minimizers(substring.document_rows(docs, "doc_id", "text"), 35, 12)) > 0
    got = found(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substring(rows, 35) and {k[2] for k in got} == {0, 60}


def test_paths_are_compacted_where_nothing_branches(spark):
    """p, q and r follow each other everywhere; s follows r in one place and begins on its own in another."""
    occurrences = [("p", 3), ("q", 5), ("r", 2)]
    rows, uid = [], {"p": 1, "q": 2, "r": 3, "s": 4}
    for doc, begin in ((1, 0), (2, 100)):
        for name, edges in occurrences:
            rows.append((doc, 0, begin, edges, uid[name]))
            begin += edges
    rows += [(1, 0, 10, 4, 4), (3, 0, 7, 4, 4)]
    got = {(r["a"], r["start"]): (r["head"], r["origin"]) for r in substring.compacted(spark.createDataFrame(rows, "a long, b long, start long, edges int, uid long")).collect()}
    assert got == {(1, 0): (1, 0), (1, 3): (1, 0), (1, 8): (1, 0), (2, 100): (1, 100), (2, 103): (1, 100), (2, 108): (1, 100), (1, 10): (4, 10), (3, 7): (4, 7)}
    chain = [(d, 0, i, 1, 1000 + i) for d in (1, 2) for i in range(150)]
    got = substring.compacted(spark.createDataFrame(chain, "a long, b long, start long, edges int, uid long")).collect()
    assert len(got) == 300 and {(r["head"], r["origin"]) for r in got} == {(1000, 0)}


def test_substring_empty_table(empty):
    assert substring.remove_repeats(empty).count() == 0


# Lines


def brute_lines(rows, min_docs, keep_first):
    key = lambda line: lower(line).strip(" \t\n\x0b\x0c\r")
    docs = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows}, key=str)
    holders = defaultdict(set)
    for i, d in enumerate(docs):
        for line in (d[2] or "").split("\n"):
            if key(line):
                holders[key(line)].add(i)
    bad = {k for k, v in holders.items() if len(v) >= min_docs}
    return bad, key


def test_lines_dropped_everywhere(spark, edge_rows):
    docs = documents(spark, edge_rows)
    bad, key = brute_lines(edge_rows, 10, False)
    assert bad
    want = Counter()
    for doc_id, text, *_ in edge_rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        want[doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    assert found(linededup.digest_lines(docs, linededup.keep_bitmaps(docs, 10, False)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


@pytest.mark.parametrize("partitions", ["1", "7"])
@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_lines_first_stays(spark, min_docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(3)
        rows = [(i, "\n".join(rng.choices(["Hot", " hot", "b", "c", "d%d" % i, ""], weights=[9, 3, 2, 1, 3, 1], k=rng.randint(1, 9)))) for i in range(80)]
        docs = documents(spark, rows)
        got = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs, linededup.keep_bitmaps(docs, min_docs, True)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    bad, key = brute_lines(rows, min_docs, True)
    seen, want = set(), {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            if key(line) not in bad or key(line) not in seen:
                kept.append(line)
            seen.add(key(line)) if key(line) in bad else None
        want[i] = "\n".join(kept)
    assert got == want


def test_lines_empty_table_and_columns(spark, empty, edge_rows):
    assert linededup.drop_lines(empty, linededup.keep_bitmaps(empty)).count() == 0
    docs = documents(spark, edge_rows)
    kept = linededup.drop_lines(docs, linededup.keep_bitmaps(docs))
    assert kept.columns == docs.columns and kept.count() == len(edge_rows)
    assert kept.where("doc_id = 1").first()["text"] is None


# Decontamination


def brute_benchmark(rows, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or "")) if item is not None else []
        for p in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[p : p + window])].add(str(item))
    sizes, out = {len(w) for w in windows}, Counter()
    for doc_id, text, *_ in rows:
        w, hit, seen = word.findall(lower(text or "")), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    seen |= owners
        out[doc_id, len(w), len(hit), len(seen), sha(",".join(sorted(seen))), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 30])
def test_decontamination(spark, edge_rows, monkeypatch, block_words):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 100)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(["the", "Of", "x1,", "tie", "été", "and"], k=rng.randint(1, 14)))) for i in range(40)] + [(None, "the of"), (50, None), (51, ""), (52, "..."), (53, "tie")]
    rows = edge_rows + [(500 + i, f"Intro; {items[i][1].upper()} -- outro the {items[i + 1][1]}") for i in range(30)]
    benchmark = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = decontam.contamination(documents(spark, rows), benchmark, window=4, block_words=block_words)
    assert found(decontam.digests(got), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_benchmark(rows, items, 4)


def test_decontamination_longest_match(spark):
    docs = documents(spark, [(1, "z z a b c d e f g z a b c d"), (2, "q")])
    row = decontam.contamination(docs, spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string"), window=3).where("doc_id = 1").first()
    assert (row["longest"], row["longest_item"], row["longest_at"]) == (7, "7", 2)


@pytest.mark.parametrize("bits", [21, 31])
@pytest.mark.parametrize("window", [1, 2, 3, 5, 8])
@pytest.mark.parametrize("block_words", [1_000_000, 25])
def test_decontamination_longest_matches_equal_brute_force(spark, monkeypatch, window, block_words, bits):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 20)
    monkeypatch.setattr(decontam.Suffixes.__init__, "__defaults__", (bits,))
    rng = random.Random(window)
    items = [(i, " ".join(rng.choices("abcdef", k=rng.randint(1, 9)))) for i in range(12)]
    rows = [(i, " ".join(rng.choices("abcdefxyz", weights=[3] * 6 + [1, 1, 9], k=rng.randint(0, 30)))) for i in range(60)] + [(99, "x y z")]
    got = decontam.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=window, block_words=block_words)
    assert found(decontam.digests(got), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_benchmark(rows, items, window)
    tests = {str(i): t.split() for i, t in items}
    within = lambda a, b: any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
    for r in got.collect():
        w = dict(rows)[r["doc_id"]].split()
        best = max((n for p in range(len(w)) for n in range(1, len(w) - p + 1) if any(within(w[p : p + n], t) for t in tests.values())), default=0)
        assert r["longest"] == best
        if best:
            match = w[r["longest_at"] : r["longest_at"] + best]
            assert within(match, tests[r["longest_item"]])
        else:
            assert r["longest_item"] is None and r["longest_at"] is None


def test_decontamination_in_several_passes(spark, monkeypatch, edge_rows):
    monkeypatch.setattr(decontam, "RESIDENT", 2)
    items = [(i, f"the of {w} and tie loop") for i, w in enumerate(["x1", "été", "señor", "the", "of", "tie", "loop"])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(documents(spark, edge_rows), benchmark, window=3, block_words=6)
    assert found(decontam.digests(got), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_benchmark(edge_rows, items, 3)


def test_decontamination_empty_tables(spark, empty, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(empty, none).count() == 0
    assert decontam.contamination(documents(spark, edge_rows), none).where("n_hit > 0").count() == 0


# Secrets


def test_secrets_equal_brute_force(spark, edge_rows):
    rng = random.Random(6)
    parts = ["password", "TOKEN", "secret", "Api_Key", "ſecret", "=", ":", " ", "'", '"', "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "x", "\n", "é", ".", "user", "host", "日"]
    rows = edge_rows + [(2000 + i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(1500)]
    want = Counter()
    for doc_id, text, *_ in rows:
        t, spans = text or "", []
        for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            spans += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(s[1] for s in spans)
        want[doc_id, n[0], n[1], n[2], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)))] += 1
    assert found(secrets.scan(documents(spark, rows)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_weak_parts_need_their_complement():
    spans = lambda t: secrets.listed(s := secrets.strong_spans(t)) + "|" + secrets.listed(secrets.weak_spans(t, s))
    assert spans("user = bob\npwd = hunter22\n") == "|weak_id:0:10,weak_secret:11:25"
    assert spans("user = bob\n\npwd = hunter22\n") == "|"
    assert spans("pwd = hunter22\nhost = db.example\n") == "|weak_secret:0:14"
    assert spans("[a]\nuser = bob\n[b]\npwd = hunter22\n") == "|"
    assert spans("login: bob\ntoken = abcdefgh\nhttps://db.example/x\n") == "assign:11:27|weak_id:0:10,endpoint:28:48"


def test_weak_parts_of_compound_names():
    def reported(text):
        strong = secrets.strong_spans(text)
        return [(secrets.KINDS[k], text[s:e]) for s, k, e in sorted(strong + secrets.weak_spans(text, strong))]

    key = "AKIA" + "ABCD" * 4
    secret = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    for name in ("AWS_SECRET_ACCESS_KEY=", "secret_key: ", 'secretAccessKey": "', "aws.secret-access-key = ", "SECRET_KEY_PROD="):
        assert reported(f"AWS_ACCESS_KEY_ID={key}\n{name}{secret}\n") == [("access", key), ("weak_secret", name + secret)]
    env = ["DB_USER=admin", "DB_PASS=hunter2", "DB_HOST=db.example.com"]
    assert reported("\n".join(env)) == list(zip(("weak_id", "weak_secret", "endpoint"), env))
    camel = ["dbUser: admin", "dbPass: hunter2", "dbHostName: db.example.com"]
    assert reported("\n".join(camel)) == list(zip(("weak_id", "weak_secret", "endpoint"), camel))
    assert reported("\n\n".join(env)) == reported("secret_key: abcdEFGH12") == []
    assert reported("MY_CLIENT_ID=abc9\nSIGNING_KEY_2=abcd1") == [("weak_id", "MY_CLIENT_ID=abc9"), ("weak_secret", "SIGNING_KEY_2=abcd1")]
    assert reported("login: bob\nmonkey: banana\ncompass = north\npass_rate: 0.95\n") == []
    assert reported("--user=bob --pass=hunter2") == [("weak_id", "user=bob"), ("weak_secret", "pass=hunter2")]
    assert reported("note: user=bob pin=1234\nbase_url: https://a.b/c http://d.e/f") == [("weak_id", "user=bob"), ("weak_secret", "pin=1234"), ("endpoint", "base_url: https://a.b/c"), ("endpoint", "http://d.e/f")]


def brute_weak(text):
    """Weak spans over lines of ``name sep value``, scope by scope, by the kinds that a table of names gives."""
    kinds = {"user": "weak_id", "login": "weak_id", "client_id": "weak_id", "pwd": "weak_secret", "db_pass": "weak_secret", "host": "endpoint", "base_url": "endpoint", "color": None, "pass_rate": None}
    out, at, scope = [], 0, []

    def settle():
        have = {k for _, k, _ in scope}
        has_id, has_secret, has_endpoint = "weak_id" in have, bool(have & {"weak_secret", "assign"}), "endpoint" in have
        complete = {"weak_id": has_secret, "weak_secret": has_id or has_endpoint, "endpoint": has_id and has_secret, "assign": True}
        out.extend(p for p in scope if complete[p[1]])
        scope.clear()

    for line in text.split("\n"):
        if not line.strip() or re.fullmatch(r"\[[^\]]*\]", line.strip()):
            settle()
        elif m := re.match(r"(\w+)( ?[=:] ?)(\S+)$", line):
            kind = "assign" if m[1] == "token" and len(m[3]) >= 6 else kinds.get(m[1])
            least = {"weak_id": 3, "weak_secret": 4, "endpoint": 3, "assign": 6}.get(kind)
            if kind and len(m[3]) >= least:
                scope.append((at, kind, at + len(line)))
        at += len(line) + 1
    settle()
    order = list(secrets.KINDS)
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda p: (p[0], order.index(p[1]))))


def test_weak_spans_equal_brute_force(spark):
    rng, rows = random.Random(11), []
    names = ["user", "login", "client_id", "pwd", "db_pass", "host", "base_url", "color", "pass_rate", "token"]
    for i in range(400):
        lines = []
        for _ in range(rng.randint(0, 9)):
            kind = rng.random()
            value = "".join(rng.choices("ghkxyz", k=rng.randint(1, 8)))
            lines.append("" if kind < 0.15 else "[part]" if kind < 0.25 else "plain words here" if kind < 0.35 else f"{rng.choice(names)}{rng.choice(['=', ' = ', ': '])}{value}")
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(documents(spark, rows)).collect()}
    want = {i: brute_weak(t) for i, t in rows}
    assert got == want and sum(map(bool, want.values())) > 50 and any("endpoint" in w for w in want.values())


def test_secrets_empty_table(empty):
    assert secrets.scan(empty).count() == 0


# Language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def test_language_edges_and_mixtures(spark, edge_rows, empty):
    assert langid.identify(empty).count() == 0
    got = langid.identify(documents(spark, edge_rows)).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 11))
    english, french = "the cat and the dog were there with that thing ", "le chat et les chiens sont dans une maison avec eux "
    train = documents(spark, [(i, english * 4, "en") for i in range(12)] + [(20 + i, french * 4, "fr") for i in range(12)] + [(40, english, None)])
    model = langid.learn(train, lambda c: crc_mod(c, 4) != 2)
    assert model.infer(english * 3)[0] == "en" and model.infer(french * 3)[0] == "fr"
    label, score, mixture = model.infer(english * 30 + french * 12)
    assert label == "en" and set(mixture) == {"en", "fr"} and 0.55 < mixture["en"] < 0.85 and score == pytest.approx(mixture["en"])
    long = model.infer((english * 3000)[:100_000])
    assert long[0] == "en"


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choices(["a", "É", "b", " ", "  ", ".", "日", "1", "\n"], k=rng.randint(0, 40)))
        want = langid.grams(text)
        for piece in (1, 2, 3, 7):
            monkeypatch.setattr(langid, "PIECE", piece)
            got = langid.grams(text)
            assert (got is None) == (want is None)
            assert got is None or (got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist())
        monkeypatch.undo()


def test_mixture_equals_plain_expectation_maximisation():
    """Against loops over plain numbers: the proportions, and the language set, found among all sets."""
    from itertools import combinations
    from math import log

    import numpy as np

    rng = random.Random(4)
    texts = {"aa": "the cat and the dog", "bb": "le chat et les chiens", "cc": "der hund und die katze"}
    counts = np.zeros((3, 2 * langid.BUCKETS))
    for i, t in enumerate(texts.values()):
        at, n = langid.grams(t * 5)
        counts[i, at] = n
    model = langid.Mixture(list(texts), counts)

    def em(chosen, p, n):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(400):
            new = [0.0] * len(chosen)
            for row, k in zip(p, n):
                whole = sum(s * row[c] for s, c in zip(share, chosen))
                for j, c in enumerate(chosen):
                    new[j] += k * share[j] * row[c] / whole
            share = [x / sum(n) for x in new]
        return share, sum(k * log(sum(s * row[c] for s, c in zip(share, chosen))) for row, k in zip(p, n))

    for mix in [{"aa": 9}, {"bb": 4, "aa": 9}, {"cc": 6, "bb": 2}, {"aa": 5, "bb": 3, "cc": 3}]:
        words = [w for k, times in mix.items() for w in texts[k].split() * times]
        rng.shuffle(words)
        at, n = langid.grams(" ".join(words))
        p = model.p[at].tolist()
        price, every = langid.PENALTY * log(sum(n) + 1), {}
        for size in (1, 2, 3):
            for chosen in combinations(range(3), size):
                share, reached = em(chosen, p, n.tolist())
                every[chosen] = (reached - price * (size - 1), dict(zip([model.languages[c] for c in chosen], share)))
        _, want = max(every.values(), key=lambda x: x[0])
        label, _, got = model.infer(" ".join(words))
        assert set(got) == set(want) == set(mix)
        assert label == max(want, key=want.get) and all(abs(got[k] - want[k]) < 0.02 for k in want)


# Toxicity


def test_machine_learns_pairs_that_weights_cannot():
    import numpy as np

    rng = random.Random(8)
    texts, labels = [], []
    for _ in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{rng.randrange(40)}" for _ in range(6)] + (["vile"] if insult else ["mild"]) + (["clan"] if group else ["tree"])
        texts.append(toxicity.terms_of(" ".join(words).encode()))
        labels.append(int(insult == group))  # no additive weight helps
    machine = toxicity.fit(texts[:1000], labels[:1000])  # as it is shipped
    right = lambda m: np.mean([(m.score(t) >= 0.5) == y for t, y in zip(texts[1000:], labels[1000:])])
    assert right(machine) > 0.9
    linear = toxicity.Machine(machine.terms, machine.bias, machine.weights, np.zeros_like(machine.vectors))
    assert right(linear) < 0.6


def test_score_equals_the_sum_over_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(0, 400, 2), -0.7, rng.normal(size=200), rng.normal(size=(200, 4)))
    for n in (0, 1, 2, 30):
        found = np.sort(rng.choice(400, n, replace=False))
        at = [f // 2 for f in found if f % 2 == 0]
        z = machine.bias + sum(machine.weights[i] for i in at)
        z += sum(float(machine.vectors[i] @ machine.vectors[j]) for k, i in enumerate(at) for j in at[k + 1 :]) / max(len(at), 1)
        assert machine.score(found) == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_learns_pairs(spark):
    rng, rows, marks = random.Random(8), [], []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([f"n{rng.randrange(200)}" for _ in range(20)] + ["vile" if insult else "mild", "clan" if group else "tree"])))
        marks.append((i, int(insult == group)))  # each word alone is as common in both
    got = toxicity.toxicity(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")).where("held_out").collect()
    assert sum(r["predicted"] == dict(marks)[r["doc_id"]] for r in got) / len(got) > 0.95


def test_toxicity_learns_from_all_terms_of_long_texts(spark):
    words = [f"w{i}" for i in range(9000)]
    docs = documents(spark, [(i, " ".join(words + (["idiot"] if i % 2 else []))) for i in range(8)])
    machine = toxicity.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int"), lambda c: F.lit(True))
    whole = toxicity.terms_of(" ".join([*words, "idiot"]).encode())
    assert set(machine.terms.tolist()) == set(whole.tolist())


def test_toxicity_fits_what_comes_to_the_driver_within_its_bound(spark, monkeypatch):
    import numpy as np

    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choices(words[:60], k=20) + rng.choices(words[60:], k=5) + (["idiot"] if i % 3 == 0 else []))) for i in range(300)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    came = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: came.append(texts) or fit(texts, y))
    whole = toxicity.learn(docs, labels, lambda c: F.lit(True))
    plain = fit([toxicity.terms_of(t.encode()) for _, t in rows], [int(i % 3 == 0) for i in range(300)])
    assert whole.terms.tolist() == plain.terms.tolist() and np.allclose(whole.weights, plain.weights) and np.allclose(whole.vectors, plain.vectors)
    toxicity.learn(docs, labels, lambda c: F.lit(True), max_terms=2000)
    sizes = [sum(len(t) for t in texts) for texts in came]
    assert len(came[0]) == 300 and 1000 < sizes[1] < 3000 < sizes[0] < sum(len(toxicity.terms_of(t.encode())) for _, t in rows)


def test_toxicity_edges(spark, edge_rows, empty):
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(4, 10)] + [(None, 1, ""), (100, None, ""), (101, 1, ""), (101, 0, "")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(documents(spark, edge_rows), labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(documents(spark, edge_rows), labels.limit(0)).count() == len(edge_rows)


def test_toxicity_of_equal_texts_is_equal_and_one_label_gives_its_share(spark):
    """Ties: rows of equal texts score alike, whatever their ids; labels of one kind give one score to all."""
    docs = documents(spark, [(i, "same words here") for i in range(20)] + [(100 + i, None) for i in range(5)] + [(200, " ".join(f"w{i}" for i in range(30_000)))])
    both = toxicity.toxicity(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")).collect()
    assert len({r["score"] for r in both if r["doc_id"] < 20}) == 1 and len({r["score"] for r in both if 100 <= r["doc_id"] < 200}) == 1
    one = toxicity.toxicity(docs, spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["predicted"] == 0


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(1500):
        words = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(60)]
        toxic = rng.random() < 0.15
        if toxic:
            words[rng.randrange(60)] = rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    got = toxicity.toxicity(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")).where("held_out").collect()
    truth = dict(marks)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
    assert {r["doc_id"] for r in got} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}


def test_crc_matches_zlib(spark):
    got = spark.range(50).select("id", crc_mod("id", 4).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)
    assert spark.createDataFrame([(None,)], "id long").select(F.isnull(crc_mod("id", 4)).alias("n")).first()["n"]
