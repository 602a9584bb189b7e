import random
import re
from collections import Counter, defaultdict

from stowage.llm import divergence
from tests.llm.conftest import SCHEMA

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    df, out = defaultdict(Counter), []
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in df.items()}
    share = lambda counts, terms: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[t] for t in terms) + 5 * len(terms)) for t in terms}
    for lang in df:
        terms, groups = kept[lang], {}
        for x, source, words in docs:
            if x == lang:
                groups.setdefault(source, Counter()).update(words)
        p = {s: share(c, terms) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()), terms)
        for s in groups:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in groups if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in terms if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, lang, s, 0, "x", "y", "z", "w", "v", "u") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in divergence.audit(docs, **kw).collect())


def odd_rows(seed):
    rng = random.Random(seed)
    words = ["a", "A", "aa", "the", "The", "of", "Straße", "ÉTÉ", "été", "日本語", "𝒳𝒴", "it's", "x1y", "x_y", "[a]", "a" * 70, "a" * 65, "b" * 64, "é" * 200, "à", " z", "no-one", "İ", "~", "1", "a-a-a"]
    rows = []
    for _ in range(160):
        text = rng.choice([None, "", " ", "1 2 3"]) if rng.random() < 0.1 else rng.choice([" ", "\n", "  ", "\x00"]).join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(1, 40)))
        rows.append((text, rng.choice(["en", "en", "en", "de", "", None, "EN"]), rng.choice(["hot", "hot", "s1", "s2", "", None, "É"])))
    rows += [("same words again", "xx", f"s{i % 3}") for i in range(9)] + [("lonely", "one", "s")] + [(None, "nil", "s"), ("", "nil", "t")]
    return rows + [(" ".join(f"w{i % 13}" if i % 5 else "hot word" for i in range(60_000)), "en", "s1")]


def test_audit_equals_a_plain_count(spark):
    rows = odd_rows(1)
    for kw in ({"min_docs": 8, "top": 3}, {"min_docs": 2, "top": 50, "shard_chars": 60}):
        assert audited(spark, rows, **kw) == plain_audit(rows, kw["min_docs"], kw["top"])


def test_blocks_flushes_and_pieces_change_nothing(spark, monkeypatch):
    rows = odd_rows(2)
    want = plain_audit(rows, 5, 50)
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "BLOCK_CHARS", 50)
    monkeypatch.setattr(divergence.occurrences, "__defaults__", (50,))
    assert audited(spark, rows, min_docs=5, shard_chars=40) == want


def test_nothing_kept_and_empty_tables(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("a b", "en", "s")]) == []
    assert audited(spark, [("a b", "en", "s"), (None, "en", None)]) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]
