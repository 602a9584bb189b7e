import base64
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from stowage.llm import alignment, bpe
from tests.llm.conftest import documents


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as public
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    a = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def tokens(libraries, text):
    """(id, start, end) of both sides, or two empty lists."""
    a, b = libraries
    wanted, out = b" " + (text or "").encode(), []
    if not text:
        return [], []
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    for ids, of in ((a.encode_ordinary(" " + text), a.decode_single_token_bytes), (b.encode(text), piece)):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(of(i))))
            at = spans[-1][2]
        if b"".join(map(of, ids)) != wanted:
            return [], []
        out.append(spans)
    return tuple(out)


def plain(libraries, texts):
    both = [tokens(libraries, t) for t in texts]
    links, counts = [], Counter()
    for a, b in both:
        links.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
        counts.update(links[-1])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (a, b), own in zip(both, links):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [";"] and [",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi) for lo, hi in zip([0, *cuts], cuts)]
        out.append((len(a), len(b), len(cuts), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def texts():
    rng = random.Random(4)
    letters = list("abcdefgh iotns  ,.'0123ÄÖüßéñ\n\t日本語한국🙂▁\x00　 ")
    found = [None, "", " ", "  ", "a", "<|endoftext|>", "x <|endoftext|> y", "<s> </s> <0x41> <unk>", "a▁b", "▁", "naïve café déjà-vu", "it's 's  's", " leading", "trailing ", "tab\tand\r\nlines", "x" * 300, "é" * 90, "1234567890 " * 20, "🙂🙃" * 15]
    found += ["".join(rng.choices(letters, k=rng.randint(1, 120))) for _ in range(120)]
    common = "the quick brown fox jumps over the lazy dogs of unbelievable internationalisation".split()
    return found + [" ".join(rng.choices(common, k=rng.randint(1, 60))) for _ in range(60)] * 2


def answers(spark, rows, **kw):
    got = alignment.crosswalk(documents(spark, rows), **kw)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"table": 0, "piece": 5}, {"table": 40, "piece": 30}])
def test_crosswalk_equals_all_pairs_of_overlapping_tokens(spark, libraries, kw):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts())] + [(40, texts()[40])] * 2
    want = plain(libraries, [t for _, t in rows])
    assert answers(spark, rows, **kw) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=repr)


def test_pieces_of_a_long_text_are_aligned_alike(libraries):
    definition, model = open(bpe.default_path(), encoding="utf-8").read(), open(alignment.default_model(), "rb").read()
    pair = alignment.Pair(definition, model)
    rng = random.Random(9)
    words = ["the", "'s", "naïve", "x1", "--", "(a", "b)", "日本", "\n", "", "internationalisation", "we'll", "3.14"]
    text = " ".join(rng.choices(words, k=4000))
    a, b = pair.encode(text)
    assert a.tolist() == libraries[0].encode_ordinary(" " + text) and b.tolist() == libraries[1].encode(text)
    for least in (1, 7, 100):
        parts = [pair.encode(p) for p in alignment.pieces(text, least)]
        assert len(parts) > 10
        assert [i for p in parts for i in p[0].tolist()] == a.tolist() and [i for p in parts for i in p[1].tolist()] == b.tolist()


def test_a_piece_without_a_cut_goes_through_the_transducer(libraries, monkeypatch):
    pair = alignment.Pair(open(bpe.default_path(), encoding="utf-8").read(), open(alignment.default_model(), "rb").read())
    for text in ("x" * 500 + "é日本" * 90, "a  b\n\n c", "<|endoftext|>  <s>", "don't 's"):
        fast = pair.encode(text)
        with monkeypatch.context() as patched:
            patched.setattr(alignment, "UNBROKEN", 0)
            slow = pair.encode(text)
        assert fast[0].tolist() == slow[0].tolist() == libraries[0].encode_ordinary(" " + text) and fast[1].tolist() == slow[1].tolist()


def test_ranks_and_places_of_a_bitset():
    import numpy as np

    rng = random.Random(2)
    for size in (1, 63, 64, 65, 128, 1000):
        places = sorted(rng.sample(range(size), rng.randint(0, size)))
        bits = alignment.Bits.of(np.array(places, np.int64), size)
        assert bits.places().tolist() == places
        assert bits.rank(np.arange(size + 1)).tolist() == [sum(p < i for p in places) for i in range(size + 1)]


def test_empty_table_and_long_text(spark, libraries):
    assert answers(spark, []) == []
    text = "lorem ipsum dolor " * 40_000
    (row,) = answers(spark, [(1, text)])
    a, b = libraries
    assert row[1:3] == (len(a.encode_ordinary(" " + text)), len(b.encode(text))) and row[4] == row[1] + row[2] - row[3]
