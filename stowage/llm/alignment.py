"""Cross-tokenizer alignment by packed bitsets of token ends.

Two tokenizers cut the same bytes. Each one's token ends are a packed bitset over the bytes: AND gives the cuts that
both share, OR the cuts of either. The rank of a cut, a popcount of the bits before it, is the number of tokens that end
up to there, so ranks at shared cuts give each group's range of tokens on both sides, and ranks at the cuts of either
give the one token on each side that covers the stretch up to it: each such stretch is a link, and no two are the same.

A text is first cut at single spaces between other characters, which no token of either side spans unless it begins
there; a text of any length is aligned a piece at a time. What a link's pair of ids counts in the corpus is looked up in a
table of the most frequent pairs, of bounded size; the pairs beyond it, none of which is frequent, are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import bpe
from stowage.llm.common import cut, slices, small_batches, worker_state
from stowage.scratch import new_folder

PIECE = 1 << 18  # characters after which a text is cut at the next single space
UNBROKEN = 1 << 20  # characters of a piece that may be encoded at once
BATCH = 1 << 20  # characters of pieces that are aligned at once
TABLE = 1 << 19  # pairs of the table that is broadcast, 17 bytes each
HELD = 1 << 20  # pairs that a task adds up before it hands them on

_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(text: str, least: int) -> Iterator[str]:
    """The text in pieces of at least ``least`` characters, without the single spaces that it is cut at.

    A byte-level pretoken may begin with such a space but not go across it, and no piece of the other vocabulary has a
    space after another character. A text without such a space is one piece.
    """
    at = 0
    while len(text) - at > least and (found := _CUT.search(text, at + least)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, definition: str, model: bytes):
        import numpy as np
        import sentencepiece

        self.a = bpe.Transducer(definition)
        self.a.special_split, self.a.special = None, {}  # their strings are plain text here
        known, spec = bpe.byte_alphabet(), json.loads(definition)["model"]
        a_bytes = {i: bytes(known[c] for c in t) for t, i in spec["vocab"].items() if all(c in known for c in t)}
        self.merger = self._merger(spec, a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in named):
            raise ValueError("a piece has a space after another character, so texts can't be cut at single spaces")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = b_bytes
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, b_bytes))
        # Ids as text with what may follow them: within a side, after the first side, after a group.
        self.a_text = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_text = [f"{i}{end}" for i in range(len(b_bytes)) for end in ",;"]

    @staticmethod
    def _merger(spec: dict, a_bytes: dict[int, bytes]):
        """The library that merges by the rank of the whole, if ids are in the order of the merges; else None."""
        import tiktoken

        made = [spec["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["merges"]]
        if len(set(made)) < len(made) or made != sorted(made) or len({a_bytes.get(i) for i in range(256)} & {bytes([b]) for b in range(256)}) < 256:
            return None
        ranks = {a_bytes[i]: i for i in [*range(256), *made]}
        return tiktoken.Encoding("ranks", pat_str=bpe._filled(bpe.ANY_TEXT), mergeable_ranks=ranks, special_tokens={})

    def encode(self, piece: str):
        """Ids of both sides for a space and the piece; None if either side's bytes are others.

        A long piece without any cut goes through the transducer, whose memory doesn't grow with it.
        """
        import numpy as np

        wanted = b" " + piece.encode()
        if self.merger and len(piece) <= UNBROKEN:
            a = self.merger.encode_to_numpy(" " + piece, disallowed_special=())
        else:
            a = np.frombuffer(b"".join(self.a.encode(" " + piece)), "<u4")
        of_b = self.b.encode(piece, num_threads=1)
        b = np.array(of_b, np.uint32)
        whole = int(self.a_size[a].sum()) == len(wanted) and b"".join(map(self.b_bytes.__getitem__, of_b)) == wanted
        return (a, b) if whole else None


class Bits:
    """A packed bitset with ranks: how many bits are set before a place."""

    def __init__(self, words):
        import numpy as np

        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def of(places, size: int) -> "Bits":
        import numpy as np

        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        return Bits(np.packbits(bits, bitorder="little").view("<u8"))

    def rank(self, places):
        import numpy as np

        word, bit = places >> 6, (places & 63).astype(np.uint64)
        padded = np.append(self.words, np.uint64(0))
        return self.before[word] + np.bitwise_count(padded[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def places(self):
        """Where bits are set, in order: select of every rank."""
        import numpy as np

        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(a, b, a_size, b_size):
    """(groups, links) of two sequences of ids over the same bytes.

    groups: for each, the first token of a, the one after its last, and the same of b. links: for each, its places in a
    and b. Both in order.
    """
    import numpy as np

    ends = [np.cumsum(size[ids]) - 1 for ids, size in ((a, a_size), (b, b_size))]  # a token's last byte
    n = int(ends[0][-1]) + 1
    of_a, of_b = Bits.of(ends[0], n), Bits.of(ends[1], n)
    shared = Bits(of_a.words & of_b.words).places()
    stop_a, stop_b = of_a.rank(shared + 1), of_b.rank(shared + 1)
    begin = lambda stop: np.concatenate([[0], stop[:-1]])
    either = Bits(of_a.words | of_b.words).places()
    return (begin(stop_a), stop_a, begin(stop_b), stop_b), (of_a.rank(either), of_b.rank(either))


def written(pair: Pair, a, b, groups) -> tuple[list[str], object]:
    """The ids of all groups as texts in order, and how many of these texts there are up to each group's end."""
    import numpy as np

    a0, a1, b0, b1 = groups
    out = np.empty(len(a) + len(b), object)
    index = np.arange(len(groups[0]))
    of_a, of_b = np.repeat(index, a1 - a0), np.repeat(index, b1 - b0)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[a1 - 1] = 1
    last_b[b1 - 1] = 1
    out[np.arange(len(a)) + b0[of_a]] = [pair.a_text[i] for i in (a.astype(np.int64) * 2 + last_a).tolist()]
    out[np.arange(len(b)) + a1[of_b]] = [pair.b_text[i] for i in (b.astype(np.int64) * 2 + last_b).tolist()]
    return out.tolist(), a1 + b1


def tally(keys, times=None):
    """Distinct keys, sorted, and how often each occurs, or the sums of their times."""
    import numpy as np

    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


class _Document:
    """What is known of a document while its pieces are aligned."""

    def __init__(self):
        self.valid, self.a, self.b, self.groups, self.links = True, 0, 0, 0, 0
        self.digest, self.keys, self.times, self.begun = hashlib.sha256(), [], [], False

    def add(self, text: str, a: int, b: int, groups: int, keys) -> None:
        import numpy as np

        if self.begun:
            self.digest.update(b";")
        self.digest.update(text.encode())
        self.begun = True
        self.a, self.b, self.groups, self.links = self.a + a, self.b + b, self.groups + groups, self.links + len(keys)
        own, times = tally(keys)
        self.keys.append(own)
        self.times.append(times)
        if len(self.keys) == 16:
            own, times = tally(np.concatenate(self.keys), np.concatenate(self.times))
            self.keys, self.times = [own], [times]

    def row(self) -> tuple:
        import numpy as np

        if not (self.valid and self.begun):
            return 0, 0, 0, 0, "", b"", b""
        keys, times = (self.keys[0], self.times[0]) if len(self.keys) == 1 else tally(np.concatenate(self.keys), np.concatenate(self.times))
        return self.a, self.b, self.groups, self.links, self.digest.hexdigest(), keys.astype("<i8").tobytes(), times.astype("<i8").tobytes()


def _aligned(pair: Pair, batch: list) -> None:
    """Aligns pieces (document, ids of a, ids of b), all of them as one sequence: a piece's end is a cut of both sides."""
    import numpy as np

    a, b = np.concatenate([x[1] for x in batch]), np.concatenate([x[2] for x in batch])
    groups, (link_a, link_b) = align(a, b, pair.a_size, pair.b_size)
    texts, upto = written(pair, a, b, groups)
    keys = a[link_a].astype(np.int64) << 32 | b[link_b].astype(np.int64)
    tokens = np.cumsum([len(x[1]) for x in batch])
    group_end = np.searchsorted(groups[1], tokens, "left") + 1  # a piece's last token ends its last group
    link_end = np.searchsorted(link_a, tokens, "left")
    g = t = k = 0
    for (document, of_a, of_b), g1, k1 in zip(batch, group_end.tolist(), link_end.tolist()):
        t1 = int(upto[g1 - 1])
        document.add("".join(texts[t:t1])[:-1], len(of_a), len(of_b), g1 - g, keys[k:k1])
        g, t, k = g1, t1, k1


def aligned_documents(docs: DataFrame, path: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row: ``pairs`` are its distinct linked
    pairs of ids as 64-bit integers, a's id in the upper half, and ``times`` how many links each has.

    Texts that are null or empty, and those whose joined tokens are not a space and the text, have no tokens: zeros and
    empty columns. No shuffle; both tokenizer files, of a size of their own, are read on the driver and broadcast.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    with open(path or bpe.default_path(), encoding="utf-8") as f, open(model or default_model(), "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches):
        key = tuple(hashlib.sha1(x if isinstance(x, bytes) else x.encode()).hexdigest() for x in shared.value)
        pair = worker_state("alignment", "pair", key, lambda: Pair(*shared.value))
        for batch in slices(batches, 256):
            documents, waiting, chars = [], [], 0
            for text in batch.column("text").to_pylist():
                documents.append(document := _Document())
                for part in pieces(text or "", piece) if text else ():
                    ids = pair.encode(part)
                    if ids is None:
                        document.valid = False
                        break
                    waiting.append((document, *ids))
                    chars += len(part)
                    if chars > BATCH:
                        _aligned(pair, waiting)
                        waiting, chars = [], 0
            if waiting:
                _aligned(pair, waiting)
            found = list(zip(*(d.row() for d in documents)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds))], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold a pair, and whether no pair of its b id has more."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        keys, times, held = [], [], 0

        def added():
            nonlocal keys, times, held
            own, sums = tally(np.concatenate(keys), np.concatenate(times))
            keys, times, held = [own], [sums], len(own)

        def flushed():
            nonlocal keys, times, held
            out = pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(times[0])], ["pair", "n"])
            keys, times, held = [], [], 0
            return out

        for batch in batches:
            for pairs, n in zip(batch.column("pairs"), batch.column("times")):
                keys.append(np.frombuffer(pairs.as_buffer(), "<i8"))
                times.append(np.frombuffer(n.as_buffer(), "<i8"))
                held += len(keys[-1])
                if held > 2 * HELD:
                    added()
                    if held > HELD:
                        yield flushed()
            if keys:  # the batch's buffers are let go
                added()
        if held:
            yield flushed()

    counted = cut(stored.where("n_links > 0").select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counted.groupBy(b).agg(F.max("n").alias("most"))
    # A row for each id of b that occurs: as many as its vocabulary has at most.
    return counted.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, table: int):
    """The most frequent pairs as arrays sorted by pair, at most ``table`` of them.

    All pairs of a count's quarter octave are in or out, so no pair that is out has over 2 ** 0.25 / table of all links.
    """
    import numpy as np

    level = F.floor(F.log2(F.col("n")) * 4).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect(), reverse=True):  # at most 256 levels
        held += r["pairs"]
        if held > table:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0, bool)
    got = counts.where(level >= least).orderBy("pair").toArrow()
    return got.column("pair").to_numpy(), got.column("n").to_numpy(), got.column("best").to_numpy()


def crosswalk(docs: DataFrame, path: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each document.

    Links are the pairs of token occurrences whose bytes overlap; a pair of ids counts the links that hold it in the
    corpus. ``n_best``: links whose count is the highest of their b id, ties included; ``count_sum``: the counts of all
    links in sum. ``groups_sha256`` is the hash of ``a1,a2|b1;a3|b2,b3``. Texts are encoded once and their pairs stored.

    Null and empty texts, and those that either tokenizer changes, have no tokens: zeros, and '' for the hash; they count
    nowhere. Null and repeated ids pass through; each row counts, repeated ones too. An empty table gives no rows.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "alignment")
    aligned_documents(docs, path, model, id_col, text_col, piece).withColumn("row_no", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    counts = cut(pair_counts(stored))
    shared = spark.sparkContext.broadcast(frequent(counts, table))
    id_type = stored.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", "row_no", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked_up(batch):
        """For each row, its pairs and times, where they are in the table, and which of them are there."""
        known = shared.value[0]
        for pairs, times in zip(batch.column("pairs"), batch.column("times")):
            keys, n = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(times.as_buffer(), "<i8")
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            yield keys, n, at, (known[at] == keys if len(known) else np.zeros(len(keys), bool))

    def sums(batches):
        _, count, best = shared.value
        for batch in slices(batches, 256):
            n_best, total = [], []
            for _, n, at, here in looked_up(batch):
                at, n = at[here], n[here]
                n_best.append(int(n[best[at]].sum()))
                total.append(int((n * count[at]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

    def others(batches):
        for batch in slices(batches, 256):
            rows, keys, times = [], [], []
            for row, (k, n, _, here) in zip(batch.column("row_no").to_pylist(), looked_up(batch)):
                keys.append(k[~here])
                times.append(n[~here])
                rows.append(np.full(len(keys[-1]), row, np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (rows, keys, times)], ["row_no", "pair", "times"])

    found = stored.mapInArrow(sums, f"doc_id {id_type}, row_no long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rare = stored.where("n_links > 0").select("row_no", "pairs", "times").mapInArrow(others, "row_no long, pair long, times long").join(counts, "pair")
    rare = rare.groupBy("row_no").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = lambda c, extra: (F.col(c) + F.coalesce(F.col(extra), F.lit(0))).alias(c)
    return found.join(rare, "row_no", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
