"""Benchmark decontamination by suffix arrays over shards of the training text.

A task turns its documents into shards of word numbers (the benchmark's words; anything else is 0 and matches nothing)
and builds each shard's suffix array over the suffixes that share their first words with some test suffix, ordered by
their first ``window`` words. Every test suffix is then binary-searched in it, by its first ``window`` words and by
each shorter beginning: an equal range holds every verbatim occurrence and location. Runs of whole windows along a
diagonal give matches longer than a window; where there are none, the longest beginning with a range is the longest
match. Shards hold whole documents, so nothing is shuffled.

The benchmark is held in blocks of about ``BLOCK_WORDS`` words, ``RESIDENT`` of them at one time; a larger one takes
more passes over the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, slices, worker_state

BLOCK_WORDS = 500_000
RESIDENT = 4  # blocks that a pass searches
SHARD_WORDS = 500_000
PIECE = 1 << 20
BITS = 21  # of a word's number in a packed key, unless a block has more words

#: Findings of a document, with their types and first values.
FINDINGS = {"n_words": ("long", 0), "n_hit": ("long", 0), "hit": ("binary", None), "found": ("array<string>", []), "longest": ("long", 0), "longest_item": ("string", None), "longest_at": ("long", None)}

#: Words are runs of ASCII letters and digits, A-Z lower-cased, and of all bytes of characters beyond ASCII.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class Suffixes:
    """The suffixes of a block of benchmark items by their first ``window`` words, in order, and its windows.

    ``shared`` is how many first words each suffix has in common with the one before it, so the distinct beginnings of n
    words are those suffixes of n words or more that share fewer.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int, bits: int = BITS):
        import numpy as np

        self.number: dict[bytes, int] = {}
        self.window, self.items = window, [i for i, _ in items]
        ids = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.uint32) for _, text in items]
        self.bits = max(bits, len(self.number).bit_length())
        self.per_key = 63 // self.bits
        n = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(window, np.uint32)])
        item, place = np.repeat(np.arange(len(ids)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(np.repeat(n, n) - place, window)
        words = np.stack([np.where(size > j, flat[j : j + len(item)], 0) for j in range(window)], 1) if len(item) else np.zeros((0, window), np.uint32)
        order = np.lexsort(self.packed(words.astype(np.uint64))[::-1])
        self.words, self.size, self.item, place = words[order], size[order], item[order], place[order]
        differs = self.words[1:] != self.words[:-1]
        self.shared = np.append(-1, np.where(differs.any(1), differs.argmax(1), window)) if len(order) else np.zeros(0, np.int64)
        # Windows: full ones, and shorter items as a whole. Equal ones lie together, as whole items before other suffixes.
        full = self.size == window
        short = (place == 0) & (self.size < window)
        own = np.flatnonzero(full | short)
        new = np.ones(len(own), bool)
        new[1:] = (self.words[own[1:]] != self.words[own[:-1]]).any(1)
        first = np.flatnonzero(new)
        self.length, self.owner_at = self.size[own[first]].astype(np.int64), np.append(first, len(own))
        self.owner = np.stack([self.item[own], place[own]], 1)
        self.low, self.high = self.bounds(own[first], self.length)
        #: What a document's suffix must begin with to be in the array: the first words of long beginnings, short windows.
        self.lead = lead = min(self.per_key, window)
        self.starts = [(lead, np.sort(self.bounds(self.beginning(lead), lead)[0][0]))]
        self.starts += [(k, np.sort(self.low[0][self.length == k])) for k in range(1, lead)]
        self.starts = [(k, keys) for k, keys in self.starts if len(keys)]

    def beginning(self, n: int):
        """Suffixes that stand for the distinct beginnings of n words."""
        import numpy as np

        return np.flatnonzero((self.shared < n) & (self.size >= n))

    def packed(self, ids):
        """Columns of keys whose order is the order of the rows' words."""
        import numpy as np

        keys = []
        for at in range(0, ids.shape[1], self.per_key):
            key = np.zeros(len(ids), np.uint64)
            for j in range(self.per_key):
                key <<= np.uint64(self.bits)
                if at + j < ids.shape[1]:
                    key |= ids[:, at + j]
            keys.append(key)
        return keys

    def bounds(self, rows, length):
        """Least and largest keys of suffixes that begin with the first ``length`` words of these."""
        import numpy as np

        inside = np.arange(self.window)[None, :] < np.broadcast_to(length, len(rows))[:, None]
        low = np.where(inside, self.words[rows], 0).astype(np.uint64)
        return self.packed(low), self.packed(np.where(inside, low, np.uint64((1 << self.bits) - 1)))


def boundary(keys, wanted, after: bool):
    """For each wanted row, how many of the sorted rows are before it, equal ones included if ``after``."""
    import numpy as np

    n, m = len(keys[0]), len(wanted[0])
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, n - 1)
        less, equal = np.zeros(m, bool), np.ones(m, bool)
        for have, want in zip(keys, wanted):
            less |= equal & (have[mid] < want)
            equal &= have[mid] == want
        up = (less | equal if after else less) & (lo < hi)
        lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
    return lo


def member(values, ordered):
    import numpy as np

    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class SuffixArray:
    """The suffixes of a shard of word numbers that begin as some test suffix does, in order."""

    def __init__(self, shard, suffixes: Suffixes):
        import numpy as np

        self.of, self.shard = suffixes, shard
        ahead = np.zeros(len(shard) + suffixes.window, np.uint64)
        ahead[: len(shard)] = shard
        bits, lead = np.uint64(suffixes.bits), suffixes.per_key
        first, chosen = np.zeros(len(shard), np.uint64), np.zeros(len(shard), bool)
        whole = np.ones(len(shard), bool)  # no foreign word so far
        by_length = dict(suffixes.starts)
        for j in range(suffixes.lead):
            word = ahead[j : j + len(shard)]
            whole &= word > 0
            first |= np.where(whole, word, 0) << bits * np.uint64(lead - 1 - j)
            if j + 1 in by_length:
                chosen |= whole & member(first, by_length[j + 1])
        at = np.flatnonzero(chosen)
        words = np.zeros((len(at), suffixes.window), np.uint64)
        inside = np.ones(len(at), bool)
        for j in range(suffixes.window):
            word = ahead[at + j]
            inside &= word > 0
            words[:, j] = np.where(inside, word, 0)
        keys = suffixes.packed(words)
        order = np.lexsort(keys[::-1])
        self.at, self.keys = at[order], [k[order] for k in keys]

    def find(self, low, high):
        """(position, row) of every suffix between the rows' bounds."""
        import numpy as np

        if not len(self.at) or not len(low[0]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = boundary(self.keys, low, False), boundary(self.keys, high, True)
        count = hi - lo
        take = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.at[take], np.repeat(np.arange(len(count)), count)

    def windows(self):
        """(position, window) of every occurrence of a test window."""
        return self.find(self.of.low, self.of.high)

    def beginnings(self, still):
        """(length, positions, items): by falling length, where test suffixes begin for so many words; ``still(length)``
        says whether matches of this length are of use and, as a mask over the shard, where."""
        import numpy as np

        for n in range(self.of.window - 1, 0, -1):
            mask, rows = still(n), self.of.beginning(n)
            if mask is None or not len(rows):
                continue
            low, high = self.of.bounds(rows, n)
            if n >= self.of.lead:
                at, which = self.find(low, high)
                keep = mask[at]
                yield n, at[keep], self.of.item[rows[which[keep]]]
                continue
            # Short ones are everywhere: look only where they are of use.
            at = np.flatnonzero(mask & (self.shard > 0))
            words = np.zeros((len(at), self.of.window), np.uint64)
            for j in range(n):
                inside = at + j < len(self.shard)
                words[inside, j] = self.shard[at[inside] + j]
            key, order = self.of.packed(words)[0], np.argsort(low[0])
            found = member(key, low[0][order])
            yield n, at[found], self.of.item[rows[order[np.searchsorted(low[0][order], key[found])]]]


def _pass(docs: DataFrame, blocks: list[list[tuple[str, bytes]]], window: int, last: bool) -> DataFrame:
    """``docs`` (doc_id, text and findings so far) after some blocks of items; the last pass needs the text no more."""
    import numpy as np
    import pyarrow as pa

    shared, name = docs.sparkSession.sparkContext.broadcast(blocks), uuid.uuid4().hex

    def numbers(text: bytes | None, number) -> np.ndarray:
        text, parts, at = (text or b"").translate(TO_WORDS), [], 0
        while at < len(text):
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            found = text[at:end].split()
            parts.append(np.fromiter((number(w, 0) for w in found), np.uint32, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def shard(texts, rows, suffixes: Suffixes):
        """Adds what occurs in a shard of texts to the findings of their rows."""
        ids = [numbers(t, suffixes.number.get) for t in texts]
        sizes = np.array([len(i) + 1 for i in ids])
        begin = np.cumsum(sizes) - sizes
        whole = np.zeros(int(sizes.sum()), np.uint32)
        for b, i, row in zip(begin, ids, rows):
            whole[b : b + len(i)] = i
            row["n_words"] = len(i)
        array = SuffixArray(whole, suffixes)
        hits(array, ids, begin, whole, rows, suffixes)
        longest = np.array([r["longest"] for r in rows])

        def still(n: int):
            short = longest < n
            return np.repeat(short, sizes) if short.any() else None

        for n, position, item in array.beginnings(still):
            doc = np.searchsorted(begin, position, side="right") - 1
            order = np.lexsort((position, doc))
            for i in order[np.flatnonzero(np.append(True, np.diff(doc[order]) != 0))] if len(order) else ():
                d = doc[i]
                longest[d] = n
                rows[d] |= {"longest": n, "longest_item": suffixes.items[item[i]], "longest_at": int(position[i] - begin[d])}

    def hits(array: SuffixArray, ids, begin, whole, rows, suffixes: Suffixes):
        position, which = array.windows()
        if not len(position):
            return
        doc = np.searchsorted(begin, position, side="right") - 1
        edge = np.zeros(len(whole) + 1, np.int64)
        np.add.at(edge, position, 1)
        np.add.at(edge, position + suffixes.length[which], -1)
        covered = np.cumsum(edge[:-1]) > 0
        order = np.argsort(doc, kind="stable")
        doc, position, which = doc[order], position[order], which[order]
        cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(doc))):
            d = doc[lo]
            row, start = rows[d], begin[d]
            hit = covered[start : start + len(ids[d])]
            if row["hit"] is not None:
                hit = hit | np.unpackbits(np.frombuffer(row["hit"], np.uint8), count=len(hit)).astype(bool)
            row["hit"], row["n_hit"] = np.packbits(hit).tobytes(), int(hit.sum())
            owners = [suffixes.owner[suffixes.owner_at[w] : suffixes.owner_at[w + 1]] for w in which[lo:hi]]
            times = np.array([len(o) for o in owners])
            pairs = np.concatenate(owners)
            at = np.repeat(position[lo:hi] - start, times)
            row["found"] = sorted(set(row["found"]) | {suffixes.items[i] for i in np.unique(pairs[:, 0])})
            length = np.repeat(suffixes.length[which[lo:hi]], times)
            by = np.lexsort((at, at - pairs[:, 1], pairs[:, 0]))
            item, diagonal, at, length = pairs[by, 0], (at - pairs[:, 1])[by], at[by], length[by]
            new = np.append(True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (np.diff(at) != 1))
            first = np.flatnonzero(new)
            reach = np.diff(np.append(first, len(at))) - 1 + length[first]
            best = int(np.argmax(reach))
            if reach[best] > row["longest"]:
                row["longest"], row["longest_item"], row["longest_at"] = int(reach[best]), suffixes.items[item[first[best]]], int(at[first[best]])

    kept = ["doc_id"] if last else ["doc_id", "text"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        every = worker_state("decontam", "suffixes", name, lambda: [Suffixes(items, window) for items in shared.value])
        for batch in slices(batches, 512):
            rows, texts = batch.select(list(FINDINGS)).to_pylist(), batch.column("text").to_pylist()
            at, size = 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text or b"")
                if size >= 6 * SHARD_WORDS or end == len(texts):
                    for suffixes in every:
                        shard(texts[at:end], rows[at:end], suffixes)
                    at, size = end, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[c] for r in rows], kind) for c, kind in kinds.items())], [*kept, *kinds])

    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "hit": pa.binary(), "found": pa.list_(pa.string()), "longest": pa.int64(), "longest_item": pa.string(), "longest_at": pa.int64()}
    return docs.mapInArrow(run, docs.select(*kept, *FINDINGS).schema)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about ``block_words`` words; the driver holds one block at a time."""
    block, words = [], 0
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"].encode()))
        words += len(words_of(block[-1][1]))
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, hit, found, longest, longest_item, longest_at): a row for each row of ``docs``.

    ``hit`` is a bitmap of the words inside occurrences (null if none), ``found`` the ids of the items whose windows
    occur, sorted as strings; ``keep_text`` adds the text as ``text`` (binary). A window is ``window`` consecutive words
    of an item, or a shorter item as a whole. ``longest`` is the number of words of the longest verbatim match with any
    item, of one word or more, ``longest_at`` its first place among the document's words; of several items one is named.
    Null texts have no words; items of null id or text, or without words, have no window. Repeated rows each get their own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumns({c: (F.array() if first == [] else F.lit(first)).cast(kind) for c, (kind, first) in FINDINGS.items()})
    blocks, first = benchmark_blocks(benchmark, item_col, "text", block_words), True
    block = list(islice(blocks, RESIDENT))
    while first or block:
        following = list(islice(blocks, RESIDENT))
        rows = _pass(rows if first else cut(rows), block, window, not following and not keep_text)
        first, block = False, following
    return rows


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what ``contamination`` returns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
