"""Substring dedup on the de Bruijn graph of token k-mers: repeated edges, compacted paths, verified source spans.

Edges are the ``window``-token sequences of the corpus; the nodes between them are what consecutive ones share. As in
minimizer-partitioned graph construction, consecutive edges with the same minimizer (the least hash among their
``anchor``-token k-mers) travel as one record: the minimizer, the edges' hashes and the source coordinate. All
occurrences of an edge have the same minimizer at the same place, so they meet in the minimizer's partition.

1. Repeated edges: a minimizer's edges are counted, and the neighbours that each has in the records (its degrees) tell
   where paths branch. Nonbranching runs of repeated edges leave as paths, one row for each source coordinate.
2. Compaction: a join on coordinates finds which path follows which. Where one always follows another, and nothing else
   does, they are one; pointer jumping by joins finds each chain's first path and each path's place in its chain.
3. Verification: hashes of edges are short, so paths are only likely repeats. Each document reads the words of its
   compacted paths at their coordinates; paths stay if the same words (128 bits of hash) are read elsewhere too. Since
   paths break wherever any occurrence branches, occurrences of a path have the same extent, and edges that were mixed
   up are paths of their own: what is left are exactly the repeats.

Equal records of a block of documents are known to be repeated there and then: their paths leave under scattered keys,
and one record stands for them all. So a passage that a third of the corpus holds costs its minimizer one short record a
block, and equal ones of those are merged again while they stream by. A minimizer that many documents of a bounded sample
have, in whatever surroundings, deals out the edges of what is left one by one, by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, document_key, shuffle_partitions, slices, small_batches

BASE = 0x9E3779B97F4A7C15 | 1
BLOCK_WORDS = 500_000
PIECE = 1 << 20  # bytes of a text whose words are objects at one time
WIDTH = 4  # bytes kept of an edge's hash
RECORD = ["minimizer", "edges", "seen", "run", "uid", "places"]
RECORDS = "minimizer long, edges binary, seen int, run int, uid long, places binary"
MANY = 1 << 15  # records of one minimizer that are looked through for equal ones
SAMPLE_DOCS = 4000  # in expectation, in which hot minimizers are looked for
HOT_SHARE = 0.01  # of these documents; so there are at most a hundred times as many as a document has records
PATHS_AT_ONCE = 200_000  # of a task's documents, among which equal spans are looked for before rows are dealt out


#: A coordinate: both halves of the document's key, and the start.
PLACES = np.dtype([("a", "<i8"), ("b", "<i8"), ("start", "<u4")])


def _binary(lengths, data: bytes):
    """An Arrow column of binary values of given lengths that lie end to end."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(data)])


def _flat(column):
    """Lengths and bytes of an Arrow binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets), np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def _wide(data):
    """Packed edge hashes as 64-bit integers."""
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = data.reshape(-1, WIDTH)
    return out.view(np.uint64).ravel()


def word_hashes(text: bytes | None):
    """A 64-bit hash for each word (maximal run of bytes other than ASCII white space)."""
    import xxhash

    hash_of, parts, at, n = xxhash.xxh64_intdigest, [], 0, len(text or b"")
    while at < n:
        end = at + PIECE
        while end < n and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(np.array([hash_of(w) for w in text[at:end].split()], np.uint64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F | 1)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of all runs of ``n`` consecutive values, by prefix sums of a polynomial over the integers modulo 2^64."""

    def __init__(self, values):
        size = len(values) + 1
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        up, down = np.full(size, np.uint64(BASE)), np.full(size, inverse)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(values * np.multiply.accumulate(up)[:-1], out=self.sums[1:])

    def of(self, n: int):
        return _mixed((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def leftmost_minima(values, width: int):
    """For each start, the place of the first of the least of ``width`` values from there on."""
    least, place, span = values, np.arange(len(values), dtype=np.int32), 1

    def joined(shift):
        nonlocal least, place
        right = least[shift:] < least[:-shift]
        place = np.where(right, place[shift:], place[:-shift])
        least = np.where(right, least[shift:], least[:-shift])

    while 2 * span <= width:
        joined(span)
        span *= 2
    if width > span:
        joined(width - span)
    return place


def path_ids(minimizer, first, last, count):
    """A 64-bit number for a path of ``count`` edges within a minimizer's records, by its first and last edge (packed)."""
    with np.errstate(over="ignore"):
        return _mixed(minimizer ^ _mixed(first * np.uint64(3) + (last << np.uint64(32)) * np.uint64(5) + count.astype(np.uint64)))


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, a, b, text): both halves of the document's key, and the text as bytes."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), *document_key(docs, id_col, text_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    number = F.col("_key_id") if keyed.schema["_key_id"].dataType.simpleString() in ("bigint", "int") else F.xxhash64("_key_id")
    return keyed.select("doc_id", F.coalesce(number.cast("long"), F.lit(0).cast("long")).alias("a"), F.col("_key_text").alias("b"), "text")


class Edges:
    """The edges of documents that lie end to end: hashes, and for each the start and hash of its minimizer."""

    def __init__(self, sizes, values, window: int, anchor: int):
        piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rolling = Rolling(values)
        self.edge, gram = rolling.of(window), rolling.of(anchor)
        self.place = leftmost_minima(gram[: len(self.edge) + window - anchor], window - anchor + 1)
        self.starts = np.flatnonzero(piece[: len(self.edge)] == piece[window - 1 :])  # within one document
        self.piece, self.minimizer = piece, gram[self.place]


def hot_minimizers(docs: DataFrame, window: int, anchor: int):
    """Minimizers that at least ``HOT_SHARE`` of a sample of documents have, sorted: a bounded number, whatever the input."""
    import pyarrow as pa

    total = docs.count()
    span = 1 << 30
    share = min(span, span * SAMPLE_DOCS // max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("a", "b", F.lit(17)), F.lit(span)) < share)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            for text in batch.column("text").to_pylist():
                values = word_hashes(text)
                if len(values) >= window:
                    found = Edges([len(values)], values, window, anchor)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(found.minimizer).view(np.int64))], ["minimizer"])

    least = max(20, round(HOT_SHARE * min(total, SAMPLE_DOCS)))
    found = sample.select("text").distinct().mapInArrow(run, "minimizer long").groupBy("minimizer").count().where(F.col("count") >= least)
    return np.sort(np.array([r["minimizer"] for r in found.collect()], np.int64).view(np.uint64))


def edge_records(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The records (``RECORDS``) of each block of documents (a, b, text).

    A record has packed hashes of consecutive edges, how often they were seen (1, or 2 for more), and the coordinate of
    one occurrence. A row without edges is a finished path: ``run`` repeated edges at each of its coordinates.
    """
    import pyarrow as pa

    hot = docs.sparkSession.sparkContext.broadcast(hot_minimizers(docs, window, anchor))

    def records(pieces) -> pa.RecordBatch | None:
        """pieces: (document key, its second half, offset, hashes)."""
        sizes = np.array([len(p[3]) for p in pieces])
        values = np.concatenate([p[3] for p in pieces])
        if len(values) < window:
            return None
        ends = np.cumsum(sizes)
        found = Edges(sizes, values, window, anchor)
        edge, place, starts, piece = found.edge, found.place, found.starts, found.piece
        if not len(starts):
            return None
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (place[starts[1:]] != place[starts[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        head, tail = starts[first], starts[first + count - 1]
        minimizer = found.minimizer[head]
        with np.errstate(over="ignore"):  # first and last edge have all words of a record, as it is no longer than an edge
            same = _mixed(edge[head] * np.uint64(3) + edge[tail] * np.uint64(5) + count.astype(np.uint64)) ^ minimizer
        _, kept, group, times = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
        begin = np.array([p[2] for p in pieces]) - (ends - sizes)

        def coordinates(of):
            out = np.zeros(len(of), PLACES)
            own = piece[of]
            out["a"], out["b"] = np.array([p[0] for p in pieces])[own], np.array([p[1] for p in pieces])[own]
            out["start"] = of + begin[own]
            return out

        paths = coordinates(head[np.argsort(group, kind="stable")][np.repeat(times > 1, times)])
        take = np.repeat(first[kept] - np.append(0, np.cumsum(count[kept])[:-1]), count[kept]) + np.arange(count[kept].sum())
        packed = edge[starts[take]].view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()
        repeated = np.flatnonzero(times > 1)
        # What is left of a hot minimizer is dealt out edge by edge.
        length, among = count[kept], np.zeros(len(kept), bool)
        if len(hot.value):
            among = hot.value[np.minimum(np.searchsorted(hot.value, minimizer[kept]), len(hot.value) - 1)] == minimizer[kept]
        rows = np.where(among, length, 1)
        record, m = np.repeat(np.arange(len(kept)), rows), int(rows.sum())
        offset = np.arange(m) - np.repeat(np.cumsum(rows) - rows, rows)
        dealt = minimizer[kept][record]
        each = among[record]
        dealt[each] = _mixed(dealt[each] ^ edge[starts[take[((np.cumsum(length) - length)[record] + offset)[each]]]])
        short = np.uint64((1 << 8 * WIDTH) - 1)
        uid = path_ids(minimizer[kept], edge[head[kept]] & short, edge[tail[kept]] & short, count[kept])[repeated].view(np.int64)
        spread = _mixed((paths["b"] + paths["start"])[np.cumsum(times[repeated]) - times[repeated]].astype(np.uint64)) if len(repeated) else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([dealt, spread]).view(np.int64)),
                _binary(np.concatenate([np.where(each, 1, length[record]) * WIDTH, np.zeros(len(repeated), np.int64)]), packed),
                pa.array(np.concatenate([np.minimum(times, 2)[record], np.zeros(len(repeated), np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(m, np.int64), count[kept][repeated]]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(m, np.int64), uid])),
                _binary(np.concatenate([np.full(m, PLACES.itemsize), times[repeated] * PLACES.itemsize]), coordinates(head[kept][record] + offset).tobytes() + paths.tobytes()),
            ],
            RECORD,
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        waiting, words = [], 0
        for batch in slices(batches, 256):
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text"))):
                hashes = word_hashes(text)
                for at in range(0, max(len(hashes) - window + 1, 0), BLOCK_WORDS):
                    waiting.append((a, b, at, hashes[at : at + BLOCK_WORDS + window - 1]))
                    words += len(waiting[-1][3])
                    if words >= BLOCK_WORDS:
                        if (out := records(waiting)) is not None:
                            yield out
                        waiting, words = [], 0
        if waiting and (out := records(waiting)) is not None:
            yield out

    return docs.select("a", "b", "text").mapInArrow(run, RECORDS)


def repeated_paths(records: DataFrame) -> DataFrame:
    """(a, b, start, edges, uid): nonbranching runs of edges that occur more than once, at each source coordinate.

    Occurrences of a path have the same ``uid`` and extent. A record that stands for equal ones can leave twice, as a
    whole and by its parts.
    """
    import pyarrow as pa

    dealt = records.repartition(shuffle_partitions(records.sparkSession), "minimizer").sortWithinPartitions("minimizer")

    def rows(found, edges, uid) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found["a"]), pa.array(found["b"]), pa.array(found["start"].astype(np.int64)), pa.array(np.asarray(edges, np.int32)), pa.array(np.asarray(uid, np.int64))], ["a", "b", "start", "edges", "uid"])

    def places_of(batch):
        sizes, data = _flat(batch.column(5))
        return sizes // PLACES.itemsize, np.frombuffer(data.tobytes(), PLACES)

    def finished(batch) -> pa.RecordBatch:
        copies, found = places_of(batch)
        return rows(found, np.repeat(batch.column(3).to_numpy(), copies), np.repeat(batch.column(4).to_numpy(), copies))

    def only(edge, neighbour, n: int):
        """For each of n edges the one neighbour that all its occurrences have, or -1."""
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -2)
        np.minimum.at(least, edge, neighbour)
        np.maximum.at(most, edge, neighbour)
        return np.where(least == most, least, -1)

    def paths(batch) -> pa.RecordBatch | None:
        minimizer, seen = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        edge_bytes, edge_data = _flat(batch.column(1))
        n = edge_bytes // WIDTH
        row, value = np.repeat(np.arange(len(n)), n), _wide(edge_data)
        group = np.cumsum(np.append(0, minimizer[1:] != minimizer[:-1]))
        order = np.lexsort((value, group[row]))
        sorted_edge, sorted_group = value[order], group[row][order]
        new = np.append(True, (sorted_edge[1:] != sorted_edge[:-1]) | (sorted_group[1:] != sorted_group[:-1]))
        edge = np.empty(len(row), np.int64)
        edge[order] = np.cumsum(new) - 1
        total = np.bincount(edge, weights=seen[row])
        repeated = (total >= 2)[edge]
        if not repeated.any():
            return None
        # Degrees, as far as they matter: edges that are not repeated start and end no path.
        inner = np.append(False, row[1:] == row[:-1])  # the edge before is of the same record
        at = np.flatnonzero(repeated)
        before, after = np.where(inner, np.append(-1, edge[:-1]), -1), np.where(np.append(inner[1:], False), np.append(edge[1:], -1), -1)
        into, out = only(edge[at], before[at], len(total)), only(edge[at], after[at], len(total))
        goes_on = np.zeros(len(row), bool)  # from the edge before, at which nothing else begins or ends
        goes_on[1:] = inner[1:] & repeated[1:] & repeated[:-1] & (out[edge[:-1]] == edge[1:]) & (into[edge[1:]] == edge[:-1])
        begins = repeated & ~goes_on
        begin = np.flatnonzero(begins)
        length = np.bincount(np.cumsum(begins)[repeated] - 1, minlength=len(begin))
        of, offset = row[begin], begin - (np.cumsum(n) - n)[row[begin]]
        _, found = places_of(batch)
        found = found[of]
        found["start"] += offset.astype(np.uint32)
        return rows(found, length, path_ids(minimizer[of].view(np.uint64), value[begin], value[begin + length - 1], length).view(np.int64))

    def merged(batch) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        """One minimizer's records with equal ones as one, and the paths of those: what has an equal is repeated."""
        edge_bytes, edge_data = _flat(batch.column(1))
        n, value = edge_bytes // WIDTH, edge_data.reshape(-1, WIDTH)
        ids = [(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
        place: dict[bytes, int] = {}
        group = np.array([place.setdefault(e, len(place)) for e in ids])
        times = np.bincount(group)
        kept = np.unique(group, return_index=True)[1]
        again = times[group] > 1
        _, found = places_of(batch)
        wide, starts = _wide(value.ravel()), np.cumsum(n) - n
        uid = path_ids(batch.column(0).to_numpy().view(np.uint64), wide[starts], wide[starts + n - 1], n).view(np.int64)
        left = batch.take(pa.array(kept))
        seen = pa.array(np.where(times > 1, 2, left.column(2).to_numpy()).astype(np.int32))
        left = pa.RecordBatch.from_arrays([left.column(0), left.column(1), seen, *(left.column(i) for i in (3, 4, 5))], RECORD)
        return left, rows(found[again], n[again], uid[again]) if again.any() else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        waiting, held, looked = [], 0, MANY  # records of the last minimizer, which may go on

        def joined():
            return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

        for batch in slices(batches, 1 << 14):
            path = batch.column(2).to_numpy() == 0
            if path.any():
                yield finished(batch.filter(pa.array(path)))
                batch = batch.filter(pa.array(~path))
                if not batch.num_rows:
                    continue
            minimizer = batch.column(0).to_numpy()
            if waiting and minimizer[0] == minimizer[-1] == waiting[0].column(0)[0].as_py():
                waiting.append(batch)
            else:
                waiting.append(batch)
                got = joined()
                minimizer = got.column(0).to_numpy()
                whole = int(np.searchsorted(minimizer, minimizer[-1]))
                if whole and (out := paths(got.slice(0, whole))) is not None:
                    yield out
                waiting, held, looked = [got.slice(whole)], 0, MANY
            held = sum(w.num_rows for w in waiting)
            if held >= looked:
                left, out = merged(joined())
                if out is not None:
                    yield out
                waiting, looked = [left], max(MANY, 2 * left.num_rows)
        if waiting and (out := paths(joined())) is not None:
            yield out

    return dealt.mapInArrow(run, "a long, b long, start long, edges int, uid long")


def compacted(paths: DataFrame) -> DataFrame:
    """``paths`` (a, b, start, edges, uid; stable) with ``head``, the first path of their chain, and ``origin``, its start.

    Two paths are of one chain if each occurrence of the one is followed by the other, each of the other follows the
    one, and nothing else does either. Documents end, so chains do not close to rings.
    """
    ends = paths.select("a", "b", (F.col("start") + F.col("edges")).alias("at"), F.col("uid").alias("u"))
    begins = paths.select("a", "b", F.col("start").alias("at"), F.col("uid").alias("v"))
    pairs = cut(ends.join(begins, ["a", "b", "at"]).groupBy("u", "v").agg(F.count("*").alias("n")))
    sizes = paths.groupBy("uid").agg(F.count("*").alias("n"), F.max("edges").alias("edges"))
    after = pairs.groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("v"), F.sum("n").alias("n")).where("degree = 1").drop("degree")
    before = pairs.groupBy("v").agg(F.count("*").alias("degree"), F.min("u").alias("u"), F.sum("n").alias("n")).where("degree = 1").drop("degree")
    links = after.join(before, ["u", "v", "n"]).where("u <> v")
    links = links.join(sizes.withColumnRenamed("uid", "u"), ["u", "n"]).join(sizes.select(F.col("uid").alias("v"), "n"), ["v", "n"])
    pointers = cut(links.select(F.col("v").alias("uid"), F.col("u").alias("head"), F.col("edges").cast("long").alias("back")))
    moves = not pointers.isEmpty()
    while moves:
        table = pointers.select(F.col("uid").alias("head"), F.col("head").alias("_head"), F.col("back").alias("_back"))
        for _ in range(3):
            pointers = pointers.join(table, "head", "left").select("uid", F.coalesce("_head", "head").alias("head"), (F.col("back") + F.coalesce("_back", F.lit(0))).alias("back"), F.col("_head").isNotNull().alias("moved"))
        pointers = cut(pointers)
        moves = not pointers.where("moved").isEmpty()
        pointers = pointers.drop("moved")
    return paths.join(pointers, "uid", "left").select("a", "b", "start", "edges", F.coalesce("head", "uid").alias("head"), (F.col("start") - F.coalesce("back", F.lit(0))).alias("origin"))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def spans(paths: list[dict], window: int) -> set[tuple[int, int]]:
    """(first word, last word + 1) of a document's compacted paths."""
    chains: dict[tuple[int, int], set] = {}
    for p in paths:
        chains.setdefault((p["head"], p["origin"]), set()).add((p["start"], p["edges"]))
    return {(min(s for s, _ in c), max(s + e for s, e in c) + window - 1) for c in chains.values()}


def verified(with_paths: DataFrame, window: int) -> DataFrame:
    """(a, b, first, last): spans whose words are read at another coordinate too.

    Spans that are equal within a task's documents are settled there, and one row without a coordinate speaks for them;
    so the rows of a span are as many as there are blocks at most.
    """
    import pyarrow as pa
    import xxhash

    names = ["h1", "h2", "sure", "a", "b", "first", "last"]
    schema = "h1 long, h2 long, sure boolean, a long, b long, first int, last int"

    def batch_of(found) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds], names)

    def read(batches) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple]] = {}
        waiting = 0

        def settled() -> pa.RecordBatch:
            out = []
            for digest, places in held.items():
                h1, h2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                if len(places) == 1:
                    out.append((h1, h2, False, *places[0]))
                else:
                    out += [(h1 ^ a ^ b ^ first, h2, True, a, b, first, last) for a, b, first, last in places]
                    out.append((h1, h2, False, None, None, None, 2))
            held.clear()
            return batch_of(out)

        for batch in slices(batches, 256):
            for a, b, text, paths in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text", "paths"))):
                words = words_of(text)
                for first, last in spans(paths, window):
                    digest = xxhash.xxh3_128_digest(b" ".join(words[first:last]))
                    held.setdefault(digest, []).append((a, b, first, last))
                    waiting += 1
                if waiting >= PATHS_AT_ONCE:
                    yield settled()
                    waiting = 0
        if held:
            yield settled()

    def counted(batches) -> Iterator[pa.RecordBatch]:
        key, alone, many = None, None, False
        for batch in slices(batches, 1 << 14):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[2]:
                    out.append(row)
                    continue
                if row[:2] != key:
                    key, alone, many = row[:2], None, False
                if row[3] is None:
                    many = True
                elif many or alone is not None:
                    many = True
                    out.append(row)
                else:
                    alone = row
                if many and alone is not None:
                    out.append(alone)
                    alone = None
            if out:
                yield batch_of(out)

    found = with_paths.mapInArrow(read, schema)
    dealt = found.repartition(shuffle_partitions(with_paths.sparkSession), "h1").sortWithinPartitions("h1", "h2")
    return dealt.mapInArrow(counted, schema).select("a", "b", "first", "last")


def remove_repeats(docs: DataFrame, window: int = 35, anchor: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): each text without the words of windows that occur elsewhere too.

    A null text has no words. Rows that repeat are occurrences of their own, so they lose all their windows. Every
    occurrence goes, the first included. Kept words are joined by one space.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    rows = document_rows(docs, id_col, text_col)
    paths = compacted(cut(repeated_paths(edge_records(rows, window, anchor))))
    by_document = paths.groupBy("a", "b").agg(F.collect_list(F.struct("start", "edges", "head", "origin")).alias("paths"))
    # Both joins with the rows need the same columns, the id too, by the same keys, so the texts are dealt out once.
    keyed = rows.withColumnsRenamed({"a": "_a", "b": "_b"}).hint("merge")
    with_paths = keyed.join(by_document, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))).select("doc_id", F.col("_a").alias("a"), F.col("_b").alias("b"), "text", "paths")
    sure = verified(with_paths, window).groupBy("a", "b").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = keyed.join(sure, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left").select("doc_id", "text", "spans")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            total, removed, kept, digest = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = words_of(text)
                lost = 0
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [p["first"] for p in spans], 1)
                    np.add.at(edge, [p["last"] for p in spans], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    lost = int(gone.sum())
                    left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                else:
                    left = b" ".join(words)
                total.append(len(words))
                removed.append(lost)
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string, kept_sha256 string")
