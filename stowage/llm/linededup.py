"""Line dedup by range-partitioned line hashes: a sorted stream finds first occurrences, documents get keep bitmaps.

Each document sends one row per distinct line key: 128 bits of hash, the document's key and the line's positions.
Rows are range-partitioned by hash, document and position, and sorted within partitions. A partition streams through
its keys holding at most ``min_docs`` rows. As ranges cut by document too, a key of any weight spreads over as many
partitions as it fills; only the first and last key of a partition can go on elsewhere, and their rows are settled
from at most two counts a partition. No text is shuffled but to apply the bitmaps.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, document_key, same_document, shuffle_partitions, slices, starts

BLANK = b" \t\n\x0b\x0c\r"


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, _key_id, _key_text, n_lines, at): a row for each document and distinct key of ``min_chars`` code points.

    A key is the line without white space at its ends, A-Z lower-cased; ``at`` holds its lines as 32-bit integers.
    """
    import numpy as np
    import pyarrow as pa
    import xxhash

    rows = docs.select(*document_key(docs, id_col, text_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    names = ["h1", "h2", "_key_id", "_key_text", "n_lines", "at"]

    def run(batches):
        starts("linededup")
        for batch in slices(batches):
            h1, h2, row, count, at = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                lines, where = (text or b"").split(b"\n"), {}
                for k, line in enumerate(lines):
                    key = line.strip(BLANK).lower()
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode(errors="replace")) >= min_chars):
                        where.setdefault(key, []).append(k)
                for key, found in where.items():
                    digest = xxhash.xxh3_128_digest(key)
                    h1.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    at.append(np.array(found, "<u4").tobytes())
                row += [i] * len(where)
                count += [len(lines)] * len(where)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column("_key_id").take(take), batch.column("_key_text").take(take), pa.array(count, pa.int32()), pa.array(at, pa.binary())], names)

    return rows.mapInArrow(run, f"h1 long, h2 long, _key_id {rows.schema['_key_id'].dataType.simpleString()}, _key_text long, n_lines int, at binary")


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(_key_id, _key_text, n_lines, n_dropped, keep) of the documents that lose lines; all others keep every line.

    Lines whose key is found in ``min_docs`` documents or more are dropped; with ``keep_first`` the first line of the
    first document (by id, nulls first) stays. ``keep`` is a zlib-compressed bitmap, a bit a line, lowest bit first.
    Rows equal in id and text are one document. Null text is one empty line, and an empty key is never dropped.
    """
    import numpy as np
    import pyarrow as pa

    order = ["h1", "h2", "_key_id", "_key_text"]
    keys = line_keys(docs, id_col, text_col, min_chars)
    dealt = keys.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    id_type = keys.schema["_key_id"].dataType.simpleString()
    # kind 0: drop; 1: settle, as place n of its key in this partition; 2: the key's n documents in this partition.
    schema = f"kind int, part int, n long, h1 long, h2 long, _key_id {id_type}, _key_text long, n_lines int, at binary"

    def run(batches):
        from pyspark import TaskContext

        part, key, n, first_run, last, held = TaskContext.get().partitionId(), None, 0, True, None, []
        template = None

        def flush(out):
            kinds, places, rows = zip(*out) if out else ((), (), ())
            column = lambda i, kind: pa.array([r[i] for r in rows], kind)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array(places, pa.int64()), column(0, pa.int64()), column(1, pa.int64()), column(2, template), column(3, pa.int64()), column(4, pa.int32()), column(5, pa.binary())], ["kind", "part", "n", "h1", "h2", "_key_id", "_key_text", "n_lines", "at"])

        for batch in slices(batches, 4096):
            template, out = batch.column("_key_id").type, []
            for row in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "_key_id", "_key_text", "n_lines", "at"))):
                if row[:2] != key:
                    if key is not None and first_run:
                        out.append((2, n, (*key, None, None, None, None)))
                        first_run = False
                    key, n, held, last = row[:2], 0, [], None
                if row[2:4] == last:
                    continue
                last, n = row[2:4], n + 1
                if first_run:
                    out.append((1, n - 1, row))
                elif n < min_docs:
                    held.append(row)
                else:
                    out += [(3 if keep_first and i == 0 else 0, i, r) for i, r in enumerate(held)]
                    out.append((3 if keep_first and n == 1 else 0, n - 1, row))
                    held = []
            if out:
                yield flush(out)
        if key is not None:
            out = [(2, n, (*key, None, None, None, None))]
            out += [(1, i, r) for i, r in enumerate(held)]  # the last key may go on in the next partition
            yield flush(out)

    streamed = cut(dealt.mapInArrow(run, schema))
    # At most two rows a partition, so no larger than the plan itself.
    ends = F.broadcast(streamed.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("start")))
    own = [c for c in streamed.columns if c not in ("kind", "part", "n", "h1", "h2")]
    settled = streamed.where("kind = 1").join(ends, ["h1", "h2"]).where(F.col("total") >= min_docs)
    first = (F.col("part") == F.col("start")) & (F.col("n") == 0) if keep_first else F.lit(False)
    drops = streamed.where("kind in (0, 3)").select((F.col("kind") == 3).alias("first"), *own).unionByName(settled.select(first.alias("first"), *own))

    def bitmaps(batches):
        for batch in slices(batches):
            dropped, keep = [], []
            for n, lists in zip(batch.column("n_lines").to_pylist(), batch.column("lists").to_pylist()):
                bits = np.ones(n, np.uint8)
                for x in lists:
                    bits[np.frombuffer(x["at"], "<u4")[1 if x["first"] else 0 :]] = 0
                dropped.append(int(n - bits.sum()))
                keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("_key_id"), batch.column("_key_text"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(keep, pa.binary())], ["_key_id", "_key_text", "n_lines", "n_dropped", "keep"])

    grouped = drops.groupBy("_key_id", "_key_text", "n_lines").agg(F.collect_list(F.struct("first", "at")).alias("lists"))
    return grouped.mapInArrow(bitmaps, f"_key_id {id_type}, _key_text long, n_lines int, n_dropped int, keep binary").where("n_dropped > 0")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text that a bitmap leaves (None: all of it), the lines it had and those it lost."""
    import numpy as np

    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
    left = [line for line, bit in zip(lines, bits) if bit]
    return "\n".join(left), len(lines), len(lines) - len(left)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, keep): each row of ``docs`` as a struct, its text, and its document's bitmap or null."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).cast("string").alias("text"), *document_key(docs, id_col, text_col))
    found = bitmaps.select("_key_id", "_key_text", "keep")
    return rows.join(found, same_document(rows, found), "left").select("row", "text", "keep")


def digest_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document."""
    import hashlib

    import pyarrow as pa

    rows = with_bitmaps(docs.select("doc_id", "text"), bitmaps).select("row.doc_id", "text", "keep")

    def run(batches):
        for batch in slices(batches):
            total, dropped, digest = [], [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
                left, n, lost = kept_lines(text, keep)
                total.append(n)
                dropped.append(lost)
                digest.append(hashlib.sha256(left.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that the bitmaps leave; every row and every other column stays, a null text stays null."""
    import pyarrow as pa

    rows = with_bitmaps(docs, bitmaps, text_col=text_col)

    def run(batches):
        for batch in slices(batches):
            left = [text if keep is None else kept_lines(text, keep)[0] for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(left, pa.string())], ["row", "text"])

    rows = rows.mapInArrow(run, rows.select("row", "text").schema)
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
