"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components.

Two fingerprints that differ in at most ``max_bits`` bits agree on all but ``max_bits`` of the ``blocks`` blocks, so on
some choice of the others. Each fingerprint is dealt out under the bits of every such choice (20 choices of about 32
bits for 6 blocks and 3 bits); pairs meet on equal bits and are verified. Only distinct fingerprints take part, so
copies, however many, are one. A crowded bucket is split into chunks, each pair of chunks is a group of bounded size,
and such a group returns a spanning forest instead of its pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import cut, shuffle_partitions, slices, starts

CROWDED = 128  # a bucket up to this size is joined with itself
CHUNK = 512  # fingerprints of a crowded bucket in a chunk
ROWS = 128  # of a group that are compared with all of it at a time


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash, as a signed integer, of a UTF-8 text's lower-cased word shingles; 0 if it has no words."""
    import numpy as np
    import xxhash

    tokens = (text or b"").lower().split()  # ASCII case and white space only, as bytes
    if not tokens:
        return 0
    joined, at, starts = b" ".join(tokens), 0, []
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    n = len(tokens) - words + 1
    hash_of = xxhash.xxh64_intdigest
    if n < 2:
        hashes = [hash_of(joined, 42)]
    else:
        starts.append(at)
        hashes = [hash_of(joined[a : b - 1], 42) for a, b in zip(starts, starts[words:])]
    counts, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        h = np.array(hashes[i : i + step], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): a row for each row of ``docs``. Null and empty texts, and texts without words, have fingerprint 0."""
    import pyarrow as pa

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))

    def run(batches):
        starts("simhash")
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], pa.int64())], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Masks, as signed integers, that keep every choice of ``blocks - max_bits`` blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    whole = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def near_links(fps: DataFrame, max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b): links among the distinct values of ``fps.fp`` that connect whatever pairs within ``max_bits`` connect."""
    import numpy as np
    import pyarrow as pa

    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(max_bits, blocks)])).alias("choice", "bits"))
    shared = keys.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keys.join(shared, ["choice", "bits"]))
    few = met.where(F.col("n") <= CROWDED)
    a, b = few.select("choice", "bits", F.col("fp").alias("a")), few.select("choice", "bits", F.col("fp").alias("b"))
    pairs = a.join(b, (a["choice"] == b["choice"]) & (a["bits"] == b["bits"]) & (a["a"] < b["b"]) & (F.bit_count(a["a"].bitwiseXOR(b["b"])) <= max_bits)).select("a", "b")

    def forest(group: pa.Table) -> pa.Table:
        f = np.unique(group.column("fp").to_numpy())
        label = np.arange(len(f))
        while True:  # each takes the lowest label among those near it, a block of rows at a time
            lower = np.empty_like(label)
            for at in range(0, len(f), ROWS):
                near = np.bitwise_count(f[at : at + ROWS, None] ^ f[None, :]) <= max_bits
                lower[at : at + ROWS] = np.where(near, label[None, :], len(f)).min(1)
            if (lower == label).all():
                break
            label = lower
        linked = label != np.arange(len(f))
        return pa.table({"a": f[label[linked]], "b": f[linked]})

    many = met.where(F.col("n") > CROWDED).withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "chunks"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    crowded = many.groupBy("choice", "bits", "lo", "hi").applyInArrow(forest, "a long, b long")
    return pairs.unionByName(crowded).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is a component's smallest node.

    Large-star and small-star steps alternate until the edges no longer change: each hangs neighbours on the smallest
    one, by grouped minima and joins alone, so no component is gathered in one place. Each round is checkpointed.
    """
    edges, before = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of each row: its fingerprint, its component's root fingerprint,
    and the smallest id that links reach from it.

    Ids that are null never name a component; one of null ids only has a null component_id. Rows that repeat stay.
    """
    rows = cut(fingerprints(docs, words, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # A fingerprint is few bytes, but each is dealt out under many keys: partitions must not be coalesced by their bytes.
    distinct = distinct.repartition(shuffle_partitions(docs.sparkSession), F.xxhash64("fp"))
    roots = components(near_links(distinct, max_bits, blocks))
    joined = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("component")))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(named, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (nulls last); of its repeats one stays."""
    found = near_duplicates(docs, words, max_bits, blocks, id_col, text_col)
    # Both sides are keyed without nulls, so that the join and the window share one exchange of the rows.
    key = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s"))
    stays = best.select(key(F.col("s.doc_id")).alias("_id"), F.col("s.text_hash").alias("_text"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), key(F.col(id_col)).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_text"))
    kept = rows.join(stays, ["_id", "_text"], "left_semi")
    one = kept.withColumn("_place", F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(0)))).where("_place = 1")
    return one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
