"""Divergence of sources within a language, by a vocabulary automaton of two passes.

The first pass counts exactly in how many documents of its language each term is. The terms kept become an automaton
whose entries are padded with delimiters, and the second pass counts their occurrences with it, by language and source.
The counts are sparse postings of (language, source, term). Smoothed shares need no dense table: a source without a
term has its one share for absent terms, so the distance of two sources is what they would differ by without any term,
plus corrections for terms that one of them has, plus corrections for terms that both have.

The vocabulary never passes through the driver: it is written to the shared folder in shards of bounded size, workers
read one shard at a time, and each block of texts meets all shards, so texts are read once however many there are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Sequence
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import cut, remove, small_batches, slices, starts, worker_state
from stowage.scratch import new_folder

SCALE = 1_000_000_000
SMOOTHING = 5
SHARD_CHARS = 1 << 21  # of terms in one automaton: about 200 MB at worst
BLOCK_CHARS = 1 << 23  # of texts that meet the shards in turn
HELD = 200_000  # terms that a task counts before it hands them on
PARTS = 32  # of a language, when its sources meet each other
LONG = 64  # characters; longer terms stand in the automaton by their digest
PIECE = 1 << 20  # characters of a text that are split at a time
MARK = "\x01"  # begins the stand-in of a long term; no term has it

_DELIMITERS = bytes(b for b in range(0x80) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_AS_BLANKS = bytes.maketrans(_DELIMITERS + bytes(range(0x41, 0x5B)), b" " * len(_DELIMITERS) + bytes(range(0x61, 0x7B)))
_LONG_RUN = re.compile(f"[^ ]{{{LONG + 1},}}")


def plain(text: str) -> str:
    """The text with A-Z in lower case and every delimiter, all of them ASCII, as a blank."""
    return text.encode().translate(_AS_BLANKS).decode()


def stand_in(term: str) -> str:
    return term if len(term) <= LONG else MARK + hashlib.sha256(term.encode()).hexdigest()


def _pieces(text: str):
    """A plain text in pieces, cut at blanks."""
    at = 0
    while len(text) - at > PIECE:
        end = text.find(" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text"))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(lang, term, docs) over all documents; each row of the input is one."""
    import pyarrow as pa

    def run(batches):
        starts("divergence")
        held: dict[str, Counter] = {}
        size = 0

        def flushed():
            rows = [(lang, term, n) for lang, counts in held.items() for term, n in counts.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "term", "n"])

        for batch in slices(batches, 256):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                terms: set[str] = set()
                for piece in _pieces(plain(text)):
                    terms.update(piece.split(" "))
                terms.discard("")
                counts = held.setdefault(lang, Counter())
                size -= len(counts)
                counts.update(terms)
                size += len(counts)
                if size > HELD:
                    yield flushed()
                    size = 0
        if size:
            yield flushed()

    return texts.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("docs"))


def automata(rows) -> dict:
    """By language, an automaton of its terms, each between two blanks; ``rows`` are (lang, key)."""
    import ahocorasick

    found = {}
    for lang, key in rows:
        found.setdefault(lang, ahocorasick.Automaton()).add_word(f" {key} ", key)
    for a in found.values():
        a.make_automaton()
    return found


def occurrences(texts: DataFrame, folder: str, shards: Sequence[int], block: int = BLOCK_CHARS) -> DataFrame:
    """(lang, source, key, n): how often the terms stored in ``folder`` occur, for those that do."""
    import pyarrow as pa

    def shard(k):
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        def read():
            store, path = pafs.FileSystem.from_uri(folder)
            table = ds.dataset(f"{path}/shard={k}", filesystem=store, format="parquet").to_table(columns=["lang", "key"])
            return automata(zip(table.column("lang").to_pylist(), table.column("key").to_pylist()))

        return worker_state("divergence", "automata", (folder, k), read)

    def run(batches):
        counts: dict[tuple[str, str], Counter] = {}
        waiting, chars, size = [], 0, 0

        def flushed():
            rows = [(lang, source, key, n) for (lang, source), found in counts.items() for key, n in found.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "key", "n"])

        def scan():
            nonlocal size
            for k in shards:
                by_lang = shard(k)
                for lang, source, text in waiting:
                    if (automaton := by_lang.get(lang)) is not None:
                        found = counts.setdefault((lang, source), Counter())
                        size -= len(found)
                        found.update(map(itemgetter(1), automaton.iter(text)))
                        size += len(found)
                        if size > HELD:
                            yield flushed()
                            size = 0
            waiting.clear()

        for batch in slices(batches, 256):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                waiting.append((lang, source, f" {_LONG_RUN.sub(lambda m: stand_in(m[0]), plain(text))} "))
                chars += len(text)
                if chars > block:
                    yield from scan()
                    chars = 0
        yield from scan()
        if size:
            yield flushed()

    return texts.mapInArrow(run, "lang string, source string, key string, n long").groupBy("lang", "source", "key").agg(F.sum("n").alias("n"))


def share(count: str, whole: str, terms: str) -> F.Column:
    """The smoothed share of a count in billionths, rounded down, plus one; whole numbers of up to 38 digits."""
    d = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * ({d(count)} + {SMOOTHING})) div ({d(whole)} + {SMOOTHING} * {d(terms)})")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    Part ``pair``: every other source of the language, by the sum of absolute differences of shares over all kept
    terms. Part ``term``: the ``top`` terms whose share in the source is most above that in the language. Terms are runs
    of letters and of anything beyond ASCII; a language keeps those in at least ``min_docs`` of its documents.

    Null text, language and source count as ''. Every row is a document, repeated ones too. A language without kept
    terms gives pairs of value 0 and no terms; a source alone in its language has no pairs. Ties go by the item's UTF-8.
    An empty table gives no rows. A term of any length counts; its length is only held by the table of kept terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, text_col, lang_col, source_col)
    stood = F.when(F.char_length("term") <= LONG, F.col("term")).otherwise(F.concat(F.lit(MARK), F.sha2("term", 256)))
    kept = cut(document_frequencies(texts).where(F.col("docs") >= min_docs).select("lang", stood.alias("key"), "term"))
    chars = kept.agg(F.sum(F.char_length("key") + 2)).first()[0] or 0
    shards = -(-chars // shard_chars)
    folder = new_folder(spark, "vocabulary")
    if shards:
        dealt = kept.select("lang", "key", F.pmod(F.xxhash64("lang", "key"), F.lit(shards)).cast("int").alias("shard"))
        dealt.repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
        postings = cut(occurrences(texts, folder, [r["shard"] for r in dealt.select("shard").distinct().collect()]))
        remove(spark, folder)
    else:
        postings = spark.createDataFrame([], "lang string, source string, key string, n long")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    in_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = texts.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = cut(groups.withColumn("absent", F.when(F.col("terms") > 0, share("0", "whole", "terms")).otherwise(0)))
    shares = postings.join(groups, ["lang", "source"]).select("lang", "source", "key", "absent", share("n", "whole", "terms").alias("p"))

    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    # Sources meet all others of their language by its parts, as one language may have most of them.
    part = F.pmod(F.xxhash64("a", "a0"), F.lit(PARTS)).cast("int").alias("part")
    left = groups.select("lang", F.col("source").alias("a"), F.col("absent").alias("a0"), "terms").withColumn("part", part)
    right = groups.select("lang", F.col("source").alias("b"), F.col("absent").alias("b0"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    without = left.join(right, ["lang", "part"]).where("a <> b").select("lang", "a", "b", (F.col("terms") * apart("a0", "b0")).alias("f"))
    # Terms of one side, by their shares: few distinct ones, as counts repeat.
    levels = shares.groupBy("lang", F.col("source").alias("a"), F.col("absent").alias("a0"), "p").agg(F.count("*").alias("m")).withColumn("part", F.pmod(F.xxhash64("a", "p"), F.lit(PARTS)).cast("int"))
    one = levels.join(right, ["lang", "part"]).where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (apart("p", "b0") - apart("a0", "b0"))).alias("f"))
    x = shares.select("lang", "key", F.col("source").alias("a"), F.col("absent").alias("a0"), F.col("p").alias("pa"))
    y = shares.select("lang", "key", F.col("source").alias("b"), F.col("absent").alias("b0"), F.col("p").alias("pb"))
    met = x.join(y, ["lang", "key"]).where("a < b")
    both = met.groupBy("lang", "a", "b").agg(F.sum(apart("pa", "pb") - apart("pa", "b0") - apart("a0", "pb") + apart("a0", "b0")).alias("f"))
    turned = lambda rows: rows.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f")
    parts = without.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    pairs = parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("f").alias("value"))

    in_lang = postings.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    wholes = in_lang.groupBy("lang").agg(F.sum("n").alias("whole"), F.count("*").alias("terms"))
    usual = in_lang.join(wholes, "lang").select("lang", "key", share("n", "whole", "terms").alias("q"))
    above = shares.join(usual, ["lang", "key"]).where("p > q").join(kept.where("term <> key"), ["lang", "key"], "left")
    terms = above.select("lang", "source", F.coalesce("term", "key").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
