"""Set-similarity joins: pairs of texts meet only on their rarest elements.

Elements get one global order, rarest first. Two sets that share at least ``need`` elements share ``l`` of the first
``size - need + l`` of each, so it is enough that sets meet on combinations of ``l`` elements of those prefixes; a pair
that meets on several is kept at the first. Words bring together sets of similar words. Letters, each numbered among its
equals, bring together texts that may have enough characters in common blocks for a sequence ratio, a bound that is then
taken over all letters and over pairs of neighbours before any ratio is.

Any total order gives the same pairs, so counts only decide how many candidates there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
LETTERS_TO = 96  # letters of both texts up to which they meet by letters; longer ones meet by pieces


def numbered(parts: Column) -> Column:
    """A multiset as a set of 64-bit hashes: each element with its number among its equals. Should two have one hash, the
    sets share more, which loses no pair."""
    ordered = F.array_sort(parts)
    return F.array_distinct(F.transform(ordered, lambda c, i: F.xxhash64(c, i - F.array_position(ordered, c))))


def letters(text: Column) -> Column:
    return numbered(F.filter(F.split(text, ""), lambda c: c != ""))


def neighbours(text: Column) -> Column:
    """The numbered pairs of characters side by side."""
    n = F.char_length(text)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(numbered(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))))


def rarest_first(sets: DataFrame, others: DataFrame, elements: str) -> DataFrame:
    """``sets`` with ``elements`` in the order of how many rows of both tables have them, then by themselves.

    The counts are met in salted parts, as some elements are in most rows.
    """
    each = lambda rows: rows.select(F.explode(elements).alias("_e"))
    counts = each(sets).unionByName(each(others)).groupBy("_e").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = sets.select("text", F.explode(elements).alias("_e")).withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    ordered = spread.join(counts, ["_e", "_salt"]).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("_n", "_e"))).alias("_o"))
    return ordered.select("text", F.transform("_o", lambda x: x["_e"]).alias(elements))


def combinations(prefix: str, l: int) -> Column:
    """All combinations of ``l`` elements in their order, 1 or 3: the element itself, or the hash of the three."""
    if l == 1:
        return F.col(prefix)
    some = f"flatten(flatten(transform(sequence(0, size({prefix}) - 3), i -> transform(sequence(i + 1, size({prefix}) - 2), j -> transform(sequence(j + 1, size({prefix}) - 1), k -> xxhash64(array({prefix}[i], {prefix}[j], {prefix}[k])))))))"
    return F.when(F.size(prefix) >= 3, F.expr(some)).otherwise(F.array().cast("array<bigint>"))


def meeting(left: DataFrame, right: DataFrame, elements: str, missing: Callable[[Column], Column], l: int, fits: Column, carried: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, n_a, n_b and carried columns with _a and _b) of pairs that may share enough elements; each pair once.

    ``missing``: how many elements of a set of a size may be absent from the other at most. ``fits``: a condition on the
    sizes n_a and n_b, which is asked first.
    """

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        n = F.size(elements)
        cutoff = rows.withColumn("_p", F.slice(elements, F.lit(1), F.greatest(F.least(n, missing(n) + l), F.lit(1))))
        return cutoff.select(F.col("text").alias(side), n.alias(f"n_{side}"), F.col("_p").alias(f"_p_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in carried], F.explode(combinations("_p", l)).alias("_key"))

    met = keyed(left, "a").join(keyed(right, "b"), "_key")
    shared = F.array_intersect("_p_a", "_p_b")
    first = F.get(shared, F.lit(0)) if l == 1 else F.xxhash64(F.slice(shared, 1, 3))
    return met.where(fits & (first == F.col("_key"))).drop("_key", "_p_a", "_p_b")


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.select("text").where("text <> ''").distinct()


def similar_words(left: DataFrame, right: DataFrame, least: float, words: Callable[[Column], Column]) -> DataFrame:
    """(a, b): distinct texts (column ``text``) of both sides whose word sets have at least this Jaccard index."""
    sets = lambda rows: _distinct(rows).withColumn("words", words(F.col("text"))).where(F.size("words") > 0)
    x, y = sets(left), sets(right)
    near = F.least("n_a", "n_b") + 1e-9 >= least * F.greatest("n_a", "n_b")
    met = meeting(rarest_first(x, y, "words"), rarest_first(y, x, "words"), "words", lambda n: n - F.ceil(n * least - 1e-9).cast("int"), 1, near, ("words",))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    return met.where(shared / (F.col("n_a") + F.col("n_b") - shared) >= least).select("a", "b")


def _by_letters(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """Candidates of up to ``LETTERS_TO`` letters in both texts together."""

    def sets(rows: DataFrame) -> DataFrame:
        return rows.where(F.char_length("text") <= int(LETTERS_TO / (1 + least / (2 - least))) + 1).withColumn("bag", letters(F.col("text")))

    left, right = sets(x), sets(y)
    # A partner has at least least / (2 - least) of the length, and all of it may be shared.
    missing = lambda n: n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int")
    few = int(2 * 3 / least) + 1  # letters in both from which at least three are shared
    total, out = F.col("n_a") + F.col("n_b"), None
    near = 2 * F.least("n_a", "n_b") + 1e-9 >= least * total
    for l, fits in ((1, total < few), (3, (total >= few) & (total <= LETTERS_TO))):
        u, v = (rows.where(F.char_length("text") < few) if l == 1 else rows for rows in (left, right))
        met = meeting(rarest_first(u, v, "bag"), rarest_first(v, u, "bag"), "bag", missing, l, near & fits, ("bag",))
        out = met if out is None else out.unionByName(met)
    return out.where(2 * F.size(F.array_intersect("bag_a", "bag_b")) + 1e-9 >= least * total).select("a", "b")


def _by_pieces(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """Candidates of more letters: of two texts with T letters at most (1 - r) T are foreign to the other, and T is at
    most 2 / r of either's length, so one text cut into more than 2 (1 - r) / r of its length pieces has one that is
    whole in the other, moved by no more letters than that. Pieces have four letters at most."""
    longer = lambda rows: rows.where(F.char_length("text") > int(LETTERS_TO / (1 + (2 - least) / least)) - 1)
    a, b = longer(x).select(F.col("text").alias("a")), longer(y).select(F.col("text").alias("b"))
    size, foreign = F.char_length("a"), 2 * (1 - least) / least
    n = (F.floor(size * foreign) + 1).cast("int")
    start = lambda i: F.floor(i * size / n).cast("int")
    cuts = a.select("a", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(start(i).alias("at"), F.substring(F.col("a"), start(i) + 1, start(i + 1) - start(i)).alias("piece")))).alias("p")).select("a", F.col("p.at").alias("a_at"), F.col("p.piece").alias("piece"))
    most = int(1 / foreign) + 1
    spots = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda m: F.transform(F.sequence(F.lit(0), F.char_length("b") - m), lambda i: F.struct(i.alias("at"), F.substring(F.col("b"), i + 1, m).alias("piece")))))
    grams = b.select("b", F.explode(spots).alias("p")).select("b", F.col("p.at").alias("b_at"), F.col("p.piece").alias("piece"))
    total = F.char_length("a") + F.char_length("b")
    near = (total > LETTERS_TO) & (F.least(F.char_length("a"), F.char_length("b")) * 2 / total >= least) & (F.abs(F.col("a_at") - F.col("b_at")) <= (1 - least) * total)
    return cuts.join(grams, "piece").where(near).select("a", "b").distinct()


def ratio_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): distinct texts (column ``text``) of both sides that can reach a sequence ratio of ``least``, from 0.5 on.

    The ratio is twice the characters in common blocks over all, and these are a common subsequence. So the shared
    letters bound it; and with d foreign characters in all, at most d of the first text's neighbours are torn by what is
    left out of it, twice each, and by what comes between.
    """
    x, y = _distinct(left), _distinct(right)
    met = _by_letters(x, y, least).unionByName(_by_pieces(x, y, least))
    na, nb = F.char_length("a"), F.char_length("b")
    foreign = F.floor((1 - least) * (na + nb) + 1e-9)
    out, into = F.floor((foreign + na - nb) / 2), F.floor((foreign - na + nb) / 2)
    torn = F.size(F.array_intersect("near_a", "near_b")) >= na - 1 - 2 * out - into
    side = lambda rows, name: rows.select(F.col("text").alias(name), neighbours(F.col("text")).alias(f"near_{name}"))
    return met.join(side(x, "a"), "a").join(side(y, "b"), "b").where(torn).select("a", "b")
