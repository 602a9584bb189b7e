"""Timed text: lines of ``[minutes:seconds]text``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions.text import LINE_BREAK

# Patterns of timed lines, metadata lines and words.
STAMP = r"^\[(\d+):(\d+\.\d+)\](.*)"
META = r"^\[[a-zA-Z]+:.*\]$"
LINES = "array<struct<pos:int,time:double,text:string>>"


def raw_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def parse_lines(text: Column) -> Column:
    """Timed lines in file order, times rounded to centiseconds; lines without a stamp are skipped."""
    stamped = F.filter(raw_lines(text), lambda x: x.rlike(STAMP))
    seconds = lambda x: F.regexp_extract(x, STAMP, 1).cast("double") * 60 + F.regexp_extract(x, STAMP, 2).cast("double")
    return F.transform(stamped, lambda x, i: F.struct(i.cast("int").alias("pos"), F.round(seconds(x), 2).alias("time"), F.trim(F.regexp_extract(x, STAMP, 3)).alias("text"))).cast(LINES)


def format_lines(lines: Column) -> Column:
    """Lines (pos, time, text) by time, equal times in their order, each ended by a line feed."""
    ordered = F.array_sort(F.transform(lines, lambda x: F.struct(x["time"].alias("time"), x["pos"].alias("pos"), x["text"].alias("text"))))
    minutes = lambda x: F.floor(x["time"] / 60).cast("int")
    return F.concat(F.array_join(F.transform(ordered, lambda x: F.format_string("[%02d:%05.2f]%s", minutes(x), x["time"] - minutes(x) * 60, x["text"])), "\n"), F.lit("\n"))


def envelope(text: Column) -> Column:
    """Plain text as timed text: every line at zero, blank lines without a stamp."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), LINE_BREAK)
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) != "", F.concat(F.lit("[00:00.00] "), x)).otherwise("")), "\n")


def lyric_texts(text: Column) -> Column:
    """Texts of the timed lines that have one; of untimed text the lines but blank ones and metadata."""
    timed = F.transform(parse_lines(text), lambda x: x["text"])
    plain = F.filter(raw_lines(text), lambda x: (x != "") & ~x.rlike(META))
    return F.when(F.size(timed) > 0, F.filter(timed, lambda x: x != "")).otherwise(plain)


def manual_markers(text: Column) -> Column:
    """Timed lines without text: they keep their time when the others are retimed."""
    return F.filter(parse_lines(text), lambda x: x["text"] == "")


def strip_parentheticals(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", " ")


TOKEN = r"[\p{L}\p{N}]+'?[\p{L}\p{N}]*"


def tokenize(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), F.lower)


def audit(lines: Column, duration: Column, has_text: Column, least_lines: int = 4, ratio: float = 0.3, early: float = 0.5, bulk_gap: float = 2.0) -> Column:
    """Reasons to distrust the times, in a fixed order; empty if there are none.

    lines: parsed lines. duration: seconds, or null if unknown. has_text: whether the text is not blank.
    """
    times = F.transform(lines, lambda x: x["time"])
    n, distinct, ordered = F.size(times), F.size(F.array_distinct(times)), F.array_sort(times)
    gaps = F.array_sort(F.zip_with(F.slice(ordered, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ordered, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))
    m = F.greatest(n - 1, F.lit(1))
    at = lambda k: F.get(gaps, k.cast("int"))
    median = (at(F.floor((m - 1) / 2)) + at(F.floor(m / 2))) / 2
    back = F.exists(F.zip_with(F.slice(times, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(times, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b < a), lambda x: x)
    identical = (n >= 2) & (distinct == 1)
    reasons = F.array(
        F.when((n == 0) & has_text, "no-timed-lines"),
        F.when(identical, "all-timestamps-identical"),
        F.when(~identical & (n >= least_lines) & (distinct / F.greatest(n, F.lit(1)) < ratio), "low-distinct-timestamps"),
        F.when((duration > 0) & (n >= 2) & (F.array_max(times) < duration * early) & (median <= bulk_gap), "timestamps-crammed-early"),
        F.when(back, "non-monotonic"),
    )
    return F.array_compact(reasons)
