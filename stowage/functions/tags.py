"""Tag maps (key to list of values) as Column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.text import date_year, repair_album, split_feat

# Keys that rippers and taggers write beside the canonical ones.
RIPPER_KEYS = ("year", "track", "trackc", "discc", "totaldiscs", "totaltracks")
ALIAS_KEYS = ("year", "track", "trackc", "discc")
TAGS = "map<string,array<string>>"


def first(tags: Column, *keys: str) -> Column:
    """The first value of the first key that has one; keys are also looked for in upper case."""
    return F.coalesce(*[F.nullif(F.get(F.element_at(tags, k), F.lit(0)), F.lit("")) for key in keys for k in dict.fromkeys((key, key.upper()))])


def standard(tags: Column) -> Column:
    """struct of the fields a catalog needs, each from its first source that has it."""
    number = lambda *keys: F.split(first(tags, *keys), "/")[0].try_cast("int")
    return F.struct(
        first(tags, "artist", "albumartist", "TPE1").alias("artist"), first(tags, "albumartist", "artist").alias("albumartist"), first(tags, "album", "TALB").alias("album"),
        first(tags, "title", "TIT2").alias("title"), number("discnumber").alias("disc_no"), number("tracknumber").alias("track_no"), first(tags, "musicbrainz_albumid").alias("ext_id"),
        F.coalesce(first(tags, "artistsort", "TSOP"), F.lit("")).alias("artist_sort"), F.coalesce(first(tags, "title_english"), F.lit("")).alias("title_english"),
        first(tags, "lyrics", "unsyncedlyrics", "USLT", "USLT::").alias("lyrics"),
    )


def disc(tags: Column) -> Column:
    """struct(disc_no, disc_total), 1 and 1 where tags are absent or no numbers."""
    total, number = F.coalesce(first(tags, "disctotal"), first(tags, "totaldiscs")), F.coalesce(first(tags, "discnumber"), first(tags, "disc"))
    named = total.isNotNull() | number.isNotNull()
    n, t = F.trim(F.coalesce(number, F.lit("1"))).try_cast("int"), F.trim(F.coalesce(total, F.lit("1"))).try_cast("int")
    sound = n.isNotNull() & t.isNotNull()
    parts = F.split(first(tags, "TPOS"), "/")
    part = lambda i: F.coalesce(F.when(F.trim(F.get(parts, F.lit(i))).rlike(r"^\d+$"), F.trim(F.get(parts, F.lit(i))).cast("int")), F.lit(1))
    return F.struct(F.when(named, F.when(sound, n).otherwise(1)).otherwise(part(0)).alias("disc_no"), F.when(named, F.when(sound, t).otherwise(1)).otherwise(part(1)).alias("disc_total"))


def without(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(tags, lambda k, _: ~F.lower(k).isin(*keys))


def with_value(tags: Column, key: str, value: Column) -> Column:
    """The map with one value under a key; null leaves it as it is."""
    one = F.map_from_arrays(F.array(F.lit(key)), F.array(F.array(value)))
    return F.when(value.isNull(), tags).otherwise(F.map_concat(F.map_filter(tags, lambda k, _: k != key), one))


def clean_before(rows: DataFrame, tags: str = "tags", directory: str = "directory") -> DataFrame:
    """Rows with tags cleaned before import, and ``changed``: ripper keys dropped, names and guest credits repaired."""
    t = F.col(tags)
    kept = without(t, RIPPER_KEYS)
    fixed = repair_album(first(t, "album"), first(t, "comment"), F.col(directory))
    credits = split_feat(first(t, "artist"), first(t, "albumartist"), first(t, "title"))
    out = with_value(kept, "album", fixed)
    for field in ("artist", "albumartist", "title"):
        out = with_value(out, field, credits[field])
    return _changed(rows, tags, out)


def clean_after(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """Rows with tags cleaned after import, and ``changed``: alias keys dropped, the date cut to its year."""
    t = F.col(tags)
    return _changed(rows, tags, with_value(without(t, ALIAS_KEYS), "date", date_year(first(t, "date"))))


def _changed(rows: DataFrame, tags: str, out: Column) -> DataFrame:
    entries = lambda m: F.array_sort(F.map_entries(m))
    return rows.withColumn("_out", out).withColumn("changed", entries(F.col("_out")) != entries(F.col(tags))).withColumn(tags, F.col("_out")).drop("_out")
