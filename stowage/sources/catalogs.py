"""Catalog sources and sinks: album listings, stored albums, hand-written and cached collections, the ignore list."""

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.keys import item_key
from stowage.functions.releases import RELEASE, to_items
from stowage.functions.text import year
from stowage.operators.relational import KNOWN_MEDIA

SEPARATOR = "\x1f"


def parse_listing(lines: DataFrame, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """Albums of lines of four fields (artist, album, year, external id); short lines and empty albums are dropped."""
    f = F.split(F.col(value), SEPARATOR)
    field = lambda i: F.trim(F.get(f, F.lit(i)))
    return lines.where(F.size(f) >= 4).select(F.col(ordinal).alias("ordinal"), field(0).alias("albumartist"), field(1).alias("album"), year(field(2)).alias("year"), F.nullif(field(3), F.lit("")).alias("ext_id")).where("album <> ''")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    return parse_listing(rows.withColumn("ordinal", F.monotonically_increasing_id()))


def stored_albums(spark: SparkSession, path: str) -> DataFrame:
    """Albums of a stored table; a table that is not there is an error, titles that are empty are dropped."""
    return spark.read.parquet(path).where("coalesce(album, '') <> ''")


def foreign_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, item_id) of a foreign catalog's export; empty where it cannot be read. ``sqlite.foreign_items`` reads the
    catalog itself."""
    try:
        return spark.read.parquet(path).select("path", F.col("id").alias("item_id"))
    except AnalysisException as e:  # a missing or foreign file means that nothing is known
        if (e.getCondition() or "").split(".")[0] not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN"):
            raise
        return spark.createDataFrame([], "path binary, item_id long")


HAND_WRITTEN = "id string, artist string, title string, media string, year string, catno string, artist_alts string, title_alts string, mb_release_id string, url string, thumb_url string"


def hand_written(spark: SparkSession, text: DataFrame, source: str = "fixture") -> DataFrame:
    """Items of a JSON text (one row, column ``value``): a list, or an object with ``items``.

    The id defaults to the place in the list, the medium to cd; media that are not known are other. One text or a list
    of them is allowed for media and alternates. A year that is no number is an error.
    """
    element = f"array<struct<{HAND_WRITTEN.replace(' string', ':string')}>>"
    bare = F.from_json("value", element)
    held = F.from_json("value", f"struct<items:{element}>")["items"]
    starts = F.startswith(F.ltrim("value"), F.lit("["))
    checked = F.when(F.when(starts, bare).otherwise(held).isNull(), F.raise_error(F.lit("a collection must be a list of items or an object with items"))).otherwise(F.when(starts, bare).otherwise(held))
    rows = text.select(F.posexplode(checked).alias("ordinal", "r")).select("ordinal", "r.*")

    def many(c: str):
        listed = F.from_json(c, "array<string>")
        return F.filter(F.when(F.startswith(c, F.lit("[")), listed).when(F.trim(c) != "", F.array(c)).otherwise(F.array().cast("array<string>")), lambda v: F.trim(v) != "")

    kinds = F.array_distinct(F.transform(many("media"), lambda m: F.when(F.lower(F.trim(m)).isin(*KNOWN_MEDIA), F.lower(F.trim(m))).otherwise("other")))
    number = F.when(F.coalesce(F.trim("year"), F.lit("")) == "", F.lit(None)).when(F.trim("year").rlike(r"^[+-]?\d+$"), F.trim("year").cast("int")).otherwise(F.raise_error(F.concat(F.lit("invalid year "), F.col("year"))).cast("int"))
    title, key = F.trim(F.coalesce("title", F.lit(""))), F.coalesce("id", F.col("ordinal").cast("string"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    none = F.array().cast("array<string>")
    return rows.where(title != "").select(
        F.lit(source).alias("source"), key.alias("source_id"), item_key(F.lit(source), key).alias("item_key"), "ordinal", F.trim(F.coalesce("artist", F.lit(""))).alias("artist"), title.alias("title"),
        F.when(F.col("media").isNull(), F.array(F.lit("cd"))).otherwise(kinds).alias("media"), F.nullif(number, F.lit(0)).alias("year"), blank("catno").alias("catno"),
        F.when(F.col("artist_alts").isNull(), none).otherwise(many("artist_alts")).alias("artist_alts"), F.when(F.col("title_alts").isNull(), none).otherwise(many("title_alts")).alias("title_alts"),
        blank("mb_release_id").alias("ext_id"), blank("url").alias("url"), blank("thumb_url").alias("thumb_url"),
    )


def read_hand_written(spark: SparkSession, path: str) -> DataFrame:
    return hand_written(spark, spark.read.option("wholetext", True).text(path))


def cached_releases(spark: SparkSession, path: str, now: float, ttl_hours: float, cached_only: bool = False) -> DataFrame | None:
    """Releases of a cache file ``{fetched_utc, releases}``; None if it is missing, corrupt or too old.

    ``cached_only`` takes it at any age.
    """
    text = _texts(spark, path)
    if text is None:
        return None
    element = RELEASE.replace("id long", "id:long", 1).replace(", instance_id long", ",instance_id:long").replace(", date_added string", ",date_added:string").replace(", basic_information struct", ",basic_information:struct")
    held = text.select(F.from_json("value", f"struct<fetched_utc:double,releases:array<struct<{element}>>>").alias("c"))
    fresh = F.lit(cached_only) | (F.lit(now) - F.col("c.fetched_utc") <= ttl_hours * 3600)
    kept = held.where(F.col("c.releases").isNotNull() & fresh)
    return None if kept.isEmpty() else kept.select(F.posexplode("c.releases").alias("ordinal", "r")).select("ordinal", "r.*")


def fetch_pages(fetch: Callable[[int], dict], per_page: int = 100, retries: int = 3, pause: Callable[[float], None] = lambda _: None, requests_per_minute: int = 25) -> list[dict]:
    """All releases of a paged service; ``fetch(page)`` returns a page, or ``{"retry_after": seconds}`` when refused.

    A page that is refused is asked for again, up to ``retries`` times; pages are a little more than a rate limit apart.
    """
    out, page, pages = [], 1, 1
    while page <= pages:
        for attempt in range(retries + 1):
            got = fetch(page)
            if "retry_after" not in got:
                break
            if attempt == retries:
                raise RuntimeError(f"page {page} was refused {retries + 1} times")
            pause(max(0.0, min(300.0, float(got["retry_after"]))))
        out += got.get("releases", [])
        pages = int(got.get("pagination", {}).get("pages", 1))
        page += 1
        if page <= pages:
            pause(60 / requests_per_minute * 1.1)
    return out


def provider(name: str, known: dict[str, Callable]) -> Callable:
    """A reader by name; an unknown one is an error that lists those known."""
    if name not in known:
        raise ValueError(f"unknown collection source {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


PROVIDERS: dict[str, Callable] = {"fixture": read_hand_written, "releases": lambda spark, path, source="releases", url="": to_items(cached_releases(spark, path, 0, 0, True), source, url)}

IGNORED = "item_key string, artist string, title string, reason string, ignored_utc long"


def _texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame | None:
    """Texts at a path, a file each or a line each; None if there is nothing."""
    try:
        return spark.read.option("wholetext", whole).text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_ignored(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The ignore list, or several of them, a file each or a line each; empty where there is none, an error where one is
    malformed."""
    text = _texts(spark, path, whole)
    if text is None:
        return spark.createDataFrame([], IGNORED)
    held = F.from_json("value", "struct<version:int,ignored:map<string,struct<artist:string,title:string,reason:string,ignored_utc:bigint>>>")["ignored"]
    sound = F.when(held.isNull(), F.raise_error(F.lit("the ignore list is malformed"))).otherwise(held)
    return text.select(F.explode(sound).alias("item_key", "v")).select("item_key", "v.*")


def ignored_document(ignored: DataFrame, *owner: str) -> DataFrame:
    """(owner, value): the ignore list as its JSON document, keys in order. A hand-kept list, so one row holds an owner's;
    without ``owner`` there is one list."""
    entry = F.struct(F.col("item_key").alias("key"), F.struct("artist", "title", "reason", "ignored_utc").alias("value"))
    return ignored.groupBy(*owner).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("ignored"))).alias("value"))


def report(audited: DataFrame) -> DataFrame:
    """Rows of an audit as JSON, scores to three places."""
    return audited.select(F.to_json(F.struct("item_key", "status", "reason", F.round("score", 3).alias("score"), "ignored", F.struct("albumartist", "album").alias("matched"))).alias("value"))


def parse_config(text: str, environment: dict[str, str] | None = None, defaults: dict | None = None, prefix: str = "STOWAGE_") -> dict:
    """Settings of a TOML text over defaults; ``PREFIX_SECTION_KEY`` of the environment overrides, in the default's type."""
    import tomllib

    out = json.loads(json.dumps(defaults or {}))
    for section, values in tomllib.loads(text).items():
        out[section] = {**out.get(section, {}), **values} if isinstance(values, dict) else values
    for section, values in out.items():
        for key, value in values.items() if isinstance(values, dict) else ():
            given = (environment or {}).get(f"{prefix}{section}_{key}".upper())
            if given is not None:
                values[key] = given.strip().lower() in ("1", "true", "yes", "on") if isinstance(value, bool) else type(value)(given) if value is not None else given
    return out
