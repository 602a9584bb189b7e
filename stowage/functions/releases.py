"""A nested release record of a collection service as a flat collection item."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.keys import item_key

RELEASE = (
    "id long, instance_id long, date_added string, basic_information struct<id:long,title:string,year:int,thumb:string,"
    "formats:array<struct<name:string,qty:string,descriptions:array<string>,text:string>>,"
    "labels:array<struct<name:string,catno:string>>,artists:array<struct<name:string,anv:string,join:string,id:long>>>"
)

# Format names by medium; any other name is "other".
MEDIA = {
    "cd": ("CD", "CDr", "CD-ROM", "HDCD", "SACD", "SHM-CD", "Blu-spec CD", "Mini-CD"),
    "vinyl": ("Vinyl", "Acetate", "Flexi-disc", "Shellac", "Lathe Cut"),
    "cassette": ("Cassette", "8-Track Cartridge", "Reel-To-Reel", "DAT", "Microcassette"),
    "digital": ("File", "Digital Media"),
}

STRINGS = "array<string>"


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def medium(name: Column) -> Column:
    out = F.lit("other")
    for kind, names in MEDIA.items():
        out = F.when(_clean(name).isin(*names), kind).otherwise(out)
    return out


def media_of(formats: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(formats, F.array().cast("array<struct<name:string,qty:string,descriptions:array<string>,text:string>>")), lambda f: medium(f["name"]))))


def printed_name(artist: Column) -> Column:
    """The name as printed, or else the canonical one."""
    return F.coalesce(F.nullif(_clean(artist["anv"]), F.lit("")), _clean(artist["name"]))


def artist_display(artists: Column) -> Column:
    """Names with the words between them; no space before a comma or semicolon."""
    parts = F.flatten(F.transform(artists, lambda a, i: F.array(printed_name(a), F.when(i < F.size(artists) - 1, _clean(a["join"])).otherwise(""))))
    return F.trim(F.regexp_replace(F.array_join(F.filter(parts, lambda p: p != ""), " "), r"\s+([,;])", "$1"))


def artist_alts(artists: Column, display: Column) -> Column:
    """Other spellings: canonical names together, the first artist as printed and by name, and the long form of "various"."""
    names = F.filter(F.transform(artists, lambda a: _clean(a["name"])), lambda n: n != "")
    first = F.get(artists, F.lit(0))
    various = F.when(F.startswith(F.lower(display), F.lit("various")), F.array(F.lit("Various Artists"))).otherwise(F.array().cast(STRINGS))
    alts = F.concat(F.array(F.array_join(names, " "), _clean(first["anv"]), _clean(first["name"])), various)
    return F.array_except(F.filter(alts, lambda a: a != ""), F.array(display))


def title_alts(title: Column) -> Column:
    """Both sides of a title written in two scripts, joined by `` = ``."""
    sides = F.filter(F.transform(F.split(title, " = "), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.contains(title, F.lit(" = ")), sides).otherwise(F.array().cast(STRINGS))


def catalog_number(labels: Column) -> Column:
    """The first that is one."""
    return F.get(F.filter(F.transform(labels, lambda x: _clean(x["catno"])), lambda c: (c != "") & (F.lower(c) != "none")), F.lit(0))


def to_items(releases: DataFrame, source: str, url_prefix: str) -> DataFrame:
    """Collection items of releases (see RELEASE, with ``ordinal``); those without id or title are dropped."""
    info = F.col("basic_information")
    none = F.array().cast("array<struct<name:string,anv:string,join:string,id:long>>")
    artists = F.coalesce(info["artists"], none)
    rows = releases.withColumns({"_id": F.coalesce("id", info["id"]), "_title": _clean(info["title"]), "_display": artist_display(artists)})
    rows = rows.where("_id is not null and _title <> ''")
    key = F.col("_id").cast("string")
    return rows.select(
        F.lit(source).alias("source"), key.alias("source_id"), item_key(F.lit(source), key).alias("item_key"), "ordinal", F.col("_display").alias("artist"), F.col("_title").alias("title"),
        media_of(info["formats"]).alias("media"), F.nullif(info["year"], F.lit(0)).alias("year"), catalog_number(info["labels"]).alias("catno"), artist_alts(artists, F.col("_display")).alias("artist_alts"),
        title_alts(F.col("_title")).alias("title_alts"), F.lit(None).cast("string").alias("ext_id"), F.concat(F.lit(url_prefix), key).alias("url"), F.nullif(_clean(info["thumb"]), F.lit("")).alias("thumb_url"),
    )
