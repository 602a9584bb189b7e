"""Inventory of a location: what a scan saw, folded into content, albums, sidecars and presence."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.keys import album_key
from stowage.functions.text import file_name, parent, stem
from stowage.operators.relational import at_path, directory_album, insert_missing, latest, stem_join, upsert


def rescan_decision(files: DataFrame, presence: DataFrame, rehash: bool = False) -> DataFrame:
    """Files (location_id, rel_path, byte_size, mtime_ns) with ``decision`` and what is reused.

    A file of unchanged size and time reuses its content and hash; a null time never matches. Only the rest is hashed.
    """
    known = at_path(presence).select("location_id", "rel_path", F.col("content_id").alias("_content"), F.col("file_sha256").alias("_sha"), F.col("byte_size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    joined = files.join(known, ["location_id", "rel_path"], "left")
    same = F.lit(not rehash) & F.coalesce((F.col("byte_size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")) & F.col("_sha").isNotNull(), F.lit(False))
    return joined.select(*files.columns, F.when(same, "reuse").otherwise("hash").alias("decision"), F.when(same, F.col("_content")).alias("content_id"), F.when(same, F.col("_sha")).alias("file_sha256"))


def inventory(location_id: int, now: int, tracks: DataFrame, sidecars: DataFrame, audio: DataFrame, presence: DataFrame, albums: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The next snapshot of the tables after a scan of one location; ids of new rows are hashes of their keys.

    tracks: rel_path, identity, identity_kind, artist, albumartist, album, title, ext_id, file_sha256, byte_size,
    mtime_ns. sidecars: rel_path, role, file_sha256. audio: content_id, identity, identity_kind, artist, album, title,
    first_seen_utc, last_seen_utc. albums: album_id, album_key, albumartist, album, ext_id, first_seen_utc, last_seen_utc.
    """
    seen = F.lit(now).cast("long")
    keyed = tracks.withColumns({"content_id": F.xxhash64("identity"), "album_key": album_key(F.coalesce("albumartist", "artist"), F.col("album"), F.col("ext_id"))}).withColumn("album_id", F.xxhash64("album_key"))
    one = lambda rows, keys: latest(rows, keys, [c for c in rows.columns if c not in keys])
    new_audio = one(keyed.select("content_id", "identity", "identity_kind", "artist", "album", "title", seen.alias("first_seen_utc"), seen.alias("last_seen_utc")), ["content_id"])
    new_albums = one(keyed.select("album_id", "album_key", F.coalesce("albumartist", "artist").alias("albumartist"), "album", "ext_id", seen.alias("first_seen_utc"), seen.alias("last_seen_utc")), ["album_id"])
    facts = one(keyed.select("content_id", F.lit(location_id).cast("long").alias("location_id"), F.lit(True).alias("present"), "rel_path", "file_sha256", "byte_size", "mtime_ns", seen.alias("observed_utc")), ["content_id", "location_id"])
    next_presence = upsert(presence, facts, ["content_id", "location_id"], never_clear=["mtime_ns"])
    next_links = insert_missing(links, keyed.select("album_id", "content_id"), ["album_id", "content_id"])

    placed = next_presence.where("present").select("content_id", parent(F.col("rel_path")).alias("directory"), stem(file_name(F.col("rel_path"))).alias("stem"))
    here = keyed.select("content_id", parent(F.col("rel_path")).alias("directory"), stem(file_name(F.col("rel_path"))).alias("stem"), F.col("rel_path").alias("ordinal"))
    side = sidecars.withColumns({"directory": parent(F.col("rel_path")), "stem": stem(file_name(F.col("rel_path")))})
    on_track = (F.col("role") == "lrc") | ((F.col("role") == "nolrc") & (file_name(F.col("rel_path")) != ".nolrc"))
    by_track = stem_join(side.where(on_track), here, placed).select("rel_path", "role", "file_sha256", F.lit("track").alias("parent_kind"), F.col("content_id").alias("parent_id"))
    in_scan = here.select("directory", "content_id").join(next_links, "content_id").select("directory", "album_id").distinct()
    anywhere = placed.select("directory", "content_id").join(next_links, "content_id").select("directory", "album_id").distinct()
    dirs = side.where(~on_track).select("directory").distinct()
    found = directory_album(dirs, in_scan).select("directory", F.col("album_id").alias("_here")).join(directory_album(dirs, anywhere).select("directory", F.col("album_id").alias("_any")), "directory")
    by_album = side.where(~on_track).join(found, "directory").select("rel_path", "role", "file_sha256", F.lit("album").alias("parent_kind"), F.coalesce("_here", "_any").alias("parent_id"))
    attached = by_track.unionByName(by_album).where("parent_id is not null")
    return {
        "audio": upsert(audio, new_audio, ["content_id"], keep_first=["first_seen_utc"], never_clear=["artist", "album", "title"]),
        "albums": upsert(albums, new_albums, ["album_id"], keep_first=["first_seen_utc"], never_clear=["ext_id"]),
        "links": next_links,
        "presence": next_presence,
        "sidecars": latest(attached, ["parent_kind", "parent_id", "role"], ["rel_path"]),
    }


def scan_counts(audio_before: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: scanned files, contents that are new, and those seen before."""
    seen = tracks.select(F.xxhash64("identity").alias("content_id")).distinct().join(audio_before.select("content_id", F.lit(1).alias("_old")), "content_id", "left")
    return seen.agg(F.count_if(F.col("_old").isNull()).alias("new"), F.count_if(F.col("_old").isNotNull()).alias("updated")).join(F.broadcast(tracks.agg(F.count("*").alias("scanned"))), F.lit(True))


def migrate(table: DataFrame, version: int, steps: list) -> tuple[DataFrame, int]:
    """The table after the steps above its version, in order; each is (version, upgrade). Migrating again does nothing."""
    for number, upgrade in sorted(steps, key=lambda s: s[0]):
        if number > version:
            table, version = upgrade(table), number
    return table, version


def add_columns(**columns: str):
    """A step that adds nullable columns where they are missing."""
    return lambda table: table.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in table.columns})
