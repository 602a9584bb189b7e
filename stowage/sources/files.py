"""File sources: trees of audio and sidecars, staging folders, timed texts, rip logs, markers."""

import os

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.text import LINE_BREAK, extension, file_name, parent

# What counts as audio, and as cover art.
AUDIO = ("flac", "mp3", "m4a", "aac", "ogg", "opus", "wav", "aif", "aiff", "wv", "ape", "wma")
COVERS = ("cover.jpg", "cover.jpeg", "cover.png")


def is_audio(path: Column) -> Column:
    return extension(path).isin(*AUDIO)


def sidecar_role(path: Column) -> Column:
    """lrc, cover, nolrc or null."""
    name = F.lower(file_name(path))
    return F.when((name == ".nolrc") | (extension(path) == "nolrc"), "nolrc").when(name.isin(*COVERS), "cover").when(extension(path) == "lrc", "lrc")


def is_track_marker(path: Column) -> Column:
    """A ``.nolrc`` of one track, not of its album."""
    return (F.lower(file_name(path)) != ".nolrc") & (extension(path) == "nolrc")


SPREAD = 200
FILES = "path string, rel_path string, byte_size long, mtime_ns long"


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, rel_path, byte_size, mtime_ns) of files under a root, without contents; companion files ``._*`` are left out.

    Spark's own readers pass over empty and hidden files, which are markers here, so the store is listed: the driver goes
    down level by level until there are ``SPREAD`` folders, which tasks walk. The root may be a path or a URI that
    tasks can reach.
    """
    uri = root if ":" in root else "file://" + os.path.abspath(root)

    def rows(store, base: str, infos) -> list[tuple]:
        return [(i.path, i.path[len(base) :].lstrip("/"), i.size, i.mtime_ns) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith("._")]

    store, base = fs.FileSystem.from_uri(uri)
    level, above = [base], []
    while level and len(level) < SPREAD and (recursive or level == [base]):
        infos = [i for folder in level for i in store.get_file_info(fs.FileSelector(folder))]
        above += rows(store, base, infos)
        level = [i.path for i in infos if i.type == fs.FileType.Directory]
    found = spark.createDataFrame(above, FILES)
    if not (recursive and level):
        return found
    folders = [(f,) for f in level]

    def walk(batches):
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch["path"]:
                yield pd.DataFrame(rows(store, base, store.get_file_info(fs.FileSelector(folder, recursive=True))), columns=["path", "rel_path", "byte_size", "mtime_ns"])

    spread = spark.createDataFrame(folders, "path string").repartition(max(1, min(len(folders), 1000)))
    return found.unionByName(spread.mapInPandas(walk, FILES))


def tree(files: DataFrame) -> DataFrame:
    """Files of a listing that are audio or sidecars, with ``kind`` and ``role``; one pass."""
    path = F.col("rel_path")
    return files.withColumns({"kind": F.when(is_audio(path), "audio").when(sidecar_role(path).isNotNull(), "sidecar"), "role": F.when(~is_audio(path), sidecar_role(path))}).where("kind is not null")


def audio_in(files: DataFrame, directory: str) -> DataFrame:
    return files.where(is_audio(F.col("rel_path")) & (parent(F.col("rel_path")) == directory)).orderBy("rel_path")


def album_directories(files: DataFrame) -> DataFrame:
    return files.where(is_audio(F.col("rel_path"))).select(parent(F.col("rel_path")).alias("directory")).distinct().orderBy("directory")


def staging(files: DataFrame) -> DataFrame:
    """(kind, path) ready to import: subfolders with audio, by their first log if they have one; then the root's logs.

    Hidden folders are skipped; the order is alphabetical within both parts.
    """
    path, up = F.col("rel_path"), parent(F.col("rel_path"))
    is_log = F.endswith("rel_path", F.lit(".log"))
    inside = files.where((up != "") & ~F.contains(up, F.lit("/")) & ~F.startswith(up, F.lit(".")))
    dirs = inside.groupBy(up.alias("directory")).agg(F.count_if(is_audio(path)).alias("n"), F.min(F.when(is_log, path)).alias("log")).where("n > 0")
    first = dirs.select(F.lit(0).alias("part"), F.when(F.col("log").isNotNull(), "log").otherwise("dir").alias("kind"), F.coalesce("log", "directory").alias("path"), F.col("directory").alias("at"))
    roots = files.where((up == "") & is_log).select(F.lit(1).alias("part"), F.lit("log").alias("kind"), path.alias("path"), path.alias("at"))
    return first.unionByName(roots).orderBy("part", "at").select("kind", "path")


def has_files(files: DataFrame) -> bool:
    """Whether anything but dotfiles is there."""
    return not files.where(~F.startswith(file_name(F.col("rel_path")), F.lit("."))).isEmpty()


def texts(spark: SparkSession, path: str, suffix: str = "lrc") -> DataFrame:
    """(path, text) of whole text files."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def rip_identity(text: Column) -> Column:
    """struct(artist, album) of a rip log's header, or null.

    The first of the first 20 lines that reads ``artist / album``, before the first ``key : value`` line whose key has
    no slash. Lines of the ripper's own name are passed over.
    """
    lines = F.transform(F.slice(F.split(text, LINE_BREAK), 1, 20), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    skipped = lambda x: (x == "") | F.startswith(x, F.lit("X Lossless")) | F.startswith(x, F.lit("XLD "))
    kept = F.filter(lines, lambda x: ~skipped(x))
    stops = F.transform(kept, lambda x: x.rlike("^[^/]+ : "))
    header = F.when(F.array_contains(stops, True), F.slice(kept, F.lit(1), F.greatest(F.array_position(stops, True) - 1, F.lit(0)).cast("int"))).otherwise(kept)
    side = lambda x, i: F.trim(F.regexp_extract(x, r"^(.*?) / (.*)$", i))
    named = F.filter(F.transform(header, lambda x: F.struct(side(x, 1).alias("artist"), side(x, 2).alias("album"))), lambda s: (s["artist"] != "") & (s["album"] != ""))
    return F.get(named, F.lit(0))


def sibling(texts_: DataFrame, audio: DataFrame) -> DataFrame:
    """Texts (directory, stem, ...) with ``audio``: the file of their stem, of the first extension in order."""
    best = audio.groupBy("directory", "stem").agg(F.min_by("rel_path", "ext").alias("audio"))
    return texts_.join(best, ["directory", "stem"], "left")


def resolved_roots(locations: DataFrame, markers: DataFrame) -> DataFrame:
    """Locations with ``root``: their root path, null without one, where it is no folder, or if it bears another's marker.

    markers: root_path and marker (null if unmarked) of roots that are folders.
    """
    seen = markers.select("root_path", "marker", F.lit(True).alias("_there"))
    joined = locations.join(seen, "root_path", "left")
    fits = F.col("_there") & (F.col("marker").isNull() | (F.col("marker") == F.col("uuid")))
    return joined.select(*locations.columns, F.when(fits, F.col("root_path")).alias("root"))
