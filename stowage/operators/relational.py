"""Latest-row, upsert and lookup operators shared by the planners. All are joins and grouped aggregates.

Ties that the order of rows would settle are settled by an explicit ``ordinal`` or by all remaining columns.
"""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.text import ascii_lower

# Latest rows


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[str], *, smallest: bool = False) -> DataFrame:
    """The row of each key with the largest ``by`` (then all other columns); partial aggregation, no window.

    Null keys are a key of their own. ``smallest`` takes the smallest instead. Empty in, empty out.
    """
    rest = [c for c in rows.columns if c not in keys and c not in by]
    pick = F.min if smallest else F.max
    return rows.groupBy(*keys).agg(pick(F.struct(*by, *rest)).alias("_row")).select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in rows.columns])


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a given order; without keys, of all rows."""
    if not keys:
        return rows.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest_scan(scans: DataFrame, require_ok: bool = False) -> DataFrame:
    """The last scan started at each location, by start and id, whatever its status unless ``require_ok``."""
    rows = scans.where(F.col("status") == "ok") if require_ok else scans
    return latest(rows, ["location_id"], ["started_utc", "id"])


def latest_run(runs: DataFrame) -> DataFrame:
    return latest(runs, ["kind"], ["started_utc", "id"])


def open_conflict(conflicts: DataFrame) -> DataFrame:
    """The newest open conflict of each content."""
    return latest(conflicts.where(F.col("status") == "open"), ["audio_id"], ["id"])


def at_path(presence: DataFrame) -> DataFrame:
    """The last observed present row of each (location, path)."""
    return latest(presence.where("present and rel_path is not null"), ["location_id", "rel_path"], ["observed_utc", "content_id"])


def prefer_ext_id(albums: DataFrame, artist: str = "albumartist", title: str = "album", ext_id: str = "ext_id", ordinal: str = "ordinal") -> DataFrame:
    """One album of each folded (artist, title): one with an external id, else the first."""
    keyed = albums.withColumns({"_a": F.lower(F.trim(F.coalesce(F.col(artist), F.lit("")))), "_t": F.lower(F.trim(F.coalesce(F.col(title), F.lit("")))), "_none": F.coalesce(F.col(ext_id), F.lit("")) == ""})
    return latest(keyed, ["_a", "_t"], ["_none", ordinal], smallest=True).drop("_a", "_t", "_none")


def first_by(rows: DataFrame, condition: Column, ordinal: str = "ordinal") -> DataFrame:
    """The first row in order for which a condition holds, as a table of at most one row."""
    return rows.where(condition).orderBy(ordinal).limit(1)


def first_known(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Of each key, ``columns`` of its first row in which any of them is not empty."""
    known = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).isNotNull()
    return rows.where(known).groupBy(*keys).agg(F.min_by(F.struct(*columns), ordinal).alias("_row")).select(*keys, "_row.*")


# Upserts: a table and changes to it give the next snapshot


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], *, keep_first: Sequence[str] = (), never_clear: Sequence[str] = ()) -> DataFrame:
    """The table after an upsert of at most one change for each key.

    Columns of ``keep_first`` keep what an old row has; those of ``never_clear`` take the change unless it is null;
    all others take the change. A column that changes lack keeps its value. Null keys match each other.
    """
    old, new = F.col("a._here").isNotNull(), F.col("b._here").isNotNull()

    def merged(c: str) -> Column:
        if c not in changes.columns:
            return F.col(f"a.{c}").alias(c)
        mine, its = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys:
            return F.when(old, mine).otherwise(its).alias(c)
        if c in keep_first:
            return F.when(old, mine).otherwise(its).alias(c)
        if c in never_clear:
            return F.coalesce(its, mine).alias(c)
        return F.when(new, its).otherwise(mine).alias(c)

    def joined(rows: DataFrame, its: DataFrame, same) -> DataFrame:
        a, b = (x.withColumn("_here", F.lit(1)).alias(side) for x, side in ((rows, "a"), (its, "b")))
        return a.join(b, [same(F.col(f"a.{k}"), F.col(f"b.{k}")) for k in keys], "full").select(*[merged(c) for c in table.columns])

    # Only plain equality keeps rows where a fold by the same keys left them, so keys with a null are joined on their own.
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    return joined(table.where(~null), changes.where(~null), Column.__eq__).unionByName(joined(table.where(null), changes.where(null), Column.eqNullSafe))


def insert_missing(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table and those rows whose key it lacks, one for each key. Null keys match each other."""
    fresh = latest(rows.select(*table.columns), keys, [c for c in table.columns if c not in keys], smallest=True)
    known = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    return table.unionByName(fresh.join(known, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_anti"))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def remove(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def acknowledge(actions: DataFrame, chosen: Column, now: int) -> DataFrame:
    """Actions with those chosen acknowledged, and ``changed`` for the ones that were not before."""
    changes = chosen & ~F.col("acknowledged")
    return actions.withColumns({"changed": changes, "acknowledged_utc": F.when(changes, F.lit(now).cast("long")).otherwise(F.col("acknowledged_utc")), "acknowledged": F.col("acknowledged") | chosen})


def mark(rows: DataFrame, chosen: Column, **values: object) -> DataFrame:
    """Rows with columns set where a condition holds: executed actions, resolved conflicts, finished runs and scans."""
    return rows.withColumns({c: F.when(chosen, v if isinstance(v, Column) else F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def move_prefix(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths that start with ``old`` start with ``new``; later occurrences stay."""
    return rows.withColumn(column, F.when(F.startswith(column, F.lit(old)), F.concat(F.lit(new), F.substr(F.col(column), F.lit(len(old) + 1)))).otherwise(F.col(column)))


def ensure_docs(docs: DataFrame, audio: DataFrame, now: int) -> DataFrame:
    """Documents, one more for each content that has none; a new one's id is the content's, its head null."""
    fresh = audio.select("audio_id").distinct().join(docs, "audio_id", "left_anti")
    return append(docs, fresh.select(F.col("audio_id").alias("id"), "audio_id", F.lit(now).cast("long").alias("created_utc"), F.lit(now).cast("long").alias("updated_utc")))


def merge_keeping_conflicts(incoming: DataFrame, existing: DataFrame, keys: Sequence[str] = ("directory", "name"), digest: str = "sha256") -> DataFrame:
    """Incoming files with ``outcome`` and ``stored_as``: new ones move, equal ones are dropped, differing ones are parked.

    Nothing that exists is replaced, nor is one incoming file by another: of several of one name, where none exists, the
    one of the smallest digest moves, and each other content is parked once. Parked files get the free names
    ``stem (n).ext``, n from 2, by digest; a number that any file bears is taken.
    """
    numbered = r"^(.*) \((\d+)\)(\.[^.]*)?$"
    part = lambda i: F.coalesce(F.regexp_extract("name", numbered, i), F.lit(""))
    everything = existing.select(*keys).unionByName(incoming.select(*keys))
    taken = everything.select("directory", part(1).alias("_stem"), part(3).alias("_ext"), part(2).try_cast("int").alias("_n")).where("_n is not null")
    used = taken.groupBy("directory", "_stem", "_ext").agg(F.collect_set("_n").alias("_used"))
    of_name, of_content = Window.partitionBy(*keys), Window.partitionBy(*keys, digest)
    rows = incoming.join(existing.select(*keys, F.col(digest).alias("_held")), list(keys), "left")
    rows = rows.withColumns({"_first": F.min(digest).over(of_name), "_repeat": F.row_number().over(of_content.orderBy(F.lit(0)))})
    stays = F.coalesce("_held", "_first")
    outcome = F.when(F.col(digest) == stays, F.when(F.col("_held").isNull() & (F.col("_repeat") == 1), "moved").otherwise("dropped")).otherwise(F.when(F.col("_repeat") == 1, "parked").otherwise("dropped"))
    base = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    rows = rows.withColumns({"outcome": outcome, "_stem": base, "_ext": F.substr(F.col("name"), F.char_length(base) + 1)})
    rows = rows.join(used, ["directory", "_stem", "_ext"], "left").withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "outcome").orderBy(digest)))
    held = F.coalesce("_used", F.array().cast("array<int>"))
    free = F.get(F.array_except(F.sequence(F.lit(2), F.size(held) + 1 + F.col("_place")), held), F.col("_place") - 1)
    stored = F.when(F.col("outcome") == "parked", F.concat("_stem", F.format_string(" (%d)", free), "_ext")).otherwise(F.col("name"))
    return rows.withColumn("stored_as", stored).select(*incoming.columns, "outcome", "stored_as")


# Lookups and filters


def lookup(rows: DataFrame, reference: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with columns of what a unique key finds, null where it finds nothing. Never a lookup row by row."""
    return rows.join(reference.select(*on, *columns), list(on), "left")


def where_optional(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows that meet all given conditions; None asks nothing. A bool on ``*_utc`` asks whether it is set."""
    for c, v in wanted.items():
        if v is not None:
            rows = rows.where(F.col(c).isNotNull() if v is True and c.endswith("_utc") else F.col(c).isNull() if v is False and c.endswith("_utc") else F.col(c) == F.lit(v))
    return rows


def pending_actions(actions: DataFrame, action_kind: str | None = None, dest_location_id: int | None = None) -> DataFrame:
    """Acknowledged actions that are not executed. First in, first out is by ``id``; whoever needs the order sorts."""
    return where_optional(actions, acknowledged=True, executed_utc=False, action_kind=action_kind, dest_location_id=dest_location_id)


def unambiguous(rows: DataFrame, keys: Sequence[str], content: str = "content_id") -> DataFrame:
    """(keys, content): what a key stands for, null where it stands for more than one thing."""
    lo, hi = F.min(content), F.max(content)
    return rows.where(F.col(content).isNotNull()).groupBy(*keys).agg(F.when(lo == hi, lo).alias(content))


def filter_media(items: DataFrame, media: Sequence[str], column: str = "media") -> DataFrame:
    """Items on any of the media; no media keeps all."""
    return items.where(F.arrays_overlap(column, F.array(*map(F.lit, media)))) if media else items


KNOWN_MEDIA = ("cd", "vinyl", "cassette", "digital", "other")


def known_media(values: Sequence[str]) -> list[str]:
    """Media by name, in any case; an unknown one is an error that lists those known."""
    clean = [v.strip().lower() for v in values]
    if bad := [v for v, c in zip(values, clean) if c not in KNOWN_MEDIA]:
        raise ValueError(f"unknown media {bad}; known: {', '.join(KNOWN_MEDIA)}")
    return clean


def nocase_order(rows: DataFrame, *columns: str, ordinal: str | None = None) -> DataFrame:
    """Rows by columns in which only A-Z fold, then by the ordinal."""
    return rows.orderBy(*[ascii_lower(F.col(c)) for c in columns], *([ordinal] if ordinal else []))


def unknown_ids(wanted: DataFrame, collection: DataFrame, key: str = "item_key") -> DataFrame:
    """Requested keys that the collection lacks; none if the collection is empty, as nothing is known then."""
    known = collection.select(F.lit(1).alias("_known")).limit(1)
    return wanted.join(collection, key, "left_anti").join(F.broadcast(known), F.lit(True), "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference points nowhere; null references point nowhere by intent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


# Paths


def stem_join(sidecars: DataFrame, tracks: DataFrame, anywhere: DataFrame) -> DataFrame:
    """Sidecars (directory, stem, ...) with ``content_id``: of the track of that stem beside it, the last by ordinal;
    else what the stem unambiguously stands for at any location (``anywhere``: directory, stem, content_id)."""
    here = tracks.withColumn("_stem", F.lower("stem")).groupBy("directory", "_stem").agg(F.max_by("content_id", "ordinal").alias("_here"))
    there = unambiguous(anywhere, ["directory", "stem"]).withColumnRenamed("content_id", "_there")
    return sidecars.withColumn("_stem", F.lower("stem")).join(here, ["directory", "_stem"], "left").join(there, ["directory", "stem"], "left").withColumn("content_id", F.coalesce("_here", "_there")).drop("_stem", "_here", "_there")


def directory_album(directories: DataFrame, track_albums: DataFrame) -> DataFrame:
    """Directories with ``album_id``: of the tracks in it, else of those one level down; null if that is not one album.

    Tracks one level down count only if there are none in the directory itself.
    """
    direct = track_albums.groupBy("directory").agg(F.min("album_id").alias("_lo"), F.max("album_id").alias("_hi"))
    below = direct.where("directory <> ''").withColumn("_up", F.regexp_extract("directory", r"^(?:(.*)/)?[^/]*$", 1)).groupBy("_up").agg(F.min("_lo").alias("_blo"), F.max("_hi").alias("_bhi")).withColumn("_up", F.coalesce("_up", F.lit("")))
    joined = directories.join(direct, "directory", "left").join(below.withColumnRenamed("_up", "directory"), "directory", "left")
    inside = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    under = F.when(F.col("_blo") == F.col("_bhi"), F.col("_blo"))
    return joined.withColumn("album_id", F.when(F.col("_lo").isNotNull(), inside).otherwise(under)).drop("_lo", "_hi", "_blo", "_bhi")
