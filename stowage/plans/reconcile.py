"""Planners over content, presence and locations. A plan is a table of proposed actions; nothing here acts.

presence: content_id, location_id, present, rel_path, file_sha256, byte_size, observed_utc: one row for each content and
location, absence included. locations: location_id, name, is_authoritative, is_retention, enabled.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.text import safe_path
from stowage.operators.relational import latest, latest_scan

ACTION = "action_kind string, content_kind string, content_id long, source_location_id long, dest_location_id long, rel_path string, reason string"


def fold_presence(observations: DataFrame) -> DataFrame:
    """The last observation of each content at each location."""
    return latest(observations, ["content_id", "location_id"], ["observed_utc"])


def retention_copies(presence: DataFrame, locations: DataFrame) -> DataFrame:
    """(content_id, copies): present copies on retention locations."""
    return presence.where("present").join(locations.where("is_retention").select("location_id"), "location_id", "left_semi").groupBy("content_id").agg(F.count("*").alias("copies"))


def copy_plan(presence: DataFrame, locations: DataFrame, target: int, content_kind: str = "audio") -> DataFrame:
    """Content that some other location has and the target lacks, from the preferred source: authoritative, then by id.

    Nothing is copied into an authoring location (authoritative and not for retention). Content whose row at the target
    is stale counts as there. Sources may be disabled.
    """
    goal = locations.where(F.col("location_id") == target).select(F.col("name").alias("_target"), (F.col("is_authoritative") & ~F.col("is_retention")).alias("_authoring"))
    known = locations.select("location_id", "name", "is_authoritative", F.lit(True).alias("_known"))
    here = F.col("location_id") == target
    # One pass: a content's best source, and whether the target has it, come of the same rows.
    source = F.when(~here & F.col("_known"), F.struct((~F.col("is_authoritative")).alias("later"), "location_id", "name", "rel_path"))
    best = presence.where("present").join(known, "location_id", "left").groupBy("content_id").agg(F.min(source).alias("s"), F.max(here).alias("_there")).where("not _there and s is not null")
    prefix = "" if content_kind == "audio" else f"{content_kind} "
    reason = F.concat(F.lit(f"{prefix}present on "), F.col("s.name"), F.lit(", absent on "), F.col("_target"))
    return best.join(F.broadcast(goal.where("not _authoring")), F.lit(True)).select(F.lit("copy").alias("action_kind"), F.lit(content_kind).alias("content_kind"), "content_id", F.col("s.location_id").alias("source_location_id"), F.lit(target).cast("long").alias("dest_location_id"), F.col("s.rel_path").alias("rel_path"), reason.alias("reason"))


def missing_plan(presence: DataFrame, locations: DataFrame, scans: DataFrame, min_copies: int = 1, require_ok: bool = False) -> DataFrame:
    """(location_id, content_id, rel_path, projected, below_floor): present rows older than their location's last scan.

    ``projected`` retention copies would remain; the floor holds for retention locations only.
    """
    cutoff = latest_scan(scans, require_ok).select("location_id", F.col("started_utc").alias("_cutoff"))
    stale = presence.where("present").join(cutoff, "location_id").where(F.col("observed_utc") < F.col("_cutoff"))
    joined = stale.join(locations.select("location_id", "is_retention"), "location_id").join(retention_copies(presence, locations), "content_id", "left")
    projected = F.coalesce("copies", F.lit(0)) - 1
    return joined.select("location_id", "content_id", "rel_path", F.when(F.col("is_retention"), projected).cast("long").alias("projected"), F.coalesce(F.col("is_retention") & (projected < min_copies), F.lit(False)).alias("below_floor"))


def below_floor(presence: DataFrame, locations: DataFrame, min_copies: int) -> DataFrame:
    """(content_id, copies) of present content with fewer retention copies than asked."""
    held = presence.where("present").select("content_id").distinct()
    return held.join(retention_copies(presence, locations), "content_id", "left").select("content_id", F.coalesce("copies", F.lit(0)).cast("long").alias("copies")).where(F.col("copies") < min_copies)


def reconcile(target: int, presence: DataFrame, sidecars: DataFrame, locations: DataFrame, scans: DataFrame, conflicts: DataFrame, min_copies: int = 1) -> DataFrame:
    """The whole plan for a target: copies of audio and sidecars, missing rows, conflicts; empty if it was never scanned.

    One pass over the presence of audio: what the target has may be missing, what it lacks may be copied, so each content
    has one action at most, and one aggregate finds both its best source and its row at the target.
    """
    scanned = F.broadcast(scans.where(F.col("location_id") == target).select(F.lit(1).alias("_scanned")).limit(1))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    here, dest = F.col("location_id") == target, F.lit(target).cast("long")
    cutoff = latest_scan(scans.where(here), False).select(F.col("started_utc").alias("_cutoff"))
    goal = locations.where(here).select(F.col("name").alias("_target"), (F.col("is_authoritative") & ~F.col("is_retention")).alias("_authoring")).join(F.broadcast(cutoff), F.lit(True), "left")
    known = locations.select("location_id", "name", "is_authoritative", F.lit(True).alias("_known"))
    source = F.when(~here & F.col("_known"), F.struct((~F.col("is_authoritative")).alias("later"), "location_id", "name", "rel_path"))
    folded = presence.where("present").join(known, "location_id", "left").groupBy("content_id").agg(F.min(source).alias("s"), F.max(F.when(here, F.struct("observed_utc", "rel_path"))).alias("own"))
    action = lambda kind, at, path, reason: F.struct(F.lit(kind).alias("action_kind"), at.cast("long").alias("source_location_id"), path.alias("rel_path"), reason.alias("reason"))
    copies = action("copy", F.col("s.location_id"), F.col("s.rel_path"), F.concat(F.lit("present on "), F.col("s.name"), F.lit(", absent on "), F.col("_target")))
    unseen = action("update_presence", F.lit(None), F.col("own.rel_path"), F.concat(F.lit("present in the catalog but not seen in the latest scan of "), "_target"))
    chosen = F.when(F.col("own").isNull() & F.col("s").isNotNull() & ~F.col("_authoring"), copies).when(F.col("own.observed_utc") < F.col("_cutoff"), unseen)
    audio = folded.join(F.broadcast(goal), F.lit(True)).select("content_id", chosen.alias("a")).where("a is not null")
    audio = audio.select("a.action_kind", F.lit("audio").alias("content_kind"), "content_id", "a.source_location_id", dest.alias("dest_location_id"), "a.rel_path", "a.reason")
    diverged = conflicts.select(F.lit("resolve_conflict").alias("action_kind"), F.lit("audio").alias("content_kind"), F.col("doc_id").alias("content_id"), F.col("winner_location").alias("source_location_id"), dest.alias("dest_location_id"), none("rel_path", "string"), F.lit("texts diverge").alias("reason"))
    plan = audio.unionByName(copy_plan(sidecars, locations, target, "sidecar")).unionByName(diverged)
    return plan.join(scanned, F.lit(True), "left_semi")


def prunable(presence: DataFrame, locations: DataFrame, min_copies: int = 1) -> DataFrame:
    """(location_id, content_id, rel_path, byte_size, below_floor): authoring copies that a retention copy backs.

    It must be present at the same path with the same hash. Only enabled authoritative locations that are not for
    retention are pruned. ``below_floor`` warns of fewer retention copies than asked.
    """
    kinds = locations.select("location_id", "is_authoritative", "is_retention", "enabled")
    rows = presence.where("present and rel_path is not null and file_sha256 is not null").join(kinds, "location_id")
    backed = rows.where("is_retention").select("content_id", "rel_path", "file_sha256").distinct()
    own = rows.where("is_authoritative and not is_retention and enabled")
    kept = own.join(backed, ["content_id", "rel_path", "file_sha256"], "left_semi").join(retention_copies(presence, locations), "content_id", "left")
    return kept.select("location_id", "content_id", "rel_path", "byte_size", (F.coalesce("copies", F.lit(0)) < min_copies).alias("below_floor"))


def prune_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("location_id").agg(F.count("*").alias("pruned"), F.coalesce(F.sum("byte_size"), F.lit(0)).cast("long").alias("bytes_freed"), F.count_if("below_floor").alias("below_floor"))


def delete_gate(requests: DataFrame, presence: DataFrame, locations: DataFrame, min_copies: int = 1, dry_run: bool = True) -> DataFrame:
    """Requests (id, content_kind, content_id, location_id, rel_path) with ``verdict`` and ``byte_size``.

    Verdicts: skipped (not audio), error (no such location, or an unsafe path), refused (not for retention, or fewer
    than ``min_copies`` would remain), deleted. A dry run judges each request by the copies there are now. Otherwise
    each granted request lowers what the later ones of its content may take, in order of id: of distinct present
    copies the first ``copies - min_copies`` are granted, a repeat fares as its first, and a request for a copy that is
    not present takes nothing but still needs enough to remain.
    """
    kinds = locations.select("location_id", F.lit(True).alias("_known"), "is_retention")
    state = presence.select("content_id", "location_id", F.col("present").alias("_present"), F.col("byte_size"))
    rows = requests.join(kinds, "location_id", "left")
    early = F.when(F.col("content_kind") != "audio", "skipped").when(F.col("_known").isNull() | F.col("rel_path").isNull() | ~safe_path(F.col("rel_path")), "error").when(~F.col("is_retention"), "refused")
    rows = rows.withColumn("_early", early).drop("_known", "is_retention").join(state, ["content_id", "location_id"], "left")
    if not dry_run:
        # The first request of this copy, while rows are still together and in order by it.
        rows = rows.withColumn("_first", F.min(F.when(F.col("_early").isNull(), F.col("id"))).over(Window.partitionBy("content_id", "location_id")))
    rows = rows.join(retention_copies(presence, locations), "content_id", "left")
    copies, counts = F.coalesce("copies", F.lit(0)), F.coalesce("_present", F.lit(False))
    if dry_run:
        fits: Column = copies - counts.cast("int") >= min_copies
    else:
        # The place of this copy among the distinct present ones asked for. What they take leaves ``min_copies`` if there
        # are as many at all, so that is all a request for a copy that is not present needs.
        place = F.dense_rank().over(Window.partitionBy("content_id", F.col("_early").isNull() & counts).orderBy("_first", "location_id"))
        fits = F.when(counts, place <= copies - min_copies).otherwise(copies >= min_copies)
    verdict = F.coalesce("_early", F.when(fits, "deleted").otherwise("refused"))
    return rows.select(*requests.columns, verdict.alias("verdict"), F.when(verdict == "deleted", F.coalesce("byte_size", F.lit(0))).cast("long").alias("byte_size"))


def delete_totals(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).cast("long").alias("bytes_freed"))


def executed_copies(actions: DataFrame, results: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(presence rows, executed ids, mismatches) of copies that were carried out.

    results: id, source_sha256, dest_sha256, byte_size, mtime_ns (the destination's). Only copies whose hashes agree
    become facts; the others stay in the queue.
    """
    done = actions.where("action_kind = 'copy'").join(results, "id")
    good = done.where(F.col("source_sha256") == F.col("dest_sha256"))
    facts = good.select("content_kind", "content_id", F.col("dest_location_id").alias("location_id"), F.lit(True).alias("present"), "rel_path", F.col("dest_sha256").alias("file_sha256"), "byte_size", "mtime_ns", F.lit(now).cast("long").alias("observed_utc"))
    return facts, good.select("id", F.lit(now).cast("long").alias("executed_utc")), done.where(~F.col("source_sha256").eqNullSafe(F.col("dest_sha256"))).select("id", "rel_path")


def action_labels(actions: DataFrame, audio: DataFrame) -> DataFrame:
    """Actions with ``label``: artist and title of audio, ``?`` for what is unknown; kind and id of anything else."""
    named = actions.join(audio.select(F.col("content_id"), "artist", "title"), "content_id", "left")
    text = F.concat(F.coalesce("artist", F.lit("?")), F.lit(" — "), F.coalesce("title", F.lit("?")))
    return named.select(*actions.columns, F.when(F.col("content_kind") == "audio", text).otherwise(F.concat_ws(" ", "content_kind", F.col("content_id").cast("string"))).alias("label"))


def registry(configured: DataFrame, legacy: DataFrame, pending: str = "Pending") -> DataFrame:
    """Locations from configuration: the pending one, then those configured, then legacy ones of other names.

    Both: ordinal, name, kind, root_path, is_authoritative, is_retention, enabled. Disabled ones are left out; a
    disabled configured one does not hide a legacy one of its name.
    """
    from stowage.functions.keys import location_key

    columns = ["name", "kind", "root_path", "is_authoritative", "is_retention"]
    own = configured.where("enabled").select(F.lit(1).alias("rank"), "ordinal", *columns)
    old = legacy.where("enabled").select(F.lit(2).alias("rank"), "ordinal", *columns)
    first = configured.sparkSession.createDataFrame([(0, 0, pending, "library", None, True, False)], own.schema)
    rows = first.unionByName(own).unionByName(old).withColumn("uuid", location_key(F.col("name")))
    # Within one list the last of a name stands, as an upsert would leave it; the legacy list only fills in.
    best = rows.groupBy("uuid").agg(F.min("rank").alias("rank"))
    return latest(rows.join(best, ["uuid", "rank"]), ["uuid"], ["ordinal"]).drop("rank", "ordinal")
