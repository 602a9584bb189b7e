"""Causal lineage of versioned documents: a fold per document over what its locations hold.

The fold is ordered (a location's new hash may move the head that the next one is judged by), so it runs in Python over
one document's rows at a time; a document has at most as many rows as locations and versions. Documents are
independent and spread over all tasks.
"""

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = "doc_id long, location_id long, version_id long, sha string, is_head boolean, is_behind boolean, is_concurrent boolean, head_version_id long"
VERSIONS = "doc_id long, version_id long, sha string, vclock string, is_new boolean"


def clock_json(v: dict[str, int]) -> str:
    return json.dumps({k: v[k] for k in sorted(v) if v[k] > 0}, separators=(",", ":"))


def dominates(a: dict[str, int], b: dict[str, int]) -> bool:
    return all(a.get(k, 0) >= n for k, n in b.items())


def fold(observations: list[tuple], versions: list[tuple], prior: dict[int, int], head_id: int | None) -> tuple[list[tuple], list[tuple], int | None]:
    """(held, versions, head) after one pass.

    observations: (location_id, actor, sha). versions: (version_id, sha, clock as JSON), known before. prior: the
    version each location held before. Observations count by location; a hash seen before is its version; a new one
    follows the head if its location held the head (or there is none), else it is an edit of its own. Documents with
    versions but no head adopt the last version. Version ids count on from the largest.
    """
    clocks = {v: json.loads(c) if c else {} for v, _, c in versions}
    by_sha = {s: v for v, s, _ in sorted(versions)}
    shas, known = {v: s for v, s, _ in versions}, set(clocks)
    head, following = head_id, max(clocks, default=0) + 1
    if head is None and clocks:
        head = max(clocks)
    held = []
    for location, actor, sha in sorted(observations):
        if sha not in by_sha:
            base = prior.get(location)
            linear = head is None or base == head
            clock = dict(clocks.get(head if linear else base) or {})
            clock[actor] = clock.get(actor, 0) + 1
            version, following = following, following + 1
            clocks[version], shas[version], by_sha[sha] = clock, sha, version
            if linear:
                head = version
        held.append((location, by_sha[sha], sha))
    top = clocks.get(head) or {}
    out = []
    for location, version, sha in held:
        own = clocks[version]
        behind = version != head and dominates(top, own)
        out.append((location, version, sha, version == head, behind, version != head and not behind and not dominates(own, top)))
    return out, [(v, shas[v], clock_json(clocks[v]), v not in known) for v in sorted(clocks)], head


def lineage(observations: DataFrame, versions: DataFrame | None = None, prior: DataFrame | None = None, heads: DataFrame | None = None, want: str = "held") -> DataFrame:
    """What each location holds after the fold (``want='held'``), or all versions (``want='versions'``).

    observations: doc_id, location_id, actor, sha. versions: doc_id, version_id, sha, vclock. prior: doc_id,
    location_id, version_id. heads: doc_id, version_id. Folding the same observations again changes nothing.
    """
    parts = [observations.select("doc_id", F.lit(0).alias("kind"), "location_id", F.lit(None).cast("long").alias("version_id"), "actor", "sha", F.lit(None).cast("string").alias("vclock"))]
    blank = lambda c, kind: F.lit(None).cast(kind).alias(c)
    if versions is not None:
        parts.append(versions.select("doc_id", F.lit(1).alias("kind"), blank("location_id", "long"), "version_id", blank("actor", "string"), "sha", "vclock"))
    if prior is not None:
        parts.append(prior.select("doc_id", F.lit(2).alias("kind"), "location_id", "version_id", blank("actor", "string"), blank("sha", "string"), blank("vclock", "string")))
    if heads is not None:
        parts.append(heads.select("doc_id", F.lit(3).alias("kind"), blank("location_id", "long"), "version_id", blank("actor", "string"), blank("sha", "string"), blank("vclock", "string")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    schema = HELD if want == "held" else VERSIONS
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, parts in zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist()):
                of = lambda kind: (p for p in parts if p["kind"] == kind)  # noqa: B023, E731
                seen = [(p["location_id"], p["actor"], p["sha"]) for p in of(0)]
                known = [(p["version_id"], p["sha"], p["vclock"]) for p in of(1)]
                before = {p["location_id"]: p["version_id"] for p in of(2)}
                head = min((p["version_id"] for p in of(3) if p["version_id"] is not None), default=None)
                held, after, top = fold(seen, known, before, head)
                out += [(doc_id, *h, top) for h in held] if want == "held" else [(doc_id, *v) for v in after]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(columns)], [c for c, _ in columns])

    # A document's rows are one array, and a task folds many documents.
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "location_id", "version_id", "actor", "sha", "vclock"))).alias("parts"))
    return grouped.mapInArrow(run, schema)


def concurrent(held: DataFrame) -> DataFrame:
    return held.where("is_concurrent")


def behind(held: DataFrame) -> DataFrame:
    return held.where("is_behind")


def conflicts(held: DataFrame, target: int, opened: DataFrame) -> DataFrame:
    """(doc_id, winner_location, winner_version, loser_version, opens): divergence that the target is a party to.

    Proposed each time; ``opens`` only if the content has no open conflict (``opened``: doc_id).
    """
    losers = held.where(F.col("is_concurrent") & (F.col("location_id") == target)).select("doc_id", F.col("version_id").alias("loser_version"), F.col("head_version_id").alias("winner_version"))
    winners = held.where("is_head").groupBy("doc_id").agg(F.min("location_id").alias("winner_location"))
    open_ = opened.select("doc_id", F.lit(True).alias("_open")).distinct()
    return losers.join(winners, "doc_id", "left").join(open_, "doc_id", "left").select("doc_id", "winner_location", "winner_version", "loser_version", F.col("_open").isNull().alias("opens"))


def folded_batches(batches: Iterator[list[tuple]]) -> tuple[list[tuple], list[tuple], int | None]:
    """The fold over successive passes of one document, as a stream makes them."""
    versions, prior, head, held = [], {}, None, []
    for seen in batches:
        held, after, head = fold(seen, versions, prior, head)
        versions = [(v, s, c) for v, s, c, _ in after]
        prior |= {location: version for location, version, *_ in held}
    return held, versions, head
