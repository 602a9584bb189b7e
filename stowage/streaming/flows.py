"""Streams: import triggers without double firing, completeness per group, and lineage per document.

State is kept by the state store, so a restarted query goes on from its checkpoint; use one checkpoint for each query.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.functions.text import file_name, parent
from stowage.operators.lineage import HELD, clock_json, dominates
from stowage.streaming.lease import single_flight  # noqa: F401


def triggers(files: DataFrame, delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Files (rel_path, ts) that start an import: logs, and what lies directly in the root; once within the delay."""
    ours = F.endswith("rel_path", F.lit(".log")) | ((parent(F.col("rel_path")) == "") & ~F.startswith(file_name(F.col("rel_path")), F.lit(".")))
    return files.where(ours).withWatermark(time, delay).dropDuplicatesWithinWatermark(["rel_path"])


class Discs(StatefulProcessor):
    """The disc numbers and totals that a group has shown so far, as state of their own keys: one small write a new number."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "n int", "seen boolean")
        self.totals = handle.getMapState("totals", "n int", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for state, column in ((self.numbers, "disc_no"), (self.totals, "disc_total")):
                for n in frame[column].dropna().unique():
                    if not state.containsKey((int(n),)):
                        state.updateValue((int(n),), (True,))
        have, totals = sum(1 for _ in self.numbers.keys()), [int(n[0]) for n in self.totals.keys()]
        need = totals[0] if len(totals) == 1 else 1
        yield pd.DataFrame({self.key: [key[0]], "have": [have], "need": [need], "ready": [not (need > 1 and have < need)]})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def completeness(discs: DataFrame, key: str = "album_key") -> DataFrame:
    """(key, have, need, ready) whenever a group changes; discs: key, disc_no, disc_total.

    A group waits while its rows agree on a total above 1 and fewer numbers have come. Nulls count for nothing. State is
    kept in RocksDB, which this sets for the session's streams.
    """
    discs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = discs.schema[key].dataType.simpleString()
    return discs.groupBy(key).transformWithStateInPandas(Discs(key), f"{key} {kind}, have int, need int, ready boolean", "Update", "None")


class Documents(StatefulProcessor):
    """A document's versions by hash, their clocks, what each location holds, and the head: each in a state of its own, so
    that an observation reads and writes only what it is about, however many versions there are."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getMapState("versions", "sha string", "version_id long", self.ttl_ms)
        self.clocks = handle.getMapState("clocks", "version_id long", "vclock string", self.ttl_ms)
        self.places = handle.getMapState("places", "location_id long", "version_id long", self.ttl_ms)
        self.head = handle.getValueState("head", "head long, last long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen = sorted({(int(k), a, s) for frame in rows for k, a, s in zip(frame["location_id"].tolist(), frame["actor"].tolist(), frame["sha"].tolist())})
        # Each call of a state is a round trip, so a value is read once, and none of a document that has no head yet: the
        # head is written last, so it outlives the rest.
        new, held_here = not self.head.exists(), {}

        def at(state, k):
            place = (id(state), k)
            if place not in held_here:
                held_here[place] = state.getValue((k,))[0] if not new and state.containsKey((k,)) else None
            return held_here[place]

        def put(state, k, value) -> None:
            held_here[id(state), k] = value
            state.updateValue((k,), (value,))

        clock = lambda v: json.loads(at(self.clocks, v) or "{}") if v is not None else {}
        head, last = (None, 0) if new else self.head.get()
        held = []
        for location, actor, sha in seen:
            version = at(self.versions, sha)
            if version is None:
                base = at(self.places, location)
                linear = head is None or base == head
                grown = clock(head if linear else base)
                grown[actor] = grown.get(actor, 0) + 1
                version = last = last + 1
                put(self.versions, sha, version)
                put(self.clocks, version, clock_json(grown))
                if linear:
                    head = version
            held.append((location, version, sha))
        self.head.update((head, last))
        top, out = clock(head), []
        for location, version, sha in held:
            if at(self.places, location) != version:
                put(self.places, location, version)
            own = clock(version)
            behind = version != head and dominates(top, own)
            out.append((key[0], location, version, sha, version == head, behind, version != head and not behind and not dominates(own, top), head))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HELD.split(", ")])

    def close(self) -> None:
        pass


def lineage(observations: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """What locations hold, for each document that a batch touches; observations: doc_id, location_id, actor, sha.

    An observation that comes late is judged by the base its location is known to hold, so it never overwrites what
    went on elsewhere: it is concurrent. Folding it again changes nothing. With ``ttl_ms``, versions and locations that
    were not written for so long are forgotten. State is kept in RocksDB, which this sets for the session's streams.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return observations.groupBy("doc_id").transformWithStateInPandas(Documents(ttl_ms), HELD, "Append", "ProcessingTime" if ttl_ms else "None")


def progress(rows: DataFrame, name: str, size: str | None = None) -> DataFrame:
    """Rows observed as they pass: counts under ``name`` in each batch's progress."""
    return rows.observe(name, F.count("*").alias("rows"), *([F.coalesce(F.sum(size), F.lit(0)).alias("bytes")] if size else []))
