"""A folder's changes as a stream: created, updated and renamed files, and folders, since the listing before.

``register(spark)`` names the source ``file_events``. Each listing that differs from the last is a numbered snapshot in the
``state`` folder, beside the events that lead to it; an offset is a snapshot's number, so a query that is started
again goes on from the events after its last batch, with none missed and none repeated, whatever happened meanwhile.
Batches read stored events, never the folder, and so are the same when they are run again. The folder is listed by
the driver, as Spark's own file stream does it; events go to tasks in parts of ``PART`` rows.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENT = "event string, rel_path string, old_path string, is_dir boolean, byte_size long, mtime_ns long, ts timestamp"
PART = 10_000

Listing = dict[str, tuple[bool, int, int]]  # by relative path: folder?, bytes, modification time


def listed(root: str, depth: int | None = None) -> Listing:
    """What is under a root, companion files ``._*`` left out; a root that isn't there is empty."""
    import pyarrow.fs as pafs

    store, base = pafs.FileSystem.from_uri(root if ":" in root else "file://" + os.path.abspath(root))
    infos = store.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=depth != 1))
    whole = {i.path[len(base) :].lstrip("/"): (i.type == pafs.FileType.Directory, i.size or 0, i.mtime_ns or 0) for i in infos if not i.base_name.startswith("._")}
    return {p: v for p, v in whole.items() if depth is None or p.count("/") < depth}


def changes(before: Listing, after: Listing) -> list[tuple]:
    """(event, rel_path, old_path, is_dir, byte_size, mtime_ns) in the order of paths.

    A file is renamed if a path is gone and one is new, both of one size and modification time that no other such paths
    have; empty files and folders tell nothing by these and are new. What is gone for good is no event.
    """
    gone: dict[tuple, list[str]] = {}
    new: dict[tuple, list[str]] = {}
    for here, there, found in ((before, after, gone), (after, before, new)):
        for path, (is_dir, size, when) in here.items():
            if path not in there and not is_dir and size:
                found.setdefault((size, when), []).append(path)
    renamed = {new[k][0]: gone[k][0] for k in new if len(new[k]) == 1 and len(gone.get(k, ())) == 1}
    out = []
    for path, value in sorted(after.items()):
        if path in renamed:
            out.append(("renamed", path, renamed[path], *value))
        elif path not in before:
            out.append(("created", path, None, *value))
        elif before[path] != value:
            out.append(("updated", path, None, *value))
    return out


class Journal:
    """Numbered snapshots and their events in a folder of any store that Arrow reaches."""

    def __init__(self, folder: str):
        self.folder = folder

    def _store(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.folder if ":" in self.folder else "file://" + os.path.abspath(self.folder))

    def _names(self, kind: str) -> list[tuple[int, str]]:
        import pyarrow.fs as pafs

        store, base = self._store()
        infos = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted((int(i.base_name.split("-")[1].split(".")[0]), i.path) for i in infos if i.base_name.startswith(kind + "-") and i.base_name.endswith(".json"))

    def write(self, name: str, content: object) -> None:
        store, base = self._store()
        store.create_dir(base, recursive=True)
        part = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(content).encode())
        store.move(part, f"{base}/{name}.json")

    def read(self, name: str) -> object:
        store, base = self._store()
        with store.open_input_stream(f"{base}/{name}.json") as f:
            return json.loads(f.read())

    def last(self) -> tuple[int, Listing]:
        numbers = self._names("snapshot")
        if not numbers:
            return 0, {}
        return numbers[-1][0], {p: tuple(v) for p, v in self.read(f"snapshot-{numbers[-1][0]:012d}").items()}

    def add(self, number: int, listing: Listing, events: list[tuple], now: float) -> None:
        """Events first: a snapshot that is there has all of its events."""
        parts = [events[i : i + PART] for i in range(0, len(events), PART)]
        for k, part in enumerate(parts):
            self.write(f"events-{number:012d}.{k}", {"ts": now, "rows": part})
        self.write(f"parts-{number:012d}", len(parts))
        self.write(f"snapshot-{number:012d}", listing)

    def forget(self, number: int) -> None:
        """Events up to a snapshot, and the snapshots before it."""
        store, _ = self._store()
        for kind, upto in (("events", number), ("parts", number), ("snapshot", number - 1)):
            for n, path in self._names(kind):
                if n <= upto:
                    store.delete_file(path)


class Part(InputPartition):
    def __init__(self, number: int, part: int):
        self.number, self.part = number, part


class EventReader(DataSourceStreamReader):
    def __init__(self, options: dict, clock: Callable[[], float]):
        self.root, self.journal, self.clock = options["path"], Journal(options["state"]), clock
        self.depth = int(options["depth"]) if "depth" in options else None
        self.known = options.get("existing", "created") == "known"

    def initialOffset(self) -> dict:
        if self.known and not self.journal._names("snapshot"):  # what is there at the first start is no event
            self.journal.add(1, listed(self.root, self.depth), [], self.clock())
            return {"snapshot": 1}
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        number, before = self.journal.last()
        after = listed(self.root, self.depth)
        if events := changes(before, after):
            number += 1
            self.journal.add(number, after, events, self.clock())
        elif before.keys() - after.keys():  # what is gone may come again
            number += 1
            self.journal.add(number, after, [], self.clock())
        return {"snapshot": number}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(n, k) for n in range(start["snapshot"] + 1, end["snapshot"] + 1) for k in range(self.journal.read(f"parts-{n:012d}"))]

    def read(self, partition: Part) -> Iterator[tuple]:
        import datetime

        held = self.journal.read(f"events-{partition.number:012d}.{partition.part}")
        ts = datetime.datetime.fromtimestamp(held["ts"], datetime.timezone.utc)
        for row in held["rows"]:
            yield (*row, ts)

    def commit(self, end: dict) -> None:
        self.journal.forget(end["snapshot"])


def register(spark: SparkSession, clock: Callable[[], float] = time.time) -> None:
    """Names the source. Options: ``path``, ``state`` (a folder of this query alone, which all executors share), ``depth``
    (how many levels are watched; all without it), ``existing`` (``known``: what is there at the first start is no event)."""

    class FileEvents(DataSource):
        @classmethod
        def name(cls) -> str:
            return "file_events"

        def schema(self) -> str:
            return EVENT

        def streamReader(self, schema) -> EventReader:
            return EventReader(dict(self.options), clock)

    spark.dataSource.register(FileEvents)
