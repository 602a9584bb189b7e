"""WARC archives with payload dedup, and an index built by external merging of sorted capture runs.

Writers put each record into a gzip member of a segment file in a shared folder. Captures are sorted by URL key and
timestamp, ``RUN_ROWS`` at a time, and written beside the segments as runs: blocks of ``BLOCK_ROWS`` sorted rows, each
with its first and last key in a sparse index. While there are more than ``FAN_IN`` runs, a pass merges them in groups
into longer ones; the last pass merges all. The tasks of a pass are (group, range of keys): each reads only the blocks
that reach into its range, one block of each run at a time, so that a loser tree over ``FAN_IN`` buffers is all that it
holds, and a host of any weight spreads over ranges. Ranges in order make one globally ordered capture history. Reading
goes through the segments member by member, checks digests, and joins the captures by file and offset.

Files are written under another name first and moved when whole, with the attempt in their name: what a lost executor
leaves behind is in no index.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, remove, shared_dir, shuffle_partitions, slices, small_batches

SEGMENT = 64 << 20
LEAST_REVISIT = 1000  # bytes of a payload that is worth a revisit record
BLOCK = 1 << 20
RUN_ROWS = 50_000  # captures that a writer sorts at one time
BLOCK_ROWS = 1024  # captures of a run's block: what a merge holds of each run
FAN_IN = 128  # runs that a task merges
LEAST_RANGE, MOST_RANGE = 2048, 1_000_000  # captures of a task's range
BROADCAST = 100_000  # repeated digests, of about 60 bytes, that are sent to all
SALTS = 32
FIRST = datetime.datetime(2020, 1, 1)


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, lower case, without scheme, user, default port and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return "-)" + (url or "").strip().lower()
    head = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{head or '-'}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def stamp(number: int | None) -> str:
    """A 14-digit capture time: the captures of a crawl are a second apart by id."""
    return (FIRST + datetime.timedelta(seconds=(number or 0) % (1 << 31))).strftime("%Y%m%d%H%M%S")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, compressed as one gzip member. Revisits carry no payload, but its length and digest."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    when = datetime.datetime.strptime(stamp(page_id), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode()
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head + body + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file."""
    at, data = 0, b""
    while True:
        if not data and not (data := stream.read(BLOCK)):
            return
        unpacker, content, size = zlib.decompressobj(31), [], 0
        while True:
            content.append(unpacker.decompress(data))
            size += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
            if unpacker.eof:
                break
            if not (data := stream.read(BLOCK)):
                raise ValueError(f"the member at {at} is cut off")
        yield at, size, b"".join(content)
        at += size


def parsed(content: bytes) -> dict:
    """A record's fields; a response's digest and length are taken from the payload, and must be those it states."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    digest, size = fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        body = rest[: int(fields["Content-Length"])]
        if hashlib.sha1(body).hexdigest() != digest or len(body) != size:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its record says")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None}


class LoserTree:
    """K-way merge: inner nodes keep the losers, so that each item costs one path of comparisons to the root."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.head = [next(r, None) for r in self.runs] + [None] * (self.k - len(self.runs))
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.loser[node] < 0 and building:
                self.loser[node] = winner
                return
            if self._before(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while (top := self.head[self.loser[0]]) is not None:
            yield top
            winner = self.loser[0]
            self.head[winner] = next(self.runs[winner], None)
            self._play(winner)


def repeated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(payload_digest, refers_to): payloads of at least ``least`` bytes that several ids have, and the largest of these.

    Payloads are equal if their SHA-1 is. Null ids count for nothing.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    ids = pages.where("page_id is not null").select("page_id", F.sha1(payload).alias("payload_digest"), F.length(payload).alias("size")).where(F.col("size") >= least)
    return ids.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("smallest")).where("refers_to > smallest").drop("smallest")


def decided(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (page_id, payload_digest, ...) with ``refers_to``, null for responses: of rows that repeat with the largest id
    all are responses, and so are those of null id.

    Payloads stay where they are while the repeated digests are few enough to send to all; beyond that, digests meet in
    salted parts, as one payload may be that of most pages.
    """
    if known.count() <= BROADCAST:
        joined = rows.join(F.broadcast(known), "payload_digest", "left")
    else:
        parts = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(parts, ["payload_digest", "_salt"], "left").drop("_salt")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("refers_to"), F.col("refers_to")))


#: A capture, as a tuple that sorts by URL key, timestamp and id (null first), then place.
Capture = tuple[str, str, bool, int, str, int, int]
CAPTURE = "url_key string, captured string, page_id long, segment string, offset long, length long"
KEY = "struct<url_key:string,captured:string,has_id:boolean,id:long>"
BLOCKS = f"run long, file string, at long, bytes long, captures long, first {KEY}, last {KEY}"


def captures_batch(rows: list[Capture]):
    import pyarrow as pa

    columns = zip(*((k, c, i if has else None, s, o, n) for k, c, has, i, s, o, n in rows))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], [c.split()[0] for c in CAPTURE.split(", ")])


def captures_of(batch) -> list[Capture]:
    return [(k, c, i is not None, i or 0, s, o, n) for k, c, i, s, o, n in zip(*(batch.column(j).to_pylist() for j in range(6)))]


def described(blocks: list[tuple]):
    import pyarrow as pa

    key = lambda k: dict(zip(("url_key", "captured", "has_id", "id"), k))
    kind = pa.struct([("url_key", pa.string()), ("captured", pa.string()), ("has_id", pa.bool_()), ("id", pa.int64())])
    columns = list(zip(*blocks))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:5]), *(pa.array(map(key, c), kind) for c in columns[5:])], ["run", "file", "at", "bytes", "captures", "first", "last"])


class RunWriter:
    """Writes sorted captures to a file as compressed blocks; ``blocks`` describes them once it is closed."""

    def __init__(self, store, folder: str, name: str, run: int):
        self.store, self.path, self.name, self.run = store, f"{folder}/{name}", name, run
        self.stream, self.waiting, self.blocks, self.at = store.open_output_stream(f"{self.path}.part", compression=None), [], [], 0

    def add(self, capture: Capture) -> None:
        self.waiting.append(capture)
        if len(self.waiting) >= BLOCK_ROWS:
            self._write()

    def _write(self) -> None:
        import pyarrow as pa

        batch, sink = captures_batch(self.waiting), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        data = sink.getvalue()
        self.stream.write(data)
        self.blocks.append((self.run, self.name, self.at, data.size, len(self.waiting), self.waiting[0][:4], self.waiting[-1][:4]))
        self.at, self.waiting = self.at + data.size, []

    def close(self) -> list[tuple]:
        if self.waiting:
            self._write()
        self.stream.close()
        self.store.move(f"{self.path}.part", self.path)
        return self.blocks


def read_blocks(store, folder: str, blocks: list[tuple[str, int, int]], low: tuple | None, high: tuple | None) -> Iterator[Capture]:
    """The captures of a run's blocks (file, at, bytes), in order, with low <= key < high; one block is held at a time."""
    import pyarrow as pa

    for file, at, size in blocks:
        with store.open_input_file(f"{folder}/{file}") as stream:
            data = stream.read_at(size, at)
        for batch in pa.ipc.open_stream(data):
            for c in captures_of(batch):
                if (low is None or c[:4] >= low) and (high is None or c[:4] < high):
                    yield c


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) to segments, and their captures to sorted runs, under ``folder``.

    Returns the runs' sparse index (``BLOCKS``). A null html is an empty payload; null URLs have the key ``-)/``.
    """
    import pyarrow as pa
    import pyarrow.fs as pafs

    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    rows = decided(rows, cut(repeated(pages, least)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = f"{part:06d}-{TaskContext.get().taskAttemptId()}"
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        stream, captures, at, segment, runs = None, [], 0, 0, 0

        def sorted_run() -> pa.RecordBatch:
            nonlocal captures, runs
            writer, runs = RunWriter(store, path, f"{own}-{runs:04d}.run", part << 24 | runs), runs + 1
            for capture in sorted(captures):
                writer.add(capture)
            captures = []
            return described(writer.close())

        def whole_segment() -> None:
            stream.close()
            store.move(f"{path}/{name}.part", f"{path}/{name}")

        for batch in slices(batches, 256):
            for page_id, digest, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "payload_digest", "url", "payload", "refers_to"))):
                if stream is None:
                    name, at = f"{own}-{segment:04d}.warc.gz", 0
                    stream = store.open_output_stream(f"{path}/{name}.part", compression=None)
                data = record(page_id, url, payload, digest, refers_to)
                stream.write(data)
                captures.append((url_key(url), stamp(page_id), page_id is not None, page_id or 0, name, at, len(data)))
                at += len(data)
                if at >= SEGMENT:
                    whole_segment()
                    stream, segment = None, segment + 1
                if len(captures) >= RUN_ROWS:
                    yield sorted_run()
        if stream is not None:
            whole_segment()
        if captures:
            yield sorted_run()

    return rows.mapInArrow(run, BLOCKS)


def boundaries(blocks: DataFrame, ranges: int) -> list[tuple]:
    """``ranges - 1`` keys that cut the captures into about equal parts, from a bounded sample of blocks' first keys."""
    span, n = 1 << 30, blocks.count()
    share = min(span, span * 20 * ranges // max(n, 1))
    found = blocks.where(F.pmod(F.xxhash64("file", "at", F.lit(13)), F.lit(span)) < share).select("first.*", F.col("captures")).collect()
    keys = sorted((tuple(r)[:4], r["captures"]) for r in found)
    total, cuts, held = sum(n for _, n in keys), [], 0
    for key, n in keys:
        if held >= total * (len(cuts) + 1) / ranges and len(cuts) < ranges - 1 and (not cuts or cuts[-1] < key):
            cuts.append(key)
        held += n
    return cuts


def merge_pass(blocks: DataFrame, folder: str, groups: int, captures: int, last: bool) -> DataFrame:
    """Merges the runs of each of ``groups`` groups: into runs again, or (``last``) to captures with ``range`` and ``place``."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    spark = blocks.sparkSession
    ranges = max(1, min(-(-captures // LEAST_RANGE), max(-(-shuffle_partitions(spark) // groups), -(-captures // (groups * MOST_RANGE)))))
    cuts = boundaries(blocks, ranges) if ranges > 1 else []
    shared = spark.sparkContext.broadcast(cuts)  # a key for each task
    key = lambda c: F.struct(f"{c}.url_key", f"{c}.captured", f"{c}.has_id", f"{c}.id")
    group = F.lit(0).cast("long") if groups == 1 else F.pmod(F.xxhash64("run"), F.lit(groups))

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = [[bisect.bisect_right(shared.value, tuple(k.values())) for k in batch.column(c).to_pylist()] for c in ("first", "last")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "run", "file", "at", "bytes", "first")), *(pa.array(r, pa.int32()) for r in reach)], ["group", "run", "file", "at", "bytes", "first", "lo", "hi"])

    placed = blocks.select(group.alias("group"), "run", "file", "at", "bytes", key("first").alias("first"), key("last").alias("last")).mapInArrow(place, f"group long, run long, file string, at long, bytes long, first {KEY}, lo int, hi int")
    dealt = placed.select("group", F.explode(F.sequence("lo", "hi")).alias("range"), "run", "file", "at", "bytes", "first").withColumn("task", F.col("group") * (len(cuts) + 1) + F.col("range"))
    dealt = dealt.repartition(max(1, min(groups * (len(cuts) + 1), 100_000)), "task").sortWithinPartitions("task", "run", "first", "file", "at")

    def tasks(batches) -> Iterator[tuple[int, int, dict]]:
        """(group, range, blocks by run) one after the other."""
        now, runs = None, {}
        for batch in batches:
            for g, r, run, file, at, size in zip(*(batch.column(c).to_pylist() for c in ("group", "range", "run", "file", "at", "bytes"))):
                if now is not None and now != (g, r):
                    yield *now, runs
                    runs = {}
                now = g, r
                runs.setdefault(run, []).append((file, at, size))
        if now is not None:
            yield *now, runs

    def merge(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = pafs.FileSystem.from_uri(folder)
        for g, r, runs in tasks(batches):
            low, high = cuts_at(r - 1), cuts_at(r)
            tree = LoserTree([read_blocks(store, path, b, low, high) for b in runs.values()])
            if not last:
                writer = RunWriter(store, path, f"merged-{uuid.uuid4().hex}-{TaskContext.get().taskAttemptId()}.run", g)
                for capture in tree:
                    writer.add(capture)
                if found := writer.close():
                    yield described(found)
                continue
            out, at = [], 0
            for capture in tree:
                out.append(capture)
                if len(out) == 4 * BLOCK_ROWS:
                    yield ranked(out, r, at)
                    out, at = [], at + len(out)
            if out:
                yield ranked(out, r, at)

    def cuts_at(i: int) -> tuple | None:
        return shared.value[i] if 0 <= i < len(shared.value) else None

    def ranked(rows: list[Capture], r: int, at: int) -> pa.RecordBatch:
        batch = captures_batch(rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([r] * len(rows), pa.int32()), pa.array(range(at, at + len(rows)), pa.int64())], [*batch.schema.names, "range", "place"])

    return dealt.mapInArrow(merge, CAPTURE + ", range int, place long" if last else BLOCKS)


def merge_runs(blocks: DataFrame, folder: str) -> DataFrame:
    """The captures in global order: by ``range``, then ``place``. Ties go by id (null first), then segment and offset.

    ``blocks`` must be stable (written or checkpointed). A pass merges ``FAN_IN`` runs a group on average, so a task
    holds that many blocks; each pass but the last writes its runs to ``folder``.
    """
    while True:
        runs, captures = blocks.agg(F.count_distinct("run"), F.coalesce(F.sum("captures"), F.lit(0))).first()
        if runs <= FAN_IN:
            return merge_pass(blocks, folder, 1, captures, last=True)
        blocks = cut(merge_pass(blocks, folder, -(-runs // FAN_IN), captures, last=False))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index's segments: page_id, payload_bytes, payload_digest, record_type, refers_to, range, place."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    # A list of files looks small, but what is read from them is not: deal them out (by a key of its own, else the
    # partitions of distinct serve, which are coalesced by their bytes), and broadcast neither side.
    files = index.select("segment").distinct().repartition(shuffle_partitions(index.sparkSession), F.xxhash64("segment"))
    names = ["segment", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("segment").to_pylist():
                out = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for offset, _, content in members(stream):
                        out.append({"segment": name, "offset": offset} | parsed(content))
                        if len(out) == 4096:
                            yield packed(out)
                            out = []
                if out:
                    yield packed(out)

    def packed(rows) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds)], names)

    records = files.mapInArrow(run, "segment string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return records.hint("merge").join(index.select("segment", "offset", "range", "place"), ["segment", "offset"]).drop("segment", "offset")


def archive_round_trip(pages: DataFrame, keep: bool = False) -> DataFrame:
    """Pages written, indexed and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, range, place.

    A row for each row of ``pages``, repeated ones and those of null id included; an empty table has no rows. The
    archives lie in a new folder beside the checkpoints and go once they are read back, unless ``keep``.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if ":" not in folder:
        folder = "file://" + folder
    index = cut(merge_runs(cut(write_archives(pages, folder)), folder))
    if keep:
        return read_archives(index, folder)
    found = cut(read_archives(index, folder))
    remove(spark, folder)
    return found
