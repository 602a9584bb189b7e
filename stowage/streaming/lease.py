"""A lease of one run at a time, with a fencing token and a heartbeat, as files of any store that Spark reaches.

The lock file is there while a run holds the lease, and its modification time is the run's heartbeat. Each run that takes
the lease creates the next number of a row of token files, which only one can; so of those that find a stale lock,
one goes on. A run that lives is never robbed, however long it takes. One that stalled and was robbed is told by
``check``, which anything that must not be done twice calls first: a higher token than its own is there.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import SparkSession

BEAT_SECONDS = 30.0


class Fenced(RuntimeError):
    """The lease has gone to another run."""


class Store:
    """The few steps on files that a lease and a replaced document need, each atomic where the store is."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(self.path)

    def at(self, suffix: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path.toString() + suffix)

    def create_new(self, path) -> bool:
        """Whether the file was made by this call. Hadoop's local file system looks first and creates then, so that one is
        asked directly."""
        if path.toUri().getScheme() == "file":
            try:
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        try:
            self.fs.create(path, False).close()
        except Exception as e:
            if "AlreadyExists" in str(getattr(e, "java_exception", e).__class__) or self.fs.exists(path):
                return False
            raise
        return True

    def write(self, path, data: bytes) -> None:
        out = self.fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, path) -> bytes | None:
        try:
            stream = self.fs.open(path)
        except Exception as e:
            if not self.fs.exists(path):
                return None
            raise e
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def touched(self, path) -> float | None:
        return self.fs.getFileStatus(path).getModificationTime() / 1000 if self.fs.exists(path) else None

    def replace(self, source, target) -> None:
        """The source takes the target's place in one step."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(source, target, options)

    def numbers(self) -> dict[int, bool]:
        """Tokens that are there, and whether each was given back."""
        found, prefix = {}, self.path.getName() + "."
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path.getParent())]
        for name in names:
            if name.startswith(prefix) and name[len(prefix) :].isdigit():
                found[int(name[len(prefix) :])] = f"{name}.done" in names
        return found


class Lease:
    """Whether a run holds the lease (its truth), and the token it holds it by."""

    def __init__(self, store: Store, token: int | None):
        self.store, self.token = store, token

    def __bool__(self) -> bool:
        return self.token is not None

    def check(self) -> int:
        """The token, if it is still the highest; an error if another run has taken over."""
        if self.token is None or max(self.store.numbers(), default=0) != self.token:
            raise Fenced(f"{self.store.path} is held by another run")
        return self.token

    def beat(self) -> None:
        self.check()
        self.store.fs.setTimes(self.store.path, int(time.time() * 1000), -1)

    def release(self) -> None:
        try:
            self.check()
        except Fenced:
            return
        self.store.create_new(self.store.at(f".{self.token}.done"))
        self.store.fs.delete(self.store.path, False)
        for n in self.store.numbers():
            if n < self.token:
                self.store.fs.delete(self.store.at(f".{n}"), False)
                self.store.fs.delete(self.store.at(f".{n}.done"), False)


def acquire(spark: SparkSession, path: str, stale_seconds: float | None = None) -> Lease:
    """The lease at a path, held or not; without ``stale_seconds`` a lock is never taken over."""
    store = Store(spark, path)
    store.fs.mkdirs(store.path.getParent())
    tokens = store.numbers()
    last = max(tokens, default=0)
    beats = [store.touched(store.path)]
    if last and not tokens[last]:  # its run may not have written the lock yet
        beats.append(store.touched(store.at(f".{last}")))
    latest = max((b for b in beats if b is not None), default=None)
    if latest is not None and (stale_seconds is None or time.time() - latest <= stale_seconds):
        return Lease(store, None)
    if not store.create_new(store.at(f".{last + 1}")):
        return Lease(store, None)
    lease = Lease(store, last + 1)
    store.write(store.path, str(last + 1).encode())
    return lease


@contextmanager
def single_flight(spark: SparkSession, path: str, stale_seconds: float | None = None) -> Iterator[Lease]:
    """A lease that is true while this run holds it. A run that finds it held gets a false one and should do nothing."""
    lease, over = acquire(spark, path, stale_seconds), threading.Event()
    every = min(BEAT_SECONDS, stale_seconds / 4) if stale_seconds else BEAT_SECONDS

    def beating() -> None:
        while not over.wait(every):
            try:
                lease.beat()
            except Fenced:
                return
            except Exception:  # a beat that fails is one beat missed
                continue

    if lease:
        threading.Thread(target=beating, daemon=True).start()
    try:
        yield lease
    finally:
        over.set()
        if lease:
            lease.release()


class Changed(RuntimeError):
    """A document is not what was read, or is being replaced by another."""


def replace_document(spark: SparkSession, path: str, text: str, read: str | None, stale_seconds: float = 60.0) -> None:
    """Puts a text in a document's place if that still is what was read (None: not there); readers see one or the other.

    The text is written aside and takes the document's place in one step, under a lease. A write that is cut off leaves
    the old document, and what it left aside is in nobody's way.
    """
    with single_flight(spark, f"{path}.lock", stale_seconds) as lease:
        if not lease:
            raise Changed(f"{path} is being replaced")
        store = Store(spark, path)
        held = store.read(store.path)
        if (held.decode() if held is not None else None) != read:
            raise Changed(f"{path} has changed since it was read")
        aside = store.at(f".{uuid.uuid4().hex}.part")
        store.write(aside, text.encode())
        lease.check()
        store.replace(aside, store.path)


def read_document(spark: SparkSession, path: str) -> str | None:
    store = Store(spark, path)
    held = store.read(store.path)
    return None if held is None else held.decode()
