"""A paged service as a data source: its pages are read by tasks, under one budget of requests, through a cache of pages.

``register(spark)`` names the source ``pages``. Its partitions are streams of pages: of n streams, the k-th reads pages k,
k + n, and so on, each at an n-th of the rate and starting an n-th of the pace after the one before. So all streams
together keep within the budget however many of them run at a time, with nothing to agree on. Only the number of pages,
which the first one tells, is known to the driver.

Each page goes to the cache as a file of its own, written under another name and moved when whole. A task that is run
again finds the pages it had, and asks only for those that are missing.
"""

from __future__ import annotations

import datetime
import email.utils
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, InputPartition

ROW = "page int, place int, release string"

#: Status, headers and body of a request by URL and headers.
Fetch = Callable[[str, dict], tuple[int, dict, bytes]]


class FetchError(Exception):
    """A page that can't be had."""


def fetch_url(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()
    except urllib.error.URLError as e:
        raise FetchError(f"{url}: {e.reason}") from e


def wait_for(headers: dict, now: float, most: float = 300.0, fallback: float = 60.0) -> float:
    """Seconds that a refusal asks to wait: a number, or a date; from 0 to ``most``, the fallback if it is neither."""
    said = next((str(v).strip() for k, v in headers.items() if k.lower() == "retry-after"), "")
    try:
        seconds = float(said)
    except ValueError:
        try:
            when = email.utils.parsedate_to_datetime(said)
        except (TypeError, ValueError):
            return fallback
        seconds = (when if when.tzinfo else when.replace(tzinfo=datetime.timezone.utc)).timestamp() - now
    return max(0.0, min(most, seconds)) if seconds == seconds else fallback


class PageCache:
    """Pages as files ``{fetched_utc, pages, releases}`` in a folder of any store that Arrow reaches; no folder, no cache."""

    def __init__(self, folder: str | None):
        self.folder = folder

    def _at(self, page: int):
        import pyarrow.fs as pafs

        store, base = pafs.FileSystem.from_uri(self.folder)
        return store, f"{base}/page-{page:08d}.json"

    def read(self, page: int, now: float, ttl_hours: float | None) -> dict | None:
        """The page if it is there, whole, and not older than ``ttl_hours``; None as an age means any."""
        if not self.folder:
            return None
        store, path = self._at(page)
        try:
            with store.open_input_stream(path) as f:
                held = json.loads(f.read())
            fresh = ttl_hours is None or now - float(held["fetched_utc"]) <= ttl_hours * 3600
            return held if fresh and isinstance(held["releases"], list) else None
        except (FileNotFoundError, ValueError, KeyError, TypeError):
            return None

    def write(self, page: int, now: float, pages: int, releases: list) -> None:
        if self.folder:
            store, path = self._at(page)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(json.dumps({"fetched_utc": now, "pages": pages, "releases": releases}).encode())
            store.move(part, path)


class Streamed(InputPartition):
    def __init__(self, first: int, step: int, pages: int):
        self.first, self.step, self.pages = first, step, pages


class PageReader(DataSourceReader):
    """Options: ``url`` with ``{page}``, ``token``, ``userAgent``, ``cache`` (a folder all executors share), ``ttlHours``,
    ``mode`` (``fresh``: the cache while it is fresh; ``refresh``: not at all; ``cached``: at any age, and no request),
    ``requestsPerMinute``, ``streams``, ``attempts``."""

    def __init__(self, options: dict, fetch: Fetch, sleep: Callable[[float], None], clock: Callable[[], float]):
        self.fetch, self.sleep, self.clock = fetch, sleep, clock
        options = CaseInsensitiveDict(options)  # Spark lower-cases their names
        self.url, self.cache = options.get("url", ""), PageCache(options.get("cache"))
        self.mode = options.get("mode", "fresh")
        if self.mode not in ("fresh", "refresh", "cached"):
            raise ValueError(f"unknown mode {self.mode!r}; known: cached, fresh, refresh")
        self.ttl = None if self.mode == "cached" else float(options.get("ttlHours", 24))
        self.headers = {"Accept": "application/json", "User-Agent": options.get("userAgent", "stowage")} | ({"Authorization": f"token {t}"} if (t := options.get("token")) else {})
        # A little more than the limit apart.
        self.pace = 60 / float(options.get("requestsPerMinute", 60 if options.get("token") else 25)) * 1.1
        self.streams, self.attempts = int(options.get("streams", 4)), int(options.get("attempts", 4))

    def _ask(self, page: int) -> tuple[list, int]:
        """Releases of a page and the number of pages; what refuses by rate is asked again when it says so."""
        url = self.url.replace("{page}", str(page))
        for attempt in range(self.attempts):
            status, headers, body = self.fetch(url, self.headers)
            if status == 200:
                try:
                    held = json.loads(body)
                    releases, pages = held.get("releases") or [], int((held.get("pagination") or {}).get("pages") or 1)
                except (ValueError, AttributeError) as e:
                    raise FetchError(f"{url} is no page: {e}") from e
                self.cache.write(page, self.clock(), pages, releases)
                return releases, pages
            if status == 404:
                raise FetchError(f"{url}: there is no such collection, or it is private")
            if status in (401, 403):
                raise FetchError(f"{url}: refused; a private collection needs a token")
            if status != 429:
                raise FetchError(f"{url}: HTTP {status}")
            if attempt + 1 < self.attempts:
                self.sleep(wait_for(headers, self.clock()))
        raise FetchError(f"{url}: still over the rate limit after {self.attempts} requests")

    def partitions(self) -> list[Streamed]:
        held = None if self.mode == "refresh" else self.cache.read(1, self.clock(), self.ttl)
        if held is None and self.mode == "cached":
            return [Streamed(1, 1, 0)]
        pages = int(held["pages"]) if held else self._ask(1)[1]
        n = max(1, min(self.streams, pages))
        return [Streamed(k, n, pages) for k in range(1, n + 1)]

    def read(self, partition: Streamed) -> Iterator[tuple]:
        last = self.clock() + self.pace * (partition.first - 1 - partition.step)  # the first request of a stream waits its turn
        for page in range(partition.first, partition.pages + 1, partition.step):
            # The first page was asked for when the pages were counted.
            held = self.cache.read(page, self.clock(), self.ttl) if self.mode != "refresh" or page == 1 else None
            if held is not None:
                releases = held["releases"]
            elif self.mode == "cached":
                continue
            else:
                self.sleep(max(0.0, last + self.pace * partition.step - self.clock()))
                last = self.clock()
                releases, _ = self._ask(page)
            for place, release in enumerate(releases):
                yield page, place, json.dumps(release)


def register(spark: SparkSession, name: str = "pages", fetch: Fetch = fetch_url, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> None:
    """Names the source for the session. What it asks and how it waits may be replaced; tasks get them by value."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROW

        def reader(self, schema) -> PageReader:
            return PageReader(dict(self.options), fetch, sleep, clock)

    spark.dataSource.register(Pages)


def releases(spark: SparkSession, per_page: int = 100, name: str = "pages", **options: object) -> DataFrame:
    """Releases (the columns of a release, ``ordinal``) of all pages; ``ordinal`` is the place in the whole collection."""
    from stowage.functions.releases import RELEASE

    rows = spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load()
    place = (F.col("page").cast("long") - 1) * per_page + F.col("place")
    return rows.select(place.alias("ordinal"), F.from_json("release", RELEASE).alias("r")).select("ordinal", "r.*")
