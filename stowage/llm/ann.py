"""Approximate nearest neighbours by an inverted multi-index.

Vectors, scaled to length 1, are cut into two halves, and each half is quantised by its own k-means codebook (fitted on
a bounded sample); a cell is a pair of centroids. A query walks cells by rising sum of the two distances with a heap
until the cells behind it hold ``share`` of all vectors (``least`` at least), and their entries are reranked by exact
cosine in double precision.

Entries are grouped by first centroid and, where a group is large, by chunks of at most about ``CHUNK`` rows; a query
goes to the groups it walks. A task loads a group's entries and lets its queries stream by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import cut, shuffle_partitions, slices

SAMPLE = 20_000  # rows, in expectation, that codebooks are fitted on
MOST_CENTROIDS = 256  # of a half: at most 65,536 cells
PER_CELL = 64
CHUNK = 1 << 15
LEAST = 2000
SHARE = 0.65
TIE = 1e-9


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector as packed doubles) of rows with an id and a vector of finite numbers, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def matrix(column):
    """Rows of an Arrow list column of equal lengths."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def even(x):
    """Rows scaled by a power of two each, so that no square is lost or infinite; cosines stay the same to the last bit."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0, keepdims=True))[1])


def kmeans(points, k: int, rounds: int = 12):
    """Centroids by Lloyd's algorithm from evenly spread starting points."""
    import numpy as np

    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def distances(points, centres):
    return (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)[None, :]


def nearest(points, centres):
    import numpy as np

    return np.argmin(distances(points, centres), axis=1)


class Codebooks:
    def __init__(self, first, second, population):
        self.first, self.second, self.population = first, second, population

    def walk(self, a, b, enough: int) -> Iterator[tuple[int, int]]:
        """Cells by rising a[i] + b[j] (distances to the two halves' centroids) until they hold ``enough`` vectors."""
        import numpy as np

        by_a, by_b = np.argsort(a), np.argsort(b)
        heap, seen, held = [(float(a[by_a[0]] + b[by_b[0]]), 0, 0)], {(0, 0)}, 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(by_a[i]), int(by_b[j])
            if self.population[cell]:
                held += int(self.population[cell])
                yield cell
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(by_a) and j < len(by_b) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (float(a[by_a[i]] + b[by_b[j]]), i, j))


def fit_codebooks(vectors: DataFrame, total: int, sample_rows: int = SAMPLE):
    """(first, second): codebooks of the two halves, with a number of centroids that follows ``total``."""
    import numpy as np

    span = 1 << 30
    share = min(span, span * sample_rows // max(total, 1))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(span)) < share).orderBy("vec_id").toPandas()
    if not len(rows):
        rows = vectors.orderBy("vec_id").limit(1).toPandas()
    x = even(np.array(rows["vector"].tolist(), float))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = int(min(MOST_CENTROIDS, len(x), max(2, round((total / PER_CELL) ** 0.5))))
    half = (x.shape[1] + 1) // 2
    return kmeans(x[:, :half], k), kmeans(x[:, half:], k)


def search(rows: DataFrame, is_query, k: int = 5, share: float = SHARE, least: int = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by cosine, among all rows but its own.

    Rows with a null id, or a vector that is null, zero, or holds null or non-finite numbers take no part; any finite
    numbers will do, however small or large. Vectors are compared with those of their own length, each length having an
    index. Ties go to the smaller id; rows that repeat an id count once each, and none of a query's own id is found. A
    query with fewer candidates returns all of them; an empty table returns no rows.
    """
    vectors = valid_vectors(rows, id_col, vector_col)
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = vectors.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()
    for at, r in enumerate(lengths):
        own = _search(vectors.where(F.size("vector") == r["n"]), r["count"], is_query, k, share, least)
        found = own if at == 0 else found.unionByName(own)
    return found


def _search(vectors: DataFrame, total: int, is_query, k: int, share: float, least: int) -> DataFrame:
    """``search`` among ``total`` vectors of one length."""
    import numpy as np
    import pyarrow as pa

    rows, out_schema = vectors, "query_id long, vec_id long, score double"
    first, second = fit_codebooks(vectors, total)
    half = first.shape[1]
    cells = len(second)
    books = rows.sparkSession.sparkContext.broadcast((first, second))

    def units(batch):
        x = even(matrix(batch.column("vector")))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def assign(batches) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in slices(batches, 2048):
            x = units(batch)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(nearest(x[:, :half], one), pa.int32()), pa.array(nearest(x[:, half:], two), pa.int32())], ["vec_id", "vector", "c1", "c2"])

    index = cut(vectors.mapInArrow(assign, "vec_id long, vector array<double>, c1 int, c2 int"))
    population = np.zeros((len(first), cells), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():
        population[r["c1"], r["c2"]] = r["count"]
    chunks = np.maximum(1, -(-population.sum(1) // CHUNK))
    enough = max(least, int(np.ceil(share * total)))
    plan = rows.sparkSession.sparkContext.broadcast((population, chunks))

    def walks(batches) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        population, chunks = plan.value
        codebooks = Codebooks(one, two, population)
        for batch in slices(batches, 256):
            x = units(batch)
            da, db = distances(x[:, :half], one), distances(x[:, half:], two)
            row, group, chunk, walked = [], [], [], []
            for i in range(len(x)):
                own: dict[int, np.ndarray] = {}
                for c1, c2 in codebooks.walk(da[i], db[i], enough):
                    own.setdefault(c1, np.zeros(cells, bool))[c2] = True
                for c1, members in own.items():
                    for part in range(chunks[c1]):
                        row.append(i)
                        group.append(c1)
                        chunk.append(part)
                        walked.append(np.packbits(members).tobytes())
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("vector").take(take), pa.array(group, pa.int32()), pa.array(chunk, pa.int32()), pa.array(walked, pa.binary())], ["vec_id", "vector", "c1", "chunk", "cells"])

    queries = index.where(is_query(F.col("vec_id"))).select("vec_id", "vector").mapInArrow(walks, "vec_id long, vector array<double>, c1 int, chunk int, cells binary")
    parts = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("c1") + 1)
    entries = index.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(9)), parts).cast("int"))
    both = entries.select("c1", "chunk", F.lit(0).alias("kind"), "vec_id", "vector", "c2", F.lit(None).cast("binary").alias("cells")).unionByName(queries.select("c1", "chunk", F.lit(1).alias("kind"), "vec_id", "vector", F.lit(None).cast("int").alias("c2"), "cells"))
    dealt = both.repartition(shuffle_partitions(rows.sparkSession), "c1", "chunk").sortWithinPartitions("c1", "chunk", "kind")

    def rerank(batches) -> Iterator[pa.RecordBatch]:
        key, ids, x, norms, c2, waiting = None, None, None, None, None, []

        def loaded():
            nonlocal ids, x, norms, c2, waiting
            if waiting:
                ids = np.concatenate([w[0] for w in waiting])
                order = np.argsort(ids, kind="stable")
                ids, x, c2 = ids[order], np.concatenate([w[1] for w in waiting])[order], np.concatenate([w[2] for w in waiting])[order]
                norms, waiting = np.sqrt((x * x).sum(1)), []

        for batch in slices(batches, 512):
            c1, chunk, kind = (batch.column(c).to_numpy() for c in ("c1", "chunk", "kind"))
            cuts = np.flatnonzero(np.append(True, (c1[1:] != c1[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(c1))):
                part = batch.slice(lo, hi - lo)
                if (c1[lo], chunk[lo]) != key:
                    key, ids, waiting = (c1[lo], chunk[lo]), None, []
                if kind[lo] == 0:
                    waiting.append((part.column("vec_id").to_numpy(), even(matrix(part.column("vector"))), part.column("c2").to_numpy(zero_copy_only=False).astype(int)))
                    continue
                loaded()
                if ids is None:
                    continue
                query, q = part.column("vec_id").to_numpy(), even(matrix(part.column("vector")))
                lengths = np.sqrt((q * q).sum(1))
                walked = np.unpackbits(np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, :cells].astype(bool)
                found = []
                for at in range(0, len(q), 64):
                    rough = (q[at : at + 64] @ x.T) / (lengths[at : at + 64, None] * norms[None, :])
                    rough[~walked[at : at + 64][:, c2]] = -np.inf
                    rough[query[at : at + 64, None] == ids[None, :]] = -np.inf
                    for i, scores in enumerate(rough, at):
                        if len(scores) > k:
                            near = np.flatnonzero(scores >= max(np.partition(scores, -k)[-k] - TIE, -2))
                        else:
                            near = np.flatnonzero(scores > -np.inf)
                        exact = (x[near] * q[i]).sum(1) / (norms[near] * lengths[i])
                        best = np.lexsort((ids[near], -exact))[:k]
                        found += [(query[i], ids[near][b], exact[b]) for b in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    scored = dealt.mapInArrow(rerank, out_schema)
    # Each task lets go of all but a query's k best before rows meet.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
