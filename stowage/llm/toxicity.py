"""Toxicity scores from a factorization machine over hashed terms.

A term is a word, or the first four or five bytes of a longer one, hashed to one of ``2 ** BITS`` numbers. Beside a
weight for each term the machine learns a short vector for each, whose inner products weigh pairs of terms (an insult
next to a group's name), which additive weights cannot. It is fitted on at most ``max_rows`` labelled rows and
``max_terms`` terms of them in expectation (rows are chosen by a hash of the id), on all terms that ``MIN_DOCS`` of these
rows have; a weight must gain ``LEAST_Z`` standard errors beside all other weights to leave 0, vectors decay. Scoring is
one pass over all texts.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import crc_mod, cut, slices, worker_state
from stowage.llm.decontam import TO_WORDS

BITS = 20
MIN_DOCS = 4
MAX_ROWS = 16_000  # of the fitting sample
MAX_TERMS = 24_000_000  # of these rows together, four bytes each on the driver
FACTORS = 4
STEPS = 1500
FIRST_STEPS = 1000  # of the weights alone
BATCH = 256
LEAST_Z = 4.5
VECTOR_DECAY = 1e-3
PIECE = 1 << 20


def terms_of(text: bytes | None):
    """The distinct hashed terms of a text, sorted."""
    import numpy as np

    text, words, at = (text or b"").translate(TO_WORDS), set(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        words.update(text[at:end].split())
        at = end
    crc, mask = zlib.crc32, (1 << BITS) - 1
    found = {crc(w) & mask for w in words}
    found.update([crc(w, 4) & mask for w in {w[:4] for w in words if len(w) > 4}])
    found.update([crc(w, 5) & mask for w in {w[:5] for w in words if len(w) > 5}])
    return np.sort(np.fromiter(found, np.int64, len(found)))


class Machine:
    """bias, weights and factor vectors, by place in the sorted array of known terms."""

    def __init__(self, terms, bias, weights, vectors):
        self.terms, self.bias, self.weights, self.vectors = terms, bias, weights, vectors

    def places(self, found):
        import numpy as np

        if not len(self.terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        return at[self.terms[at] == found]

    def score(self, found) -> float:
        import numpy as np

        at = self.places(found)
        v = self.vectors[at]
        s = v.sum(0)
        z = self.bias + self.weights[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum()) / max(len(at), 1)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list, labels, factors: int = FACTORS, steps: int = STEPS, rate: float = 0.1, decay: float = 2e-5, least_z: float = LEAST_Z) -> Machine:
    """A machine fitted by minibatch AdaGrad on log loss; pair terms are averaged over a text's number of terms.

    Weights alone come first, each with a penalty of ``least_z`` standard errors of a term without meaning. Those that
    hold are free of it from then on, and vectors of all terms learn from what weights leave. texts: arrays of hashed
    terms. Without both labels the score is constant, the smoothed share of label 1.
    """
    import numpy as np

    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    terms, count = np.unique(np.concatenate(texts) if texts else np.zeros(0, np.int64), return_counts=True)
    terms, count = terms[count >= MIN_DOCS].astype(np.int64), count[count >= MIN_DOCS]
    rng = np.random.default_rng(7)
    n = len(terms)
    weights, vectors = np.zeros(n), rng.normal(0, 0.05, (n, factors))
    machine = Machine(terms, bias, weights, vectors)
    if n == 0 or y.min() == y.max():
        machine.vectors = np.zeros((n, factors))
        return machine
    rows = [machine.places(t).astype(np.int32) for t in texts]
    known = np.array([len(r) for r in rows])
    penalty = least_z * np.sqrt(share * (1 - share) / count)  # of each of a term's texts
    by_factor = np.ascontiguousarray(vectors.T)
    for paired in (False, True):
        gw, gv = np.full(n, 1e-2), np.full(by_factor.shape, 1e-2)
        for _ in range(-(-(steps if paired else FIRST_STEPS) // -(-len(rows) // BATCH))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                filled = batch[known[batch] > 0]
                machine.bias -= rate * (1 / (1 + np.exp(-machine.bias)) - y[batch[known[batch] == 0]]).sum() / len(batch)
                if not len(filled):
                    continue
                sizes = known[filled]
                idx, own, starts = np.concatenate([rows[i] for i in filled]), np.repeat(np.arange(len(filled)), sizes), np.cumsum(sizes) - sizes
                z = machine.bias + np.add.reduceat(weights[idx], starts)
                if paired:  # factor by factor, as sums along one long axis are fast
                    s = [np.add.reduceat(v[idx], starts) for v in by_factor]
                    z += 0.5 * (sum(x * x for x in s) - np.add.reduceat((by_factor * by_factor).sum(0)[idx], starts)) / sizes
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[filled]
                machine.bias -= rate * error.sum() / len(batch)
                e, seen = error[own], np.bincount(idx, minlength=n)
                touched = np.flatnonzero(seen)
                dw = np.bincount(idx, e, n)[touched] + decay * len(batch) * weights[touched]
                gw[touched] += dw * dw
                step = rate / np.sqrt(gw[touched])
                moved = weights[touched] - step * dw
                weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty[touched] * seen[touched], 0)
                if paired:
                    share_of = error / sizes
                    alone = np.bincount(idx, share_of[own], n)[touched]  # a term is no pair with itself
                    for f in range(factors):
                        v = by_factor[f, touched]
                        dv = np.bincount(idx, (share_of * s[f])[own], n)[touched] - alone * v + VECTOR_DECAY * len(batch) * v
                        gv[f, touched] += dv * dv
                        by_factor[f, touched] = v - rate * dv / np.sqrt(gv[f, touched])
        penalty[weights != 0] = 0
    machine.vectors = np.ascontiguousarray(by_factor.T)
    return machine


def learn(docs: DataFrame, labels: DataFrame, learns, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fits on labelled rows for which ``learns`` (a column over the id) holds; conflicting labels of an id count as 1.

    Terms that fewer than ``MIN_DOCS`` fitting rows have are left out before rows come to the driver. Where the rest are
    more than ``max_terms``, as texts are very long, fewer rows are taken, by the same hash.
    """
    import numpy as np
    import pyarrow as pa

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(learns("_id"))
    total = known.count()
    span = 1 << 30
    share = min(span, span * max_rows // max(total, 1))
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(span))
    sample = known.where(draw < share).groupBy("_id").agg(F.max("_label").alias("_label"))
    # About max_rows rows of an id and a label, whatever the input: small enough to send to all.
    rows = docs.join(F.broadcast(sample), docs[id_col] == sample["_id"]).select("_id", F.col(text_col).cast("string").cast("binary").alias("_text"), "_label")

    def run(batches):
        for batch in slices(batches, 256):
            found = [terms_of(t).astype("<i4").tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.binary()), batch.column("_label")], ["_id", "terms", "label"])

    id_type = rows.schema["_id"].dataType.simpleString()
    fitting = cut(rows.mapInArrow(run, f"_id {id_type}, terms binary, label int"))

    def counted(batches):
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                seen[np.frombuffer(terms.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["term", "n"])

    frequent = fitting.mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).toArrow()  # at most 2 ** BITS
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.column("term").to_numpy()))
    total_terms = int(frequent.column("n").to_numpy().sum())

    def kept(batches):
        for batch in batches:
            found = []
            for terms in batch.column("terms"):
                own = np.frombuffer(terms.as_buffer(), "<i4")
                found.append(own[np.isin(own, shared.value, assume_unique=True)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.binary()), batch.column("label")], ["_id", "terms", "label"])

    if total_terms > max_terms:
        fitting = fitting.where(draw < share * max_terms // total_terms)
    got = fitting.mapInArrow(kept, f"_id {id_type}, terms binary, label int").toArrow().sort_by([("_id", "ascending"), ("terms", "ascending")])
    return fit([np.frombuffer(t.as_buffer(), "<i4") for t in got.column("terms")], [int(label > 0) for label in got.column("label").to_pylist()])


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): a row for each row. Null and empty texts have the score of a text without known terms."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((machine.terms, machine.bias, machine.weights, machine.vectors))
    name = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        own = worker_state("toxicity", "machine", name, lambda: Machine(*shared.value))
        for batch in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(terms_of(t)) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns where crc32 of the id modulo ``folds`` is not 0.

    Documents of null id are scored, never learnt from, and not held out. Labels of null id or value are left out.
    """
    machine = learn(docs, labels, lambda c: crc_mod(c, folds) != 0)
    scored = score_documents(docs, machine)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
