"""Language ID by mixture inference: EM over n-gram likelihoods, language set by penalised likelihood.

A text is a draw of letter n-grams (two and three, with word boundaries) from a mixture of languages. Expectation-
maximisation finds the proportions; languages join the set, best first, while the likelihood they add outweighs
``PENALTY`` times the logarithm of the number of n-grams each. The label is the language of the largest proportion.

Probabilities come from n-gram counts of at most ``max_docs`` labelled texts a language in expectation (chosen by a
hash of the id), so the model has a fixed size per language; prediction is one pass over all texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import crc_mod, slices, worker_state

BUCKETS = 1 << 14  # for each of the two orders
MAX_DOCS = 3000
SMOOTH = 0.5
PENALTY = 4.0
ROUNDS = 12
PIECE = 1 << 18
TEMPER = 2  # orders that count each letter

UNKNOWN = "und"


def _letters():
    """A table from code point to letter class: 0 for what is not a letter."""
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None):
    """(buckets, counts) of the letter n-grams of a text, or None if it has no letters; read piece by piece, counted as one."""
    import numpy as np

    letter = worker_state("langid", "letters", None, _letters)
    total, tail, text = None, np.zeros(1, np.uint32), text or ""
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        c = np.concatenate([tail, np.where(letter[c], c, 0), np.zeros(int(at + PIECE >= len(text)), np.uint32)]).astype(np.uint32)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)  # a word edge once, across pieces too
        keep[: len(tail)] = True
        c = c[keep]
        tail = c[-2:]
        if len(c) < 3:
            continue
        two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
        real = (c[:-2] != 0) | (c[1:-1] != 0) | (c[2:] != 0)
        n = np.bincount((two[:-1][real] ^ two[:-1][real] >> np.uint32(15)) % BUCKETS, minlength=2 * BUCKETS)
        n += np.bincount((three[real] ^ three[real] >> np.uint32(15)) % BUCKETS + BUCKETS, minlength=2 * BUCKETS)
        total = n if total is None else total + n
    if total is None:
        return None
    found = np.flatnonzero(total)
    return (found, total[found].astype(float)) if len(found) else None


class Mixture:
    """Languages and each bucket's probability in them, scaled to mean 1."""

    def __init__(self, languages: list[str], counts):
        import numpy as np

        self.languages = languages
        smooth = np.asarray(counts, float) + SMOOTH
        for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
            smooth[:, half] /= smooth[:, half].mean(1, keepdims=True)
        self.p = np.ascontiguousarray(smooth.T)

    def proportions(self, p, n, start, rounds: int = ROUNDS):
        """EM estimate of the proportions of the columns of p, and its log likelihood."""
        import numpy as np

        share, total = start, n.sum()
        for _ in range(rounds):
            share = share * (p.T @ (n / (p @ share))) / total
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(label, score, proportions). The score is the label's proportion, times its odds against the others.

        Of equal likelihoods, and of equal proportions, the language that joined first counts, and before that the
        first by name.
        """
        import numpy as np

        found = grams(text)
        if found is None or not self.languages:
            return UNKNOWN, 0.0, {}
        buckets, n = found
        p = self.p[buckets]
        alone = n @ np.log(p)
        best, size = int(np.argmax(alone)), len(self.languages)
        chosen, share, likelihood = [best], np.ones(1), float(alone[best])
        price = PENALTY * float(np.log(n.sum() + 1))
        if size > 1:
            full, most = self.proportions(p, n, np.full(size, 1 / size))
            for candidate in np.argsort(-full):
                if candidate == best:
                    continue
                if most - likelihood < price:  # no set can gain enough
                    break
                tried = [*chosen, int(candidate)]
                start = full[tried] / full[tried].sum() if full[tried].min() > 0 else np.full(len(tried), 1 / len(tried))
                s, reached = self.proportions(p[:, tried], n, start)
                if reached - likelihood >= price:
                    chosen, share, likelihood = tried, s, reached
        top = int(np.argmax(share))
        odds = np.exp(np.clip((alone - alone.max()) / TEMPER, -700, 0))
        certain = 1.0 if len(chosen) > 1 else float(odds[chosen[top]] / odds.sum())
        return self.languages[chosen[top]], float(min(1.0, share[top] * certain)), {self.languages[c]: float(x) for c, x in zip(chosen, share)}


def learn(docs: DataFrame, learns, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Mixture:
    """A mixture learnt from rows of non-null language for whose id ``learns`` holds.

    The driver holds a count for each language and bucket (256 KB a language), however large the corpus; so does each
    worker. Rows that repeat count as often as they occur.
    """
    import numpy as np
    import pyarrow as pa

    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).where(F.col("_lang").isNotNull() & F.col("_id").isNotNull()).where(learns("_id"))
    totals = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Mixture([], np.zeros((0, 2 * BUCKETS)))
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(span, span * max_docs // n))])
    sample = known.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(span)) < share[F.col("_lang")]).select("_lang", "_text")

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, 256):
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                if (found := grams(text)) is not None:
                    held.setdefault(lang, np.zeros(2 * BUCKETS, np.int64))[found[0]] += found[1].astype(np.int64)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    languages = sorted(totals)
    counts = np.zeros((len(languages), 2 * BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    summed = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[summed["lang"].map(place).to_numpy(int), summed["bucket"].to_numpy(int)] = summed["n"].to_numpy(float)
    return Mixture(languages, counts)


def predict(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id[, text], lang_pred, score, mixture): a row for each row; ``und``, 0 and no mixture for texts without letters."""
    import pyarrow as pa

    shared, name = docs.sparkSession.sparkContext.broadcast((model.languages, model.p)), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def made():
        own = Mixture.__new__(Mixture)
        own.languages, own.p = shared.value
        return own

    def run(batches):
        own = worker_state("langid", "mixture", name, made)
        for batch in slices(batches, 256):
            got = [own.infer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.float64()))], [*kept, "lang_pred", "score", "mixture"])

    kept = ["doc_id", "text"] if keep_text else ["doc_id"]
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()},{' text string,' if keep_text else ''} lang_pred string, score double, mixture map<string,double>")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture): learns where crc32 of the id modulo 4 is not 2.

    Documents of null id are predicted, never learnt from, and not held out. Repeated rows each get a row.
    """
    found = predict(docs, learn(docs, lambda c: crc_mod(c, 4) != 2))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
