"""The corpus pipeline: each stage against brute force on its own input, and the whole of it."""

import hashlib
import struct
from collections import Counter

import pytest

import corpus_pipeline

from .conftest import documents
from .test_text_operators import brute_benchmark, brute_lines, brute_simhash, library, lower, sha

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, edge_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark, edge_rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "loop été and the of tie x1 of señor the loop"), (2, None), (3, "common line own 3")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_decide_as_brute_force_does(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "decontaminated", "encoded"]

    kept = stages["language"](spark, docs, folder)
    before, after = rows_of(docs), rows_of(kept)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if any(c.isalpha() for c in r[1] or ""))

    lined = stages["lines"](spark, kept, folder)
    bad, key = brute_lines(after, 10, True)
    assert bad and lined.columns == docs.columns and lined.count() == len(after)
    texts = [t for _, t in rows_of(lined)]
    for k in bad:
        assert sum(k in [key(line) for line in lower(t).split("\n")] for t in set(texts)) == 1

    held = rows_of(lined)
    single = stages["near_duplicates"](spark, lined, folder)
    _, groups = brute_simhash(held)
    assert single.columns == docs.columns and single.count() == len(set(groups))

    held = rows_of(single)
    clean = stages["decontaminated"](spark, single, folder)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {k[0] for k in brute_benchmark(held, items, 10) if k[5]}
    assert clean.columns == docs.columns
    assert sorted(map(str, rows_of(clean))) == sorted(str(r) for r in held if r[0] not in dirty)

    assert outputs(stages["encoded"](spark, clean, folder)) == encodings(rows_of(clean))


def encodings(rows):
    lib, out = library(), Counter()
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out[doc_id, len(ids), packed, hashlib.sha256(packed).hexdigest(), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    return out


def outputs(encoded):
    return Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in encoded.collect())


def test_run_equals_brute_force(spark, folder):
    """The whole pipeline against plain loops, stage after stage on what the loops keep."""
    docs = rows_of(spark.read.parquet(f"{folder}/documents.parquet"))
    docs = [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    bad, key = brute_lines(docs, 10, True)
    seen, lined = set(), {}
    for r in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in r[1].split("\n"):
            if key(line) not in bad or key(line) not in seen:
                kept.append(line)
            seen |= {key(line)} & bad
        lined[r] = "\n".join(kept)
    docs = [(r[0], lined[r]) for r in docs]
    assert any(a != b[1] for b, a in lined.items())
    _, groups = brute_simhash(docs)
    best = {}
    for r, g in zip(docs, groups):
        rank = (r[0] is None, r[0] or 0)
        if g not in best or rank < best[g][0]:
            best[g] = (rank, r)
    docs = [r for _, r in best.values()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {k[0] for k in brute_benchmark(docs, items, 10) if k[5]}
    docs = [r for r in docs if r[0] not in dirty]
    assert outputs(corpus_pipeline.run(spark, folder)) == encodings(docs)


def test_stages_keep_clashing_columns(spark, folder):
    """Extra columns of names that operators use inside go through every filtering stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'a' AS _row", "'b' AS _text", "'c' AS fp", "'d' AS keep", "'e' AS _key_id", "'f' AS hit", "'g' AS component")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        docs = kept
    assert docs.where("_row = 'a' AND _text = 'b' AND fp = 'c' AND keep = 'd' AND _key_id = 'e' AND hit = 'f' AND component = 'g'").count() == docs.count() > 0


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_has_its_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert [(f.name, f.dataType) for f in stage(spark, docs, folder).schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], COLUMNS).schema]
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(corpus_pipeline.encoded(spark, docs, folder).columns)
