"""The operators' registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import alignment, ann, bpe, decontam, divergence, langid, linededup, mixing, secrets, simhash, substring, toxicity, warc
from stowage.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("mixture")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.digest_lines(docs, linededup.keep_bitmaps(docs, min_docs=10, keep_first=False))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.crosswalk(table(spark, sf_dir, "documents"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_langid, op2_bpe, op3_toxicity, op4_simhash, op5_substring, op6_lines, op7_warc, op8_decontaminate, op9_multi_index, op10_secrets, op11_divergence, op12_alignment, op13_mix)
}

ORACLE_SQL: dict[str, str] = {
    "op5_substring": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i AS p, array_to_string(ws[i:i+34], ' ') AS s
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        hit AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, p + j AS at FROM hit, (SELECT unnest(range(0, 35)) AS j)),
        tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w),
        kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.at) AS s, count(*) AS n
                 FROM tok t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.at = t.at WHERE g.at IS NULL GROUP BY t.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(s, '')) AS kept_sha256
        FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op6_lines": r"""
        WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        k AS (SELECT doc_id, line, pos, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
        bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN bad ON bad.key = k.key GROUP BY doc_id""",
    "op7_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM p LEFT JOIN m ON m.d = p.d AND p.n >= 1000""",
    "op8_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        bw AS (SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s
               FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
        dw AS (SELECT doc_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS s
               FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)),
        occ AS (SELECT doc_id, p, bw.m, item FROM dw JOIN bw ON bw.s = dw.s AND bw.m = dw.m),
        hits AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM occ, (SELECT unnest(range(0, 10)) AS j) WHERE j < m GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
               sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
    "op11_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) JOIN kept USING (lang, term) GROUP BY lang, source, term),
        c AS (SELECT g.lang, g.source, kept.term, CAST(coalesce(o.n, 0) AS HUGEINT) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = kept.term),
        p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)),
        t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
        q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM t JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS u FROM documents),
        s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
        w AS (SELECT source, n, [3, 1, 2][CAST((place - 1) % 3 + 1 AS INTEGER)] AS w FROM s),
        f AS (SELECT *, coalesce(sum(4 * n) OVER before, 0) AS caps, coalesce(sum(w) OVER before, 0) AS ws, sum(n) OVER () AS words, sum(w) OVER () AS weights
              FROM w WINDOW before AS (ORDER BY n * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        m AS (SELECT *, 4 * n * (weights - ws) <= w * (3 * words - caps) AS stops FROM f),
        x AS (SELECT *, 3 * words - sum(CASE WHEN stops THEN 4 * n ELSE 0 END) OVER () AS rest, weights - sum(CASE WHEN stops THEN w ELSE 0 END) OVER () AS open FROM m),
        t AS (SELECT source, CAST(n AS BIGINT) AS n, CASE WHEN stops THEN CAST(2 * n AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(greatest(open, 1) * 2 AS DOUBLE) END AS target FROM x),
        g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
        p AS (SELECT *, CASE WHEN n > 0 THEN goal // n ELSE 0 END AS copies FROM g),
        q AS (SELECT d.*, p.n, p.target, p.copies, p.goal - p.copies * p.n AS missing, (d.u + 0.5) / 4503599627370496.0::DOUBLE AS r FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        o AS (SELECT *, CASE WHEN missing > 0 THEN (r / (1 - r)) / ((CAST(missing AS DOUBLE) / CAST(n AS DOUBLE)) / (1 - CAST(missing AS DOUBLE) / CAST(n AS DOUBLE))) END AS odds FROM q),
        c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, u, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o)
        SELECT doc_id, size, n AS source_size, target, CAST(copies * size + least(greatest(missing - used, 0), size) AS BIGINT) AS taken FROM c""",
}
