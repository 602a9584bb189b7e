"""Registered queries over the driver tables, each next to the DuckDB SQL that states the same result.

The tables are a sales star, so inputs are bound to them: parts are contents and suppliers locations, line items observe
one at the other, events are observations of documents, and so on. A binding is SQL that both engines read; a query runs
an operator of this package on its inputs, its SQL states the result on its own.
"""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import clocks, keys, tags, text, timed
from stowage.operators import gates, lineage, relational, resolve, sequence
from stowage.plans import inventory, reconcile

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What the engines call differently: name -> (Spark, DuckDB).
DIALECT = {
    "epoch": (r"(datediff(\1, DATE '1970-01-01') * 86400L + hour(\1) * 3600 + minute(\1) * 60 + second(\1))", r"CAST(floor(epoch(\1)) AS BIGINT)"),
    "sha": (r"sha2(\1, 256)", r"sha256(\1)"),
    "int": (r"CAST(\1 AS INT)", r"CAST(trunc(\1) AS INT)"),
    "json_k": (r"get_json_object(\1, '$.k')", r"json_extract_string(\1, '$.k')"),
}

BINDINGS = {
    "observation": """SELECT l_partkey AS content_id, l_suppkey AS location_id, l_returnflag <> 'R' AS present, concat('a/', CAST(l_partkey AS STRING)) AS rel_path,
        @sha(concat(CAST(l_partkey AS STRING), ':', CAST(@int(l_quantity) % 3 AS STRING))) AS file_sha256, CAST(@int(l_quantity) AS BIGINT) * 1000 AS byte_size,
        @epoch(l_shipdate) AS observed_utc FROM {lineitem}""",
    "presence": """SELECT content_id, location_id, present, rel_path, file_sha256, byte_size, observed_utc FROM (SELECT *, row_number() OVER (PARTITION BY content_id, location_id
        ORDER BY observed_utc DESC, present DESC, rel_path DESC, file_sha256 DESC, byte_size DESC) AS rn FROM {observation}) x WHERE rn = 1""",
    "location": """SELECT s_suppkey AS location_id, s_name AS name, s_suppkey % 10 = 1 AS is_authoritative, s_suppkey % 3 = 0 AS is_retention, s_suppkey % 7 <> 5 AS enabled FROM {supplier}""",
    "scan": """SELECT l_suppkey AS location_id, o_orderkey AS id, @epoch(o_orderdate) AS started_utc, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'running' END AS status
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "sidecar_presence": """SELECT content_id, location_id, present, concat('s/', CAST(content_id AS STRING)) AS rel_path, file_sha256, byte_size, observed_utc FROM {presence}""",
    "request": """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN 'sidecar' ELSE 'audio' END AS content_kind, l_partkey AS content_id, l_suppkey AS location_id,
        CASE WHEN l_partkey % 50 = 0 THEN '/a' WHEN l_partkey % 50 = 1 THEN 'a/../b' ELSE concat('a/', CAST(l_partkey AS STRING)) END AS rel_path
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM {lineitem}) x WHERE rn = 1""",
    "queue": """SELECT id, content_kind, content_id, location_id AS dest_location_id, rel_path, CASE WHEN content_id % 4 = 0 THEN 'delete' ELSE 'copy' END AS action_kind, content_id % 3 <> 0 AS acknowledged,
        CASE WHEN content_id % 3 <> 0 THEN CAST(5 AS BIGINT) END AS acknowledged_utc, CASE WHEN content_id % 5 = 0 THEN CAST(9 AS BIGINT) END AS executed_utc, id % 7 AS run_id FROM {request}""",
    "album": """SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 11 = 0 THEN concat('The ', p_brand) ELSE p_brand END AS albumartist,
        concat(p_name, CASE WHEN p_partkey % 6 = 0 THEN ' (Deluxe Edition)' WHEN p_partkey % 6 = 2 THEN ' [live]' ELSE '' END) AS album, CASE WHEN p_partkey % 9 = 0 THEN concat('x', CAST(p_partkey % 90 AS STRING)) END AS ext_id FROM {part}""",
    "item": """SELECT p_partkey AS ordinal, concat('c:', CAST(p_partkey AS STRING)) AS item_key, concat(p_brand, CASE WHEN p_partkey % 5 = 0 THEN ' (2)' WHEN p_partkey % 5 = 1 THEN ' Band' ELSE '' END) AS artist,
        concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN ' extra' WHEN p_partkey % 4 = 1 THEN ' (2018 Remaster)' ELSE '' END) AS title, CASE WHEN p_partkey % 13 = 0 THEN concat('x', CAST(p_partkey % 90 AS STRING)) END AS ext_id,
        CASE WHEN p_size % 5 = 0 THEN 'vinyl' WHEN p_size % 5 = 1 THEN 'cassette' ELSE 'cd' END AS medium FROM {part}""",
    "shelf": """SELECT p_partkey AS ordinal, concat(p_brand, ' ', p_type, ' ', CAST(p_partkey % 97 AS STRING)) AS albumartist, concat(p_name, ' opus ', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 6 = 0 THEN ' (Deluxe Edition)' ELSE '' END) AS album,
        CASE WHEN p_partkey % 9 = 0 THEN concat('x', CAST(p_partkey AS STRING)) END AS ext_id FROM {part}""",
    "wanted": """SELECT p_partkey AS ordinal, concat('c:', CAST(p_partkey AS STRING)) AS item_key, CASE WHEN p_partkey % 11 = 0 THEN concat(p_brand, ' ', p_type, ' ', CAST(p_partkey % 97 AS STRING), 'x') WHEN p_partkey % 11 = 1 THEN concat('Nobody Known ', CAST(p_partkey AS STRING))
        ELSE concat(p_brand, ' ', p_type, ' ', CAST(p_partkey % 97 AS STRING)) END AS artist, CASE WHEN p_partkey % 7 = 4 THEN concat('zq', CAST(p_partkey AS STRING)) ELSE concat(p_name, ' opus ', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 7 = 1 THEN ' (2018 Remaster)' WHEN p_partkey % 7 = 2 THEN ' extra' WHEN p_partkey % 7 = 3 THEN 'b' ELSE '' END) END AS title,
        CASE WHEN p_partkey % 18 = 0 THEN concat('x', CAST(p_partkey AS STRING)) END AS ext_id, CASE WHEN p_size % 5 = 0 THEN 'vinyl' ELSE 'cd' END AS medium FROM {part}""",
    "placed": """SELECT doc_id, concat('lib/', source, '/', CAST(doc_id % 97 AS STRING), CASE WHEN doc_id % 97 BETWEEN 10 AND 29 THEN '/cd1' ELSE '' END) AS directory, CASE WHEN doc_id % 97 < 50 THEN doc_id % 97 ELSE doc_id % 5 END AS album_id FROM {documents}""",
    "lines": """SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, @epoch(ts) AS sec, event_id, event_type, value FROM {events}""",
    "timed_line": """SELECT doc_id, pos, CAST(sec - min(sec) OVER (PARTITION BY doc_id) AS DOUBLE) AS time, event_id, event_type FROM {lines}""",
    "held": """SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS location_id, event_type AS actor, @json_k(props) AS sha, event_id FROM {events}""",
    # The last observation of each location, and its fold where nothing was known before: the first location's hash is the
    # head, each other hash a version of its own that goes back to nothing, so it is concurrent; versions count by location.
    "seen": """SELECT doc_id, CAST(location_id AS BIGINT) AS location_id, actor, sha FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, location_id ORDER BY event_id DESC) AS rn FROM {held}) x WHERE rn = 1""",
    "folded": """SELECT doc_id, location_id, sha, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY since) AS BIGINT) AS version_id, since = min(since) OVER (PARTITION BY doc_id) AS is_head FROM (SELECT *, min(location_id) OVER (PARTITION BY doc_id, sha) AS since FROM {seen}) x""",
    "target_conflicts": """SELECT f.doc_id, f.version_id AS loser_version, CAST(h.winner AS BIGINT) AS winner_location FROM {folded} f JOIN (SELECT doc_id, min(location_id) AS winner FROM {folded} WHERE is_head GROUP BY doc_id) h ON h.doc_id = f.doc_id WHERE f.location_id = 3 AND NOT f.is_head""",
    "clock": """SELECT user_id AS doc_id, event_type AS actor, event_id % 3 AS n, event_id % 2 AS side FROM {events}""",
    "file": """SELECT doc_id, concat('lib/', source, '/', lang, '/', lpad(CAST(doc_id % 37 AS STRING), 2, '0'), '. ', lang, CASE WHEN doc_id % 4 = 0 THEN '.lrc' WHEN doc_id % 9 = 1 THEN '.wav' ELSE '.flac' END) AS rel_path,
        CAST(n_chars AS BIGINT) AS byte_size, CAST(CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id * 7 END AS BIGINT) AS mtime_ns, doc_id % 5 AS location_id FROM {documents}""",
    "name": """SELECT c_custkey AS id, concat(CASE WHEN c_custkey % 7 = 0 THEN 'The ' ELSE '' END, c_name, CASE WHEN c_custkey % 3 = 0 THEN ' feat. Guest & Co' WHEN c_custkey % 3 = 1 THEN ' (Backing Vocals: Someone)' ELSE '' END,
        CASE WHEN c_custkey % 4 = 1 THEN ' (2)' ELSE '' END) AS artist, CASE WHEN c_custkey % 10 = 9 THEN 'Various Artists' WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS albumartist,
        concat(c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN ' [Japanese Edition]' WHEN c_custkey % 5 = 1 THEN ' (live) + more' ELSE '' END) AS title, c_custkey % 4 + 1 AS disc_no, CASE WHEN c_custkey % 50 = 3 THEN 9 ELSE 4 END AS disc_total, c_nationkey AS nation FROM {customer}""",
}

#: Inputs that an operator of this package makes in Spark.
MADE: dict[str, Callable] = {
    "presence": lambda spark, d: reconcile.fold_presence(bound(spark, d, "observation")),
    "seen": lambda spark, d: relational.latest(bound(spark, d, "held"), ["doc_id", "location_id"], ["event_id"]).select("doc_id", F.col("location_id").cast("long").alias("location_id"), "actor", "sha"),
}


def _said(sql: str, engine: int) -> str:
    """SQL with each ``@name(...)`` as the engine says it, inner ones first."""
    while (at := sql.rfind("@")) >= 0:
        name = re.match(r"@(\w+)\(", sql[at:])[1]
        start = end = at + len(name) + 2
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + DIALECT[name][engine].replace("\\1", sql[start : end - 1]) + sql[end:]
    return sql


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in MADE:
        return MADE[name](spark, sf_dir)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _said(BINDINGS[name], 0)
    return spark.sql(sql, **{n: bound(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def _oracle(sql: str) -> str:
    order: list[str] = []

    def need(s: str) -> None:
        for n in re.findall(r"\{(\w+)\}", s):
            if n in BINDINGS and n not in order:
                need(BINDINGS[n])
                order.append(n)

    need(sql)
    heads = [f"{n} AS ({_said(BINDINGS[n], 1)})" for n in order]
    body = _said(sql, 1).strip()
    if heads:
        body = f"WITH {', '.join(heads)}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
    return re.sub(r"\{(\w+)\}", r"\1", body)


def query(*inputs: str, sql: str | None = None):
    """Registers a function of its bound inputs as a query; its name is the key."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[bound(spark, sf_dir, n) for n in inputs])
        if sql:
            ORACLE_SQL[f.__name__] = _oracle(sql)
        return f

    return register


# Presence and planning

TARGET = 3


@query("observation", sql="SELECT * FROM {presence}")
def presence_latest(observation):
    return reconcile.fold_presence(observation)


@query("presence", "observation", sql="""
    WITH chg AS (SELECT content_id, location_id, max(observed_utc) + 1 AS observed_utc FROM {observation} WHERE content_id % 3 = 0 GROUP BY 1, 2),
    extra AS (SELECT content_id + 1000000 AS content_id, location_id, observed_utc FROM chg WHERE location_id % 5 = 0),
    allc AS (SELECT * FROM chg UNION ALL SELECT * FROM extra)
    SELECT coalesce(p.content_id, c.content_id) AS content_id, coalesce(p.location_id, c.location_id) AS location_id, CASE WHEN c.content_id IS NULL THEN p.present ELSE FALSE END AS present,
           p.rel_path, p.file_sha256, p.byte_size, CASE WHEN p.content_id IS NULL THEN c.observed_utc ELSE p.observed_utc END AS observed_utc
    FROM {presence} p FULL JOIN allc c ON p.content_id = c.content_id AND p.location_id = c.location_id""")
def presence_upsert(presence, observation):
    changes = observation.where("content_id % 3 = 0").groupBy("content_id", "location_id").agg((F.max("observed_utc") + 1).alias("observed_utc"))
    changes = changes.unionByName(changes.where("location_id % 5 = 0").withColumn("content_id", F.col("content_id") + 1000000))
    changes = changes.withColumns({"present": F.lit(False), "rel_path": F.lit(None).cast("string"), "file_sha256": F.lit(None).cast("string")})
    return relational.upsert(presence, changes, ["content_id", "location_id"], keep_first=["observed_utc"], never_clear=["rel_path", "file_sha256"])


@query("presence", "location", sql="SELECT content_id, count(*) AS copies FROM {presence} JOIN {location} USING (location_id) WHERE present AND is_retention GROUP BY 1")
def retention_copies(presence, location):
    return reconcile.retention_copies(presence, location)


_COPY = """SELECT 'copy' AS action_kind, '{kind}' AS content_kind, content_id, source_location_id, CAST(3 AS BIGINT) AS dest_location_id, rel_path, '{prefix}present on ' || sname || ', absent on ' || tname AS reason FROM (
    SELECT p.content_id, p.location_id AS source_location_id, p.rel_path, l.name AS sname, t.name AS tname, row_number() OVER (PARTITION BY p.content_id ORDER BY NOT l.is_authoritative, p.location_id) AS rn
    FROM {table} p JOIN {{location}} l ON l.location_id = p.location_id JOIN {{location}} t ON t.location_id = 3 AND NOT (t.is_authoritative AND NOT t.is_retention)
    WHERE p.present AND p.location_id <> 3 AND NOT EXISTS (SELECT 1 FROM {table} q WHERE q.content_id = p.content_id AND q.location_id = 3 AND q.present)) x WHERE rn = 1"""
_COPY_AUDIO = _COPY.format(kind="audio", prefix="", table="{presence}")
_COPY_SIDE = _COPY.format(kind="sidecar", prefix="sidecar ", table="{sidecar_presence}")


@query("presence", "location", sql=_COPY_AUDIO)
def copy_plan(presence, location):
    return reconcile.copy_plan(presence, location, TARGET)


@query("sidecar_presence", "location", sql=_COPY_SIDE)
def sidecar_copy_plan(presence, location):
    return reconcile.copy_plan(presence, location, TARGET, "sidecar")


_MISSING = """SELECT p.location_id, p.content_id, p.rel_path, CASE WHEN is_retention THEN coalesce(copies, 0) - 1 END AS projected, is_retention AND coalesce(copies, 0) - 1 < 2 AS below_floor
    FROM {presence} p JOIN (SELECT location_id, max(started_utc) AS cutoff FROM {scan} GROUP BY 1) s ON s.location_id = p.location_id JOIN {location} l ON l.location_id = p.location_id
    LEFT JOIN (SELECT content_id, count(*) AS copies FROM {presence} JOIN {location} USING (location_id) WHERE present AND is_retention GROUP BY 1) c ON c.content_id = p.content_id WHERE present AND observed_utc < cutoff"""


@query("presence", "location", "scan", sql=_MISSING)
def missing_plan(presence, location, scan):
    return reconcile.missing_plan(presence, location, scan, min_copies=2)


@query("presence", "location", sql="""SELECT p.content_id, coalesce(copies, 0) AS copies FROM (SELECT DISTINCT content_id FROM {presence} WHERE present) p
    LEFT JOIN (SELECT content_id, count(*) AS copies FROM {presence} JOIN {location} USING (location_id) WHERE present AND is_retention GROUP BY 1) c ON c.content_id = p.content_id WHERE coalesce(copies, 0) < 6""")
def below_floor(presence, location):
    return reconcile.below_floor(presence, location, 6)


@query("presence", "sidecar_presence", "location", "scan", "seen", sql=f"""SELECT * FROM ({_COPY_AUDIO}) UNION ALL SELECT * FROM ({_COPY_SIDE}) UNION ALL
    SELECT 'update_presence', 'audio', m.content_id, CAST(NULL AS BIGINT), CAST(3 AS BIGINT), m.rel_path, 'present in the catalog but not seen in the latest scan of ' || l.name FROM ({_MISSING}) m JOIN {{location}} l ON l.location_id = 3 WHERE m.location_id = 3
    UNION ALL SELECT 'resolve_conflict', 'audio', doc_id, CAST(winner_location AS BIGINT), CAST(3 AS BIGINT), CAST(NULL AS VARCHAR), 'texts diverge' FROM (SELECT * FROM {{target_conflicts}}) c""")
def reconcile_plan(presence, sidecars, location, scan, seen):
    held = lineage.lineage(seen)
    return reconcile.reconcile(TARGET, presence, sidecars, location, scan, lineage.conflicts(held, TARGET, seen.limit(0).select("doc_id")))


_PRUNE = """SELECT p.location_id, p.content_id, p.rel_path, p.byte_size, coalesce(copies, 0) < 2 AS below_floor FROM {presence} p JOIN {location} l ON l.location_id = p.location_id
    LEFT JOIN (SELECT content_id, count(*) AS copies FROM {presence} JOIN {location} USING (location_id) WHERE present AND is_retention GROUP BY 1) c ON c.content_id = p.content_id
    WHERE p.present AND l.is_authoritative AND NOT l.is_retention AND l.enabled AND EXISTS (SELECT 1 FROM {presence} r JOIN {location} k ON k.location_id = r.location_id
    WHERE k.is_retention AND r.present AND r.content_id = p.content_id AND r.rel_path = p.rel_path AND r.file_sha256 = p.file_sha256)"""


@query("presence", "location", sql=_PRUNE)
def prune_eligible(presence, location):
    return reconcile.prunable(presence, location, 2)


@query("presence", "location", sql=f"SELECT location_id, count(*) AS pruned, CAST(sum(byte_size) AS BIGINT) AS bytes_freed, count(*) FILTER (WHERE below_floor) AS below_floor FROM ({_PRUNE}) GROUP BY 1")
def prune_totals(presence, location):
    return reconcile.prune_totals(reconcile.prunable(presence, location, 2))


_GATE = """WITH r AS (SELECT q.*, l.location_id AS known, l.is_retention, coalesce(p.present, FALSE) AS counts, p.byte_size AS size, coalesce(c.copies, 0) AS copies FROM {request} q
      LEFT JOIN {location} l ON l.location_id = q.location_id LEFT JOIN {presence} p ON p.content_id = q.content_id AND p.location_id = q.location_id
      LEFT JOIN (SELECT content_id, count(*) AS copies FROM {presence} JOIN {location} USING (location_id) WHERE present AND is_retention GROUP BY 1) c ON c.content_id = q.content_id),
    e AS (SELECT *, CASE WHEN content_kind <> 'audio' THEN 'skipped' WHEN known IS NULL OR rel_path LIKE '/%' OR list_contains(string_split(rel_path, '/'), '..') THEN 'error' WHEN NOT is_retention THEN 'refused' END AS early FROM r),"""


@query("request", "presence", "location", sql=_GATE + """
    v AS (SELECT *, coalesce(early, CASE WHEN copies - CASE WHEN counts THEN 1 ELSE 0 END >= 2 THEN 'deleted' ELSE 'refused' END) AS verdict FROM e)
    SELECT id, content_kind, content_id, location_id, rel_path, verdict, CASE WHEN verdict = 'deleted' THEN coalesce(size, 0) END AS byte_size FROM v""")
def delete_gate_dry(request, presence, location):
    return reconcile.delete_gate(request, presence, location, 2)


@query("request", "presence", "location", sql=_GATE + """
    f AS (SELECT *, early IS NULL AND counts AND id = min(id) OVER (PARTITION BY content_id, location_id, early IS NULL) AS firsts FROM e),
    t AS (SELECT *, sum(CASE WHEN firsts THEN 1 ELSE 0 END) OVER (PARTITION BY content_id, early IS NULL ORDER BY id ROWS UNBOUNDED PRECEDING) AS taken FROM f),
    g AS (SELECT *, min(taken) OVER (PARTITION BY content_id, location_id, early IS NULL) AS place, greatest(copies - 2, 0) AS budget FROM t),
    v AS (SELECT *, coalesce(early, CASE WHEN CASE WHEN counts THEN place <= budget ELSE copies - least(taken, budget) >= 2 END THEN 'deleted' ELSE 'refused' END) AS verdict FROM g)
    SELECT id, content_kind, content_id, location_id, rel_path, verdict, CASE WHEN verdict = 'deleted' THEN coalesce(size, 0) END AS byte_size FROM v""")
def delete_gate(request, presence, location):
    return reconcile.delete_gate(request, presence, location, 2, dry_run=False)


@query("queue", sql="SELECT * FROM {queue} WHERE acknowledged AND executed_utc IS NULL AND action_kind = 'copy'")
def action_queue(queue):
    return relational.pending_actions(queue, "copy")


@query("queue", sql="""SELECT id, content_kind, content_id, dest_location_id, rel_path, action_kind, acknowledged OR run_id = 2 AS acknowledged, CASE WHEN run_id = 2 AND NOT acknowledged THEN 77 ELSE acknowledged_utc END AS acknowledged_utc,
    executed_utc, run_id, run_id = 2 AND NOT acknowledged AS changed FROM {queue}""")
def acknowledge_run(queue):
    return relational.acknowledge(queue, F.col("run_id") == 2, 77)


@query("queue", "observation", sql="""WITH done AS (SELECT * FROM {queue} WHERE acknowledged AND executed_utc IS NULL AND action_kind = 'copy'),
    res AS (SELECT id, @sha(CAST(content_id AS VARCHAR)) AS a, CASE WHEN id % 4 = 0 THEN 'bad' ELSE @sha(CAST(content_id AS VARCHAR)) END AS b FROM done)
    SELECT content_kind, content_id, dest_location_id AS location_id, TRUE AS present, rel_path, b AS file_sha256, id % 1000 AS byte_size, id AS mtime_ns, CAST(99 AS BIGINT) AS observed_utc FROM done JOIN res USING (id) WHERE a = b""")
def copy_facts(queue, observation):
    done = relational.pending_actions(queue, "copy")
    digest = F.sha2(F.col("content_id").cast("string"), 256)
    results = done.select("id", digest.alias("source_sha256"), F.when(F.col("id") % 4 == 0, "bad").otherwise(digest).alias("dest_sha256"), (F.col("id") % 1000).alias("byte_size"), F.col("id").alias("mtime_ns"))
    return reconcile.executed_copies(done, results, 99)[0]


@query("presence", sql="SELECT content_id, location_id, CASE WHEN rel_path LIKE 'a/1%' THEN 'lib/9' || substr(rel_path, 4) ELSE rel_path END AS rel_path FROM {presence}")
def path_rewrite(presence):
    return relational.move_prefix(presence.select("content_id", "location_id", "rel_path"), "rel_path", "a/1", "lib/9")


@query("presence", sql="SELECT rel_path, file_sha256, CASE WHEN min(content_id) = max(content_id) THEN min(content_id) END AS content_id FROM (SELECT left(rel_path, 4) AS rel_path, left(file_sha256, 2) AS file_sha256, content_id FROM {presence} WHERE present) x GROUP BY 1, 2")
def ambiguous_lookup(presence):
    return relational.unambiguous(presence.where("present").select(F.substring("rel_path", 1, 4).alias("rel_path"), F.substring("file_sha256", 1, 2).alias("file_sha256"), "content_id"), ["rel_path", "file_sha256"])


@query("scan", sql="SELECT location_id, id, started_utc, status FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY started_utc DESC, id DESC, status DESC) AS rn FROM {scan}) x WHERE rn = 1")
def latest_scan(scan):
    return relational.latest_scan(scan)


@query("queue", "item", sql="SELECT q.id, q.content_kind, q.content_id, CASE WHEN content_kind = 'audio' THEN coalesce(artist, '?') || ' — ' || coalesce(title, '?') ELSE content_kind || ' ' || CAST(content_id AS VARCHAR) END AS label FROM {queue} q LEFT JOIN {item} i ON i.ordinal = q.content_id")
def bulk_lookup(queue, item):
    return reconcile.action_labels(queue.select("id", "content_kind", "content_id"), item.select(F.col("ordinal").alias("content_id"), "artist", "title"))


@query("presence", "observation", sql="""SELECT content_id, location_id FROM {presence} WHERE content_id % 2 = 0 UNION SELECT content_id, location_id FROM {observation}""")
def first_seen_append(presence, observation):
    return relational.insert_missing(presence.where("content_id % 2 = 0").select("content_id", "location_id"), observation.select("content_id", "location_id"), ["content_id", "location_id"])


# Files

_STEM = r"regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '(.)\.[^./]*$', '\1')"
_DIR = r"regexp_extract(rel_path, '^(.*)/[^/]*$', 1)"


@query("file", sql=f"""WITH f AS (SELECT *, {_DIR} AS directory, {_STEM} AS stem FROM {{file}}), side AS (SELECT * FROM f WHERE rel_path LIKE '%.lrc'),
    trk AS (SELECT * FROM f WHERE rel_path NOT LIKE '%.lrc'), here AS (SELECT directory, lower(stem) AS s, max_by(doc_id, doc_id) AS c FROM trk WHERE location_id = 0 GROUP BY 1, 2),
    there AS (SELECT directory, stem, CASE WHEN min(doc_id) = max(doc_id) THEN min(doc_id) END AS c FROM trk GROUP BY 1, 2)
    SELECT side.doc_id, side.directory, side.stem, coalesce(here.c, there.c) AS content_id FROM side LEFT JOIN here ON here.directory = side.directory AND here.s = lower(side.stem) LEFT JOIN there ON there.directory = side.directory AND there.stem = side.stem""")
def stem_join(file):
    named = file.withColumns({"directory": text.parent(F.col("rel_path")), "stem": text.stem(text.file_name(F.col("rel_path")))})
    tracks = named.where("rel_path not like '%.lrc'").select("directory", "stem", F.col("doc_id").alias("content_id"), F.col("doc_id").alias("ordinal"), "location_id")
    side = named.where("rel_path like '%.lrc'").select("doc_id", "directory", "stem")
    return relational.stem_join(side, tracks.where("location_id = 0"), tracks)


@query("placed", sql=r"""WITH d AS (SELECT DISTINCT directory FROM {placed} UNION SELECT DISTINCT regexp_extract(directory, '^(.*)/[^/]*$', 1) FROM {placed}),
    dir AS (SELECT directory, min(album_id) AS lo, max(album_id) AS hi FROM {placed} GROUP BY 1), up AS (SELECT regexp_extract(directory, '^(.*)/[^/]*$', 1) AS directory, min(lo) AS lo, max(hi) AS hi FROM dir GROUP BY 1)
    SELECT d.directory, CASE WHEN dir.lo IS NOT NULL THEN CASE WHEN dir.lo = dir.hi THEN dir.lo END WHEN up.lo = up.hi THEN up.lo END AS album_id FROM d LEFT JOIN dir ON dir.directory = d.directory LEFT JOIN up ON up.directory = d.directory""")
def dir_album_resolve(placed):
    placed = placed.select("directory", "album_id")
    own = placed.select("directory")
    return relational.directory_album(own.unionByName(own.select(text.parent(F.col("directory")).alias("directory"))).distinct(), placed)


@query("file", sql="""WITH known AS (SELECT location_id, rel_path, max_by(doc_id, (o, doc_id)) AS content, max_by(byte_size, (o, doc_id)) AS size, max_by(mtime_ns, (o, doc_id)) AS mtime FROM (SELECT *, doc_id % 10 AS o FROM {file} WHERE doc_id % 3 <> 0) x GROUP BY 1, 2)
    SELECT f.location_id, f.rel_path, f.byte_size, f.mtime_ns, CASE WHEN f.byte_size = size AND f.mtime_ns = mtime THEN 'reuse' ELSE 'hash' END AS decision, CASE WHEN f.byte_size = size AND f.mtime_ns = mtime THEN content END AS content_id,
    CASE WHEN f.byte_size = size AND f.mtime_ns = mtime THEN @sha(CAST(content AS VARCHAR)) END AS file_sha256 FROM {file} f LEFT JOIN known k ON k.location_id = f.location_id AND k.rel_path = f.rel_path""")
def incremental_rescan(file):
    known = file.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("content_id"), "location_id", F.lit(True).alias("present"), "rel_path", F.sha2(F.col("doc_id").cast("string"), 256).alias("file_sha256"), "byte_size", "mtime_ns", (F.col("doc_id") % 10).alias("observed_utc"))
    return inventory.rescan_decision(file.select("location_id", "rel_path", "byte_size", "mtime_ns"), known)


# Gates

@query("name", sql="""SELECT nation, count(DISTINCT disc_no) AS discs, CASE WHEN min(disc_total) = max(disc_total) AND max(disc_total) > 1 AND count(DISTINCT disc_no) < max(disc_total) THEN 'WAIT:' || count(DISTINCT disc_no) || ':' || max(disc_total) END AS verdict
    FROM (SELECT nation, disc_total, CASE WHEN disc_no <> nation % 6 THEN disc_no END AS disc_no FROM {name}) x GROUP BY 1""")
def disc_wait(name):
    read = name.withColumn("disc_no", F.when(F.col("disc_no") != F.col("nation") % 6, F.col("disc_no")))  # others have an unreadable number
    return gates.disc_wait(read, ["nation"])


@query("name", sql="SELECT nation, count(*) AS n, min(id) AS first_seen FROM {name} GROUP BY 1")
def group_first_seen(name):
    return gates.group_first_seen(name, "nation", "id")


_B = "lower(trim(regexp_replace(%s, '\\s+', ' ', 'g')))"


@query("album", sql=f"""WITH b AS (SELECT ordinal AS batch_id, albumartist AS artist, album || ' ' || (ordinal // 3) AS album FROM {{album}}), l AS (SELECT DISTINCT {_B % 'albumartist'} AS a, {_B % 'album'} AS t FROM
      (SELECT CASE WHEN ordinal % 3 = 1 THEN 'x ' || albumartist ELSE albumartist END AS albumartist, album || ' ' || (ordinal // 3) AS album FROM {{album}} WHERE ordinal % 11 <> 5) y),
    n AS (SELECT *, {_B % 'artist'} AS a, {_B % 'album'} AS t FROM b), one AS (SELECT t, min(a) AS a FROM l GROUP BY t HAVING count(*) = 1), cnt AS (SELECT t, count(*) AS c FROM n GROUP BY t)
    SELECT batch_id, artist, album, CASE WHEN (SELECT count(*) FROM l) = 0 OR l.a IS NOT NULL OR (c = 1 AND one.a IS NOT NULL) THEN 'ready' ELSE 'held' END AS state
    FROM n LEFT JOIN l ON l.a = n.a AND l.t = n.t LEFT JOIN one ON one.t = n.t LEFT JOIN cnt ON cnt.t = n.t""")
def log_batch_gate(album):
    named = album.withColumn("album", F.concat_ws(" ", "album", F.floor(F.col("ordinal") / 3).cast("string")))
    signed = F.when(F.col("ordinal") % 3 == 1, F.concat(F.lit("x "), "albumartist")).otherwise(F.col("albumartist"))
    logs = named.select(signed.alias("artist"), F.when(F.col("ordinal") % 11 != 5, F.col("album")).alias("album"))  # the others cannot be read
    return gates.log_gate(named.select(F.col("ordinal").alias("batch_id"), F.col("albumartist").alias("artist"), "album"), logs).drop("log_key")


@query("album", sql="""WITH b AS (SELECT ordinal AS batch_id, albumartist AS artist, album, ext_id, ordinal * 2 AS before FROM {album}), lib AS (SELECT *, 'd/' || CAST(ordinal AS VARCHAR) AS directory, ordinal + 500 AS added_utc FROM {album}),
    m AS (SELECT batch_id, min_by(directory, lib.ordinal) AS existing_dir, count(*) AS n FROM b JOIN lib ON (CASE WHEN b.ext_id IS NOT NULL THEN lib.ext_id = b.ext_id ELSE lib.albumartist = b.artist AND lib.album = b.album END) AND added_utc < before GROUP BY 1)
    SELECT b.*, CASE WHEN b.batch_id % 25 = 0 THEN 'added' WHEN existing_dir IS NOT NULL THEN 'duplicate' ELSE 'no_match' END AS decision, existing_dir, coalesce(n, 0) AS n_tracks FROM b LEFT JOIN m ON m.batch_id = b.batch_id""")
def duplicate_lookup(album):
    batches = album.select(F.col("ordinal").alias("batch_id"), F.col("albumartist").alias("artist"), "album", "ext_id", (F.col("ordinal") * 2).alias("before"))
    library = album.select("ext_id", F.col("albumartist").alias("artist"), "album", F.concat(F.lit("d/"), F.col("ordinal").cast("string")).alias("directory"), (F.col("ordinal") + 500).alias("added_utc"), "ordinal")
    return gates.duplicate_decision(batches, library, batches.where("batch_id % 25 = 0"))


@query("album", sql="""WITH ex AS (SELECT albumartist AS directory, CAST(ordinal % 9 AS VARCHAR) || '.lrc' AS name, @sha(max(album)) AS held FROM {album} WHERE ordinal % 4 = 1 GROUP BY 1, 2),
    inc AS (SELECT ordinal, albumartist AS directory, CAST(ordinal % 9 AS VARCHAR) || '.lrc' AS name, @sha(album) AS sha256 FROM {album} WHERE ordinal % 4 <> 1),
    r AS (SELECT inc.*, held, min(sha256) OVER (PARTITION BY inc.directory, inc.name) AS first, row_number() OVER (PARTITION BY inc.directory, inc.name, sha256 ORDER BY ordinal) AS rep FROM inc LEFT JOIN ex ON ex.directory = inc.directory AND ex.name = inc.name),
    o AS (SELECT *, CASE WHEN rep > 1 THEN 'dropped' WHEN sha256 = coalesce(held, first) THEN CASE WHEN held IS NULL THEN 'moved' ELSE 'dropped' END ELSE 'parked' END AS outcome FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY directory, name, outcome ORDER BY sha256) AS place FROM o)
    SELECT directory, name, sha256, outcome, CASE WHEN outcome = 'parked' THEN replace(name, '.lrc', ' (' || (place + 1) || ').lrc') ELSE name END AS stored_as FROM n""")
def conflict_preserving_merge(album):
    named = album.withColumns({"directory": F.col("albumartist"), "name": F.concat((F.col("ordinal") % 9).cast("string"), F.lit(".lrc"))})
    held = named.where("ordinal % 4 = 1").groupBy("directory", "name").agg(F.sha2(F.max("album"), 256).alias("sha256"))
    return relational.merge_keeping_conflicts(named.where("ordinal % 4 <> 1").select("directory", "name", F.sha2("album", 256).alias("sha256")), held)


@query("location", sql="""SELECT location_id, name, root_path, uuid, CASE WHEN location_id % 4 <> 0 AND root_path IS NOT NULL AND (location_id % 3 = 0 OR location_id % 5 <> 0) THEN root_path END AS root FROM
    (SELECT location_id, name, CASE WHEN location_id % 6 <> 5 THEN '/mnt/' || CAST(location_id AS VARCHAR) END AS root_path, 'u' || CAST(location_id AS VARCHAR) AS uuid FROM {location}) x""")
def location_resolve(location):
    from stowage.sources.files import resolved_roots

    rows = location.select("location_id", "name", F.when(F.col("location_id") % 6 != 5, F.concat(F.lit("/mnt/"), F.col("location_id").cast("string"))).alias("root_path"), F.concat(F.lit("u"), F.col("location_id").cast("string")).alias("uuid"))
    markers = rows.where("location_id % 4 <> 0 and root_path is not null").select("root_path", F.when(F.col("location_id") % 3 == 0, F.lit(None)).when(F.col("location_id") % 5 == 0, "other").otherwise(F.col("uuid")).alias("marker"))
    return resolved_roots(rows, markers)


@query("file", sql="""WITH t AS (SELECT location_id * 100 + doc_id % 23 AS group_id, doc_id % 8 <> 1 AS marked FROM {file}), m AS (SELECT DISTINCT group_id FROM t WHERE group_id % 7 = 0)
    SELECT t.group_id, count(*) AS tracks, CASE WHEN max(m.group_id) IS NOT NULL THEN 0 ELSE count(*) FILTER (WHERE NOT marked) END AS waiting, max(m.group_id) IS NOT NULL OR bool_and(marked) AS complete,
    CASE WHEN max(m.group_id) IS NOT NULL OR bool_and(marked) THEN 'promoted' ELSE 'waiting' END AS decision FROM t LEFT JOIN m ON m.group_id = t.group_id GROUP BY 1""")
def completeness_gate(file):
    tracks = file.select((F.col("location_id") * 100 + F.col("doc_id") % 23).alias("group_id"), (F.col("doc_id") % 8 != 1).alias("marked"))
    return gates.promotion(gates.completeness(tracks, tracks.where("group_id % 7 = 0").select("group_id")))


@query("name", sql="""WITH o AS (SELECT nation, CASE WHEN id % 11 = 0 THEN 'skipped' WHEN id % 7 = 0 THEN 'missing' WHEN id % 13 = 0 THEN 'error' WHEN albumartist = '' THEN 'skipped' WHEN id % 17 = 0 THEN 'error' WHEN id % 3 = 0 THEN 'synced' WHEN id % 5 = 0 THEN 'plain' ELSE 'missing' END AS o FROM {name})
    SELECT nation, count(*) FILTER (WHERE o = 'synced') AS synced, count(*) FILTER (WHERE o = 'plain') AS plain, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'missing') AS missing, count(*) FILTER (WHERE o = 'error') AS error,
    count(*) FILTER (WHERE o = 'missing') > 0 AND count(*) FILTER (WHERE o IN ('synced', 'plain', 'error')) = 0 AS blanket FROM o GROUP BY 1""")
def outcome_cascade(name):
    i = lambda n: F.col("id") % n == 0
    said = gates.outcome(i(11), i(7), i(13), F.col("artist"), F.col("albumartist"), i(17), F.when(i(3), "x"), F.when(i(5), "y"), F.lit(""))
    return gates.outcome_tally(name.select("nation", said.alias("outcome")), ["nation"])


@query("album", sql="""SELECT ordinal, albumartist, album, ext_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(albumartist)), lower(trim(album)) ORDER BY ext_id IS NULL, ordinal) AS rn FROM {album}) x WHERE rn = 1""")
def catalog_union_dedupe(album):
    return resolve.union_catalogs(album.where("ordinal % 2 = 0"), album.where("ordinal % 2 = 1"))


@query("item", sql="SELECT item_key, medium FROM {item} WHERE medium IN ('vinyl', 'cassette')")
def media_overlap_filter(item):
    return relational.filter_media(item.withColumn("media", F.array("medium")), ["vinyl", "cassette"]).select("item_key", "medium")


@query("item", "album", sql="SELECT DISTINCT ordinal AS id FROM {album} WHERE NOT EXISTS (SELECT 1 FROM {item} i WHERE i.ordinal = album.ordinal AND i.medium = 'cd')")
def unknown_ids(item, album):
    return relational.unknown_ids(album.select(F.col("ordinal").alias("id")).distinct(), item.where("medium = 'cd'").select(F.col("ordinal").alias("id")), "id")


@query("queue", "name", sql="SELECT item_id, key, value FROM (SELECT id AS item_id, 'multi' AS key, 'old' AS value FROM {name} WHERE id % 4 = 0 UNION ALL SELECT id, 'multi', 'new' FROM {name} WHERE id % 4 <> 0) x")
def attribute_backfill(queue, name):
    items = name.select(F.col("id").alias("item_id"))
    return gates.missing_attributes(items, items.where("item_id % 4 = 0").withColumns({"key": F.lit("multi"), "value": F.lit("old")}), "multi", "new")


# Text and keys

_NOCRED = r"regexp_replace(%s, '\s*\(\d+\)\s*$', '')"
_EDIT = (
    r"[(\[]([^)\]]*[^a-zA-Z)\]])?(anniversary|bonus|collectors|definitive|deluxe|disc|edition|expanded|explicit|japan|japanese|limited|mix|mono|reissue|remaster|remastered|remix|special|stereo|version)"
    r"([^a-zA-Z)\]][^)\]]*)?[)\]]"
)
_FOLD = rf"replace(replace(lower(regexp_replace(%s, '{_EDIT}', ' ', 'gi')), '&', ' and '), '+', ' and ')"
_NORM_A = r"trim(regexp_replace(regexp_replace(" + _FOLD % (_NOCRED % "artist") + r", '^the ', ''), '[^\p{L}\p{N}]+', ' ', 'g'))"
_NORM_T = r"trim(regexp_replace(" + _FOLD + r", '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("name")
def normalize_text(name):
    return name.select("id", text.normalize_artist(F.col("artist")).alias("artist_key"), text.normalize_title(F.col("title")).alias("title_key"))


ORACLE_SQL["normalize_text"] = _oracle("SELECT id, NORM_A AS artist_key, NORM_T AS title_key FROM {name}").replace("NORM_A", _NORM_A).replace("NORM_T", _NORM_T % "title")


@query("item", "album", sql=r"""WITH a AS (SELECT DISTINCT lower(artist) AS k FROM {item}), b AS (SELECT DISTINCT lower(albumartist) AS k FROM {album}),
    x AS (SELECT a.k AS a, b.k AS b, list_distinct(string_split(a.k, ' ')) AS ta, list_distinct(string_split(b.k, ' ')) AS tb FROM a, b)
    SELECT a, b, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS score FROM x WHERE len(list_intersect(ta, tb)) > 0""")
def token_jaccard_join(item, album):
    a, b = item.select(F.lower("artist").alias("a")).distinct(), album.select(F.lower("albumartist").alias("b")).distinct()
    met = a.select("a", F.explode(text.tokens(F.col("a"))).alias("w")).join(b.select("b", F.explode(text.tokens(F.col("b"))).alias("w")), "w").select("a", "b").distinct()
    return met.withColumn("score", text.jaccard(F.col("a"), F.col("b")))


@query("item", "album", sql="""SELECT i.item_key, a.ordinal FROM {item} i JOIN {album} a ON least(length(i.title), length(a.album)) >= 3 AND (contains(' ' || lower(a.album) || ' ', ' ' || lower(i.title) || ' ') OR contains(' ' || lower(i.title) || ' ', ' ' || lower(a.album) || ' '))""")
def token_contains(item, album):
    return resolve.containing_rows(item.select("item_key", F.lower("title").alias("text")), album.select("ordinal", F.lower("album").alias("text")))


_ITEM = lambda item: item.withColumns({"artist_alts": F.array().cast("array<string>"), "title_alts": F.array().cast("array<string>"), "media": F.array("medium")})


@query("wanted", "shelf")
def match_cascade(wanted, shelf):
    return resolve.match(_ITEM(wanted), shelf)


@query("wanted", "shelf")
def audit_buckets(wanted, shelf):
    return resolve.buckets(resolve.audit(_ITEM(wanted), shelf, wanted.where("ordinal % 8 = 1").select("item_key")))


_FEATX = text.FEAT.replace("(?i)", "")
_CREDX = text.CREDIT.replace("(?i)", "")
_CLEAN = f"CASE WHEN regexp_matches(%s, '{_FEATX}', 'i') THEN trim(regexp_replace(%s, '{_FEATX}', '', 'i')) WHEN regexp_matches(%s, '{_CREDX}', 'i') THEN trim(regexp_replace(%s, '{_CREDX}', '', 'i')) ELSE %s END"


@query("name")
def feat_credit_split(name):
    return name.select("id", text.split_feat(F.col("artist"), F.col("albumartist"), F.col("title")).alias("s"), text.strip_credits(F.col("artist")).alias("credited")).select("id", "s.*", "credited")


ORACLE_SQL["feat_credit_split"] = _oracle("""SELECT id, CASE WHEN albumartist = 'Various Artists' THEN artist WHEN FEAT THEN CASE WHEN albumartist <> '' THEN albumartist ELSE trim(regexp_replace(artist, 'FX', '', 'i')) END WHEN albumartist <> '' AND artist <> albumartist THEN albumartist ELSE artist END AS artist, albumartist,
    CASE WHEN albumartist <> 'Various Artists' AND FEAT THEN title || ' (feat. ' || trim(regexp_extract(artist, 'FX', 1, 'i')) || ')' ELSE title END AS title, CREDITED AS credited FROM {name}""").replace("FEAT", f"regexp_matches(artist, '{_FEATX}', 'i')").replace("CREDITED", _CLEAN.replace("%s", "artist")).replace("'FX'", f"'{_FEATX}'")


@query("file", "documents", sql=r"""WITH q AS (SELECT f.doc_id, lang AS artist, CASE WHEN f.doc_id % 3 = 0 THEN '夜 ' || source WHEN f.doc_id % 3 = 1 THEN source ELSE '夜' END AS title, '昼' || lang AS album, rel_path, CASE WHEN f.doc_id % 4 = 1 THEN 'Sort' ELSE '' END AS s, CASE WHEN f.doc_id % 5 = 1 THEN 'English' ELSE '' END AS e FROM {file} f JOIN {documents} d ON d.doc_id = f.doc_id),
    v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN [title, substr(title, 3)] ELSE [title] END AS t0, regexp_replace(regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '(.)\.[^./]*$', '\1'), '^\d+[-.]?\d*[.\s]+', '') AS f FROM q),
    w AS (SELECT *, CASE WHEN list_contains(t0, f) THEN t0 ELSE list_append(t0, f) END AS ts FROM v),
    x AS (SELECT doc_id, list_concat(list_transform(ts, lambda t: artist || '|' || t || '|' || album), CASE WHEN e <> '' THEN CASE WHEN s <> '' THEN [s || '|' || e || '|', artist || '|' || e || '|'] ELSE [artist || '|' || e || '|'] END WHEN s <> '' THEN list_transform(ts, lambda t: s || '|' || t || '|' || substr(album, 2)) ELSE [] END) AS a FROM w)
    SELECT doc_id, CAST(unnest(range(0, len(a))) AS INT) AS attempt, unnest(a) AS triple FROM x""")
def query_variants(file, documents):
    d = F.col("doc_id")
    title = F.when(d % 3 == 0, F.concat(F.lit("夜 "), "source")).when(d % 3 == 1, F.col("source")).otherwise("夜")
    rows = file.join(documents.select("doc_id", "lang", "source"), "doc_id")
    tried = text.query_variants(F.col("lang"), title, F.concat(F.lit("昼"), "lang"), F.col("rel_path"), F.when(d % 4 == 1, "Sort").otherwise(""), F.when(d % 5 == 1, "English").otherwise(""))
    return rows.select("doc_id", F.posexplode(tried).alias("attempt", "t")).select("doc_id", "attempt", F.concat_ws("|", "t.artist", "t.title", "t.album").alias("triple"))


_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(%s))"


@query("album", sql=f"""WITH h AS (SELECT ordinal, {_UUID % "'stowage:album:' || CASE WHEN ext_id IS NOT NULL THEN 'mb:' || lower(trim(ext_id)) ELSE 'aa:' || lower(trim(albumartist)) || chr(0) || lower(trim(album)) END"} AS h FROM {{album}})
    SELECT ordinal, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS album_key FROM h""")
def album_key_uuid5(album):
    return album.select("ordinal", keys.album_key(F.col("albumartist"), F.col("album"), F.col("ext_id")).alias("album_key"))


@query("name", sql="""SELECT id, coalesce(nullif(CASE WHEN id % 4 <> 0 THEN artist END, ''), nullif(albumartist, '')) AS artist, coalesce(nullif(albumartist, ''), nullif(CASE WHEN id % 4 <> 0 THEN artist END, '')) AS albumartist,
    CAST(disc_no AS INT) AS disc_no, CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id AS INT) END AS track_no FROM {name}""")
def tag_coalesce(name):
    entry = F.map_from_arrays(F.array(F.lit("artist"), F.lit("albumartist"), F.lit("DISCNUMBER"), F.lit("tracknumber")), F.array(*[F.array(c) for c in (F.when(F.col("id") % 4 != 0, F.col("artist")).otherwise(""), F.col("albumartist"), F.concat(F.col("disc_no").cast("string"), F.lit("/4")), F.when(F.col("id") % 6 == 0, "x").otherwise(F.col("id").cast("string")))]))
    return name.select("id", tags.standard(entry).alias("t")).select("id", "t.artist", "t.albumartist", "t.disc_no", "t.track_no")


@query("conversations", sql=r"""SELECT conv_id, turn, array_to_string(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: CASE WHEN trim(x) <> '' THEN '[00:00.00] ' || x ELSE '' END), chr(10)) AS lrc FROM {conversations}""")
def plain_envelope(conversations):
    return conversations.select("conv_id", "turn", timed.envelope(F.col("text")).alias("lrc"))


# Timed lines

_LRC = "printf('[%02d:%05.2f]%s', CAST(floor(t / 60) AS INT), t - floor(t / 60) * 60, event_type)"
MADE["lrc"] = lambda spark, d: bound(spark, d, "timed_line").select("doc_id", F.struct("pos", F.round(F.col("time") % 5940 + F.col("event_id") % 100 / 100, 2).alias("time"), F.col("event_type").alias("text")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("lines"))
_TL = "(SELECT doc_id, pos, event_type, round(time % 5940 + (event_id % 100) / 100, 2) AS t FROM {timed_line}) x"


@query("lrc", sql=f"SELECT doc_id, string_agg({_LRC}, chr(10) ORDER BY t, pos) || chr(10) AS lrc FROM {_TL} GROUP BY 1")
def lrc_format(lrc):
    return lrc.select("doc_id", timed.format_lines(F.col("lines")).alias("lrc"))


@query("lrc", sql=f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY t, pos) - 1 AS INT) AS pos, t AS time, event_type AS text FROM {_TL}")
def lrc_parse(lrc):
    return lrc.select("doc_id", F.explode(timed.parse_lines(timed.format_lines(F.col("lines")))).alias("x")).select("doc_id", "x.*")


@query("lrc", sql=f"""WITH g AS (SELECT doc_id, pos, t, t - lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS d, t - lag(t) OVER (PARTITION BY doc_id ORDER BY t) AS gap FROM {_TL}),
    s AS (SELECT doc_id, count(*) AS n, count(DISTINCT t) AS k, max(t) AS mx, bool_or(d < 0) AS back, median(gap) AS med, CAST(doc_id % 3 * 3000 AS DOUBLE) AS duration FROM g GROUP BY 1)
    SELECT doc_id, n AS line_count, array_to_string(list_filter([CASE WHEN n >= 2 AND k = 1 THEN 'all-timestamps-identical' END, CASE WHEN NOT (n >= 2 AND k = 1) AND n >= 4 AND k / n < 0.3 THEN 'low-distinct-timestamps' END,
    CASE WHEN duration > 0 AND n >= 2 AND mx < duration * 0.5 AND med <= 2.0 THEN 'timestamps-crammed-early' END, CASE WHEN back THEN 'non-monotonic' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def lrc_audit(lrc):
    return lrc.select("doc_id", F.size("lines").cast("long").alias("line_count"), F.array_join(timed.audit(F.col("lines"), (F.col("doc_id") % 3 * 3000).cast("double"), F.lit(True)), ",").alias("reasons"))


@query("timed_line", sql="""WITH l AS (SELECT doc_id, pos, CASE WHEN event_id % 3 = 0 AND doc_id % 10 <> 0 THEN time END AS t FROM {timed_line}), a AS (SELECT doc_id, min(pos) AS fi, max(pos) AS li, min_by(t, pos) AS ft, max_by(t, pos) AS lt FROM l WHERE t IS NOT NULL GROUP BY 1),
    w AS (SELECT l.*, a.fi, a.li, a.ft, a.lt, CASE WHEN li > fi THEN (lt - ft) / (li - fi) ELSE 3.0 END AS gap, last_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p, last_value(t IGNORE NULLS) OVER b AS pt, first_value(CASE WHEN t IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS n, first_value(t IGNORE NULLS) OVER f AS nt
      FROM l LEFT JOIN a ON a.doc_id = l.doc_id WINDOW b AS (PARTITION BY l.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY l.doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    v AS (SELECT doc_id, pos, CASE WHEN fi IS NULL THEN pos * 3.0 WHEN t IS NOT NULL THEN t WHEN pos < fi THEN greatest(0.0, ft - (fi - pos) * gap) WHEN pos > li THEN lt + (pos - li) * gap ELSE pt + (pos - p) / (n - p) * (nt - pt) END AS time FROM w)
    SELECT doc_id, pos, CAST(round(max(time) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) * 1000) AS BIGINT) AS ms FROM v""")
def interpolate_lines(timed_line):
    rows = timed_line.select("doc_id", "pos", F.when((F.col("event_id") % 3 == 0) & (F.col("doc_id") % 10 != 0), F.col("time")).alias("time"))
    return sequence.monotonic(sequence.interpolate(rows)).select("doc_id", "pos", F.round(F.col("time") * 1000).cast("long").alias("ms"))


@query("conversations", sql=r"""WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(text), '([\p{L}\p{N}]+''?[\p{L}\p{N}]*)', 1), lambda x: x) AS ts FROM {conversations}), u AS (SELECT conv_id, turn, len(ts) AS n, unnest(ts) AS text, CAST(unnest(range(0, len(ts))) AS INT) AS pos FROM t)
    SELECT conv_id, turn, pos, text, CAST(round((180.0 * 0.05 + pos * (180.0 * 0.9 / n)) * 1000) AS BIGINT) AS start_ms FROM u""".replace("{L}", "<L>").replace("{N}", "<N>"))
def spread_tokens(conversations):
    rows = conversations.select("conv_id", "turn", "text", F.lit(180.0).alias("duration"))
    return sequence.spread_tokens(rows, keys=("conv_id", "turn"), rounded=False).select("conv_id", "turn", "pos", "text", F.round(F.col("start") * 1000).cast("long").alias("start_ms"))


ORACLE_SQL["spread_tokens"] = ORACLE_SQL["spread_tokens"].replace("<L>", "{L}").replace("<N>", "{N}")


@query("conversations")
def align_words(conversations):
    lines = conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), "text")
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"), F.lit(180.0).alias("duration"))
    return sequence.align(lines, sequence.spread_tokens(docs), docs.select("doc_id", "duration"))


# Clocks and lineage

_SIDE = "(SELECT doc_id, actor, CAST(max(n) FILTER (WHERE side = 0) AS BIGINT) AS a, CAST(max(n) FILTER (WHERE side = 1) AS BIGINT) AS b FROM {clock} GROUP BY 1, 2) x"


def _vectors(clock):
    side = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("actor", "n")))))
    top = clock.groupBy("doc_id", "actor", "side").agg(F.max("n").cast("long").alias("n"))
    return top.groupBy("doc_id").agg(side(0).alias("a"), side(1).alias("b"))


@query("clock", sql=f"""SELECT doc_id, '{{{{' || coalesce(string_agg('"' || actor || '":' || CAST(greatest(coalesce(a, 0), coalesce(b, 0)) AS VARCHAR), ',' ORDER BY actor) FILTER (WHERE greatest(coalesce(a, 0), coalesce(b, 0)) > 0), '') || '}}}}' AS merged FROM {_SIDE} GROUP BY 1""".replace("{{{{", "<<").replace("}}}}", ">>").replace("{{", "<<").replace("}}", ">>"))
def vclock_merge(clock):
    return _vectors(clock).select("doc_id", clocks.to_json(clocks.merge(F.col("a"), F.col("b"))).alias("merged"))


ORACLE_SQL["vclock_merge"] = ORACLE_SQL["vclock_merge"].replace("<<", "{").replace(">>", "}")


@query("clock", sql=f"""SELECT doc_id, CASE WHEN ge AND le THEN 'equal' WHEN ge THEN 'after' WHEN le THEN 'before' ELSE 'concurrent' END AS relation FROM (SELECT doc_id, bool_and(coalesce(a, 0) >= coalesce(b, 0)) AS ge, bool_and(coalesce(b, 0) >= coalesce(a, 0)) AS le FROM {_SIDE} GROUP BY 1) y""")
def vclock_relation(clock):
    return _vectors(clock).select("doc_id", clocks.relation(F.col("a"), F.col("b")).alias("relation"))


@query("seen", sql="SELECT doc_id, location_id, version_id, sha, is_head, FALSE AS is_behind, NOT is_head AS is_concurrent, CAST(1 AS BIGINT) AS head_version_id FROM {folded}")
def lineage_batch(seen):
    return lineage.lineage(seen)


@query("seen", sql="SELECT doc_id, winner_location, CAST(1 AS BIGINT) AS winner_version, loser_version, doc_id % 2 <> 0 AS opens FROM {target_conflicts}")
def lineage_conflicts(seen):
    return lineage.conflicts(lineage.lineage(seen), TARGET, seen.where("doc_id % 2 = 0").select("doc_id"))


from stowage.plans import field_queries  # noqa: E402, F401  (registers more)
