"""More registered queries: keys, fields, tags, releases, lookups, stores, inventory, retiming and streams, each with its SQL."""

import functools
import uuid

from pyspark.sql import functions as F

from stowage.functions import clocks, keys, releases, tags, text, timed
from stowage.operators import gates, lineage, ordered, relational, resolve, sequence
from stowage.plans import inventory, reconcile
from stowage.plans.queries import _UUID, BINDINGS, MADE, bound, query
from stowage.scratch import new_folder
from stowage.sources import catalogs, events, files, paged, sqlite
from stowage.streaming import flows

#: A name-based UUID of what ``_UUID`` hashes.
_AS_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"

BINDINGS |= {
    "token": """SELECT s_suppkey AS id, concat('  ', s_name, ' ') AS name, CASE s_suppkey % 6 WHEN 0 THEN concat(' ', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat('shop:', CAST(s_suppkey AS STRING)) WHEN 2 THEN ':9' WHEN 3 THEN 'shop:' WHEN 4 THEN '' ELSE concat('a:b:', CAST(s_suppkey AS STRING)) END AS token FROM {supplier}""",
    "link": """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN concat('https://x.org/', c_name) WHEN 1 THEN concat('HTTP://x/', c_name) WHEN 2 THEN 'javascript:alert(1)' WHEN 3 THEN concat('ftp://x/', c_name) WHEN 4 THEN concat(' https://y/', c_name) ELSE c_name END AS url,
        CASE c_custkey % 5 WHEN 0 THEN concat('/a/', c_name) WHEN 1 THEN concat('a/../', c_name) WHEN 2 THEN '..' WHEN 3 THEN concat('a..b/', c_name) ELSE concat('a/', c_name) END AS path FROM {customer}""",
    "field": """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN 'x19' WHEN 2 THEN '0' WHEN 3 THEN ' 1999 ' ELSE concat(CAST(1900 + c_custkey % 99 AS STRING), '-03-02') END AS date, CASE c_custkey % 4 WHEN 0 THEN concat(CAST(c_custkey AS STRING), '/12') WHEN 1 THEN 'x/3' WHEN 2 THEN CAST(c_custkey AS STRING) ELSE '' END AS track,
        CASE c_custkey % 4 WHEN 0 THEN concat('..', c_name, '/b..') WHEN 1 THEN ' . ' WHEN 2 THEN concat(' ', c_name, ' ') ELSE '' END AS name, concat(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('lib/', c_mktsegment, '/') END, c_name) AS directory, c_custkey * 97531 + 1 AS n FROM {customer}""",
    "run": """SELECT o_orderpriority AS kind, o_orderkey AS id, @epoch(o_orderdate) AS started_utc, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'running' END AS status FROM {orders}""",
    "conflict": """SELECT o_orderkey AS id, o_custkey AS audio_id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status FROM {orders}""",
    "release": """SELECT p_partkey AS id, p_partkey AS ordinal, p_brand AS brand, p_type AS kind, p_name AS name, CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' = ', p_brand) WHEN 1 THEN ' ' ELSE concat(' ', p_name) END AS title, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1990 + CAST(p_partkey % 30 AS INT) END AS year, CAST(p_size AS INT) AS size FROM {part}""",
    "track": """SELECT doc_id, rel_path, concat('id', CAST(doc_id % 211 AS STRING), '/', lang) AS identity, lang AS artist, source AS album, concat('t', CAST(doc_id % 211 AS STRING)) AS title, CAST(n_chars AS BIGINT) AS byte_size FROM (SELECT f.doc_id, f.rel_path, d.lang, d.source, d.n_chars FROM {file} f JOIN {documents} d ON d.doc_id = f.doc_id) x WHERE rel_path NOT LIKE '%.lrc'""",
    "spoken": """SELECT doc_id, pos, concat('w', CAST(pos AS STRING), 'x (aside) w', CAST(pos AS STRING), 'y') AS text FROM {lines}""",
    "stored_version": """SELECT doc_id, CAST(1 AS BIGINT) AS version_id, concat('a', CAST(doc_id AS STRING)) AS sha, '{{"p":1}}' AS vclock FROM {doc} UNION ALL SELECT doc_id, CAST(2 AS BIGINT), concat('b', CAST(doc_id AS STRING)), '{{"p":2}}' FROM {doc}""",
    "doc": "SELECT DISTINCT user_id AS doc_id FROM {events}",
}


# Keys and small fields


@query("token", sql=f"""SELECT id, {_AS_UUID} AS location_key, 'shop:' || id AS item_key, CASE id % 6 WHEN 0 THEN 'shop:' || id WHEN 1 THEN 'shop:' || id WHEN 5 THEN 'a:b:' || id END AS resolved FROM (SELECT *, {_UUID % "'stowage:location:' || lower(trim(name))"} AS h FROM {{token}}) x""")
def stable_keys(token):
    return token.select("id", keys.location_key(F.col("name")).alias("location_key"), keys.item_key(F.lit("shop"), F.col("id").cast("string")).alias("item_key"), keys.resolve_key(F.col("token"), "shop").alias("resolved"))


@query("link", sql="SELECT id, CASE WHEN id % 6 IN (0, 1, 4) THEN url END AS url, id % 5 > 2 AS safe FROM {link}")
def safe_links(link):
    return link.select("id", text.safe_url(F.col("url")).alias("url"), text.safe_path(F.col("path")).alias("safe"))


@query("field", sql="""SELECT id, CASE id % 5 WHEN 0 THEN nullif(CAST(id AS INT), 0) WHEN 3 THEN 1999 END AS year, left(date, 4) AS date_year, CASE WHEN id % 4 IN (0, 2) THEN CAST(id AS INT) END AS number,
    CASE id % 4 WHEN 0 THEN regexp_extract(name, '^\\.\\.(.*)/', 1) || '_b' WHEN 1 THEN 'Unknown' WHEN 2 THEN trim(name) ELSE 'Unknown' END AS safe,
    CASE WHEN id % 3 = 0 THEN directory ELSE regexp_extract(directory, '^lib/([^/]*)/', 1) || ' - ' || regexp_extract(directory, '([^/]*)$', 1) END AS label,
    CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size,
    CASE WHEN n % 50000 >= 3600 THEN printf('%d:%02d:%02d', CAST(n % 50000 // 3600 AS BIGINT), CAST(n % 50000 // 60 % 60 AS BIGINT), CAST(n % 60000000 % 50000 % 60 AS BIGINT)) ELSE printf('%d:%02d', CAST(n % 50000 // 60 AS BIGINT), CAST(n % 50000 % 60 AS BIGINT)) END AS eta,
    CASE WHEN length(directory) <= 12 THEN directory ELSE left(directory, 5) || '…' || right(directory, 6) END AS cut FROM {field}""")
def small_fields(field):
    n = F.col("n")
    return field.select(
        "id", text.year(F.col("date")).alias("year"), text.date_year(F.col("date")).alias("date_year"), text.first_number(F.col("track")).alias("number"), text.safe_name(F.col("name")).alias("safe"), text.directory_label(F.col("directory")).alias("label"),
        text.human_bytes(n).alias("size"), text.human_eta(F.col("n") % 50000).alias("eta"), text.middle_cut(F.col("directory"), 12).alias("cut"),
    )


@query("field", sql="""SELECT id, CAST(CASE id % 4 WHEN 0 THEN least(id % 500, 300) WHEN 1 THEN 100 WHEN 2 THEN 60 ELSE 0 END AS DOUBLE) AS wait, CASE id % 4 WHEN 0 THEN directory || ' — t' || id WHEN 1 THEN directory WHEN 2 THEN 't' || id ELSE 'k' || id END AS label, 'n' || id AS bare FROM {field}""")
def waits_and_labels(field):
    k = F.col("id")
    now = F.unix_timestamp(F.lit("2015-10-21 07:28:00")) - 100
    header = F.when(k % 4 == 0, F.concat(F.lit(" "), (k % 500).cast("string"))).when(k % 4 == 1, "Wed, 21 Oct 2015 07:28:00 GMT").when(k % 4 == 2, "soon").otherwise("-5")
    name, shown = F.when(k % 4 < 2, F.col("directory")).otherwise(""), F.when(k % 4 % 2 == 0, F.concat(F.lit("t"), k.cast("string")))
    mixed = F.concat(F.when(k % 2 == 0, "夜想曲 / ").otherwise(""), F.lit("n"), k.cast("string"), F.when(k % 2 == 1, " - 昼").otherwise(""))
    return field.select("id", text.retry_seconds(header, now).alias("wait"), text.label(name, shown, F.concat(F.lit("k"), k.cast("string"))).alias("label"), text.strip_cjk(mixed).alias("bare"))


@query("documents", sql="""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(coalesce(text, '')) ELSE @sha('x' || coalesce(text, '')) END AS identity, CASE WHEN doc_id % 3 = 0 THEN 'audio_md5' ELSE 'file_sha256' END AS identity_kind, CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS image,
    @sha(regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g')) AS ascii_sha FROM {documents}""".replace("@sha", "sha256"))
def content_keys(documents):
    said = F.coalesce("text", F.lit(""))
    flac = F.concat(F.lit(b"fLaC"), F.unhex(F.lit("00" * 22)), F.unhex(F.md5(said.cast("binary"))), F.lit(b"rest"))
    content = F.when(F.col("doc_id") % 3 == 0, flac).otherwise(F.concat(F.lit(b"x"), said.cast("binary")))
    image = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), said.cast("binary"))).otherwise(said.cast("binary"))
    return documents.select("doc_id", keys.content_identity(content).alias("k"), text.image_kind(image).alias("image"), F.sha2(text.ascii_fold(said), 256).alias("ascii_sha")).select("doc_id", "k.*", "image", "ascii_sha")


# Releases and tags


def _releases(flat):
    artist = lambda name, anv, join: F.struct(name.alias("name"), anv.alias("anv"), F.lit(join).alias("join"), F.lit(1).cast("long").alias("id"))
    none, k = F.lit(""), F.col("id")
    artists = F.when(k % 3 == 0, F.array(artist(F.col("brand"), none, ""))).when(k % 3 == 1, F.array(artist(F.col("brand"), F.col("kind"), ","), artist(F.col("name"), none, ""))).otherwise(F.array(artist(F.lit("Various"), none, "")))
    form = lambda n: F.struct(F.lit(n).alias("name"), F.lit("1").alias("qty"), F.array(F.lit("Album")).alias("descriptions"), none.alias("text"))
    s = F.col("size") % 6
    formats = F.when(s == 0, F.array(form("CD"))).when(s == 1, F.array(form(" Vinyl "))).when(s == 2, F.array(form("Cassette"), form("DAT"))).when(s == 3, F.array(form("File"))).when(s == 4, F.array(form("Weird"))).otherwise(F.array(form("Vinyl"), form("SACD")))
    label = lambda c: F.struct(F.lit("l").alias("name"), c.alias("catno"))
    labels = F.when(k % 10 == 3, F.array(label(F.lit("None")))).otherwise(F.array(label(F.lit("none")), label(F.lit("  ")), label(F.concat(F.lit(" CAT-"), k.cast("string")))))
    info = F.struct(k.alias("id"), F.col("title"), F.col("year"), F.when(k % 2 == 0, F.lit("t.jpg")).otherwise("").alias("thumb"), formats.alias("formats"), labels.alias("labels"), artists.alias("artists"))
    return flat.select(F.when(k % 7 != 0, k).alias("id"), k.alias("instance_id"), F.lit("").alias("date_added"), info.alias("basic_information"), "ordinal")


@query("release", sql="""SELECT CAST(id AS VARCHAR) AS source_id, 'shop:' || id AS item_key, CASE id % 3 WHEN 0 THEN brand WHEN 1 THEN kind || ', ' || name ELSE 'Various' END AS artist, trim(title) AS title,
    CASE size % 6 WHEN 0 THEN 'cd' WHEN 1 THEN 'vinyl' WHEN 2 THEN 'cassette' WHEN 3 THEN 'digital' WHEN 4 THEN 'other' ELSE 'cd,vinyl' END AS media, nullif(year, 0) AS year, CASE WHEN id % 10 <> 3 THEN 'CAT-' || id END AS catno,
    CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN brand || ' ' || name || '|' || kind || '|' || brand ELSE 'Various Artists' END AS artist_alts, CASE WHEN id % 5 = 0 THEN name || '|' || brand ELSE '' END AS title_alts,
    'https://x/' || id AS url, CASE WHEN id % 2 = 0 THEN 't.jpg' END AS thumb_url FROM {release} WHERE trim(title) <> ''""")
def release_items(release):
    items = releases.to_items(_releases(release), "shop", "https://x/")
    return items.select("source_id", "item_key", "artist", "title", F.array_join("media", ",").alias("media"), "year", "catno", F.array_join("artist_alts", "|").alias("artist_alts"), F.array_join("title_alts", "|").alias("title_alts"), "url", "thumb_url")


def _shown(m):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")


def _tagged(customer):
    k, name = F.col("c_custkey"), F.col("c_name")
    pairs = [
        ("album", F.concat(F.lit("E't'e' "), k.cast("string"))), ("albumartist", name), ("artist", F.when(k % 5 == 0, F.concat(name, F.lit(" feat. Guest"))).otherwise(name)), ("comment", F.when(k % 3 == 0, F.lit("see BANDCAMP.com")).otherwise("x")),
        ("date", F.concat((F.lit(1900) + k % 99).cast("string"), F.lit("-03-02"))), ("title", F.col("c_mktsegment")), ("year", F.lit("1999")),
    ]
    entry = F.map_from_arrays(F.array(*[F.lit(p) for p, _ in pairs]), F.array(*[F.array(v) for _, v in pairs]))
    return customer.select(k.alias("id"), F.when(k % 4 == 3, F.map_filter(entry, lambda t, _: t != "year")).otherwise(entry).alias("tags"), F.concat(F.lit("/in/A - B - "), F.when(k % 2 == 0, F.lit("Été ")).otherwise("Ete "), k.cast("string"), F.lit("/")).alias("directory"))


@query("customer", sql="""SELECT c_custkey AS id, 'album=' || CASE WHEN c_custkey % 6 = 0 THEN 'Été ' || c_custkey ELSE 'E''t''e'' ' || c_custkey END || ';albumartist=' || c_name || ';artist=' || c_name || ';comment=' || CASE WHEN c_custkey % 3 = 0 THEN 'see BANDCAMP.com' ELSE 'x' END
    || ';date=' || (1900 + c_custkey % 99) || '-03-02;title=' || c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN ' (feat. Guest)' ELSE '' END AS tags, c_custkey % 4 <> 3 OR c_custkey % 5 = 0 OR c_custkey % 6 = 0 AS changed FROM {customer}""")
def tags_before_import(customer):
    return tags.clean_before(_tagged(customer)).select("id", _shown(F.col("tags")).alias("tags"), "changed")


@query("customer", sql="""SELECT c_custkey AS id, 'album=E''t''e'' ' || c_custkey || ';albumartist=' || c_name || ';artist=' || c_name || CASE WHEN c_custkey % 5 = 0 THEN ' feat. Guest' ELSE '' END || ';comment=' || CASE WHEN c_custkey % 3 = 0 THEN 'see BANDCAMP.com' ELSE 'x' END
    || ';date=' || (1900 + c_custkey % 99) || ';title=' || c_mktsegment AS tags, TRUE AS changed FROM {customer}""")
def tags_after_import(customer):
    return tags.clean_after(_tagged(customer)).select("id", _shown(F.col("tags")).alias("tags"), "changed")


@query("field", sql="""SELECT id, CAST(CASE id % 4 WHEN 0 THEN id % 3 + 1 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 1 END AS INT) AS disc_no, CAST(CASE id % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 1 END AS INT) AS disc_total FROM {field}""")
def disc_numbers(field):
    one = lambda **v: F.map_from_arrays(F.array(*[F.lit(c) for c in v]), F.array(*[F.array(x) for x in v.values()]))
    k = F.col("id")
    given = F.when(k % 4 == 0, one(discnumber=(k % 3 + 1).cast("string"), disctotal=F.lit("4"))).when(k % 4 == 1, one(discnumber=F.lit("x"), totaldiscs=F.lit("4"))).when(k % 4 == 2, one(TPOS=F.lit("3/5"))).otherwise(one(other=F.lit("9")))
    return field.select("id", tags.disc(given).alias("d")).select("id", "d.*")


# Latest rows, lookups and upkeep


@query("presence", sql="""SELECT content_id, location_id, rel_path, observed_utc FROM (SELECT *, row_number() OVER (PARTITION BY location_id, rel_path ORDER BY observed_utc DESC, content_id DESC) AS rn FROM (SELECT content_id, location_id, present, left(rel_path, 3) AS rel_path, observed_utc FROM {presence} WHERE present) y) x WHERE rn = 1""")
def at_path(presence):
    return relational.at_path(presence.withColumn("rel_path", F.substring("rel_path", 1, 3)).select("content_id", "location_id", "present", "rel_path", "observed_utc")).select("content_id", "location_id", "rel_path", "observed_utc")


@query("run", sql="SELECT kind, id, started_utc, status FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY started_utc DESC, id DESC) AS rn FROM {run}) x WHERE rn = 1")
def latest_runs(run):
    return relational.latest_run(run)


@query("conflict", sql="SELECT max(id) AS id, audio_id, 'open' AS status FROM {conflict} WHERE status = 'open' GROUP BY audio_id")
def open_conflicts(conflict):
    return relational.open_conflict(conflict)


@query("name", sql="SELECT nation, min_by(artist, id) AS artist, min_by(albumartist, id) AS albumartist FROM {name} WHERE albumartist <> '' GROUP BY 1")
def first_known(name):
    return relational.first_known(name, ["nation"], ["albumartist"], "id").join(relational.first_known(name.where("albumartist <> ''"), ["nation"], ["artist"], "id"), "nation").select("nation", "artist", "albumartist")


@query("conflict", sql="SELECT id, audio_id, status FROM {conflict} WHERE status = 'open' ORDER BY id LIMIT 1")
def first_open(conflict):
    return relational.first_by(conflict, F.col("status") == "open", "id")


@query("name", sql="SELECT id, artist, place FROM (SELECT id, artist, CAST(row_number() OVER (PARTITION BY nation ORDER BY translate(artist, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id) AS INT) AS place FROM {name}) x WHERE place <= 3")
def top_by_name(name):
    order = [text.ascii_lower(F.col("artist")), F.col("id")]
    first = relational.top(name, ["nation"], order, 3)
    return first.withColumn("place", F.row_number().over(relational.Window.partitionBy("nation").orderBy(*order))).select("id", "artist", "place")


@query("scan", "conflict", sql="SELECT id, audio_id AS \"audio_id\", id AS doc, CASE WHEN id % 5 = 0 THEN id ELSE 42 END AS created_utc FROM (SELECT DISTINCT audio_id, audio_id AS id FROM {conflict}) x")
def ensure_docs(scan, conflict):
    audio = conflict.select("audio_id")
    docs = audio.distinct().where("audio_id % 5 = 0").select(F.col("audio_id").alias("id"), "audio_id", F.col("audio_id").alias("created_utc"), F.col("audio_id").alias("updated_utc"))
    return relational.ensure_docs(docs, audio, 42).select("id", "audio_id", F.col("id").alias("doc"), "created_utc")


@query("conflict", sql="SELECT id, audio_id, CASE WHEN audio_id % 4 = 0 THEN 'resolved' ELSE status END AS status FROM {conflict} WHERE id % 10 <> 0 UNION ALL SELECT id + 100000000, audio_id, status FROM {conflict} WHERE id % 10 = 0")
def table_upkeep(conflict):
    kept = relational.remove(conflict, conflict.where("id % 10 = 0").select("id"))
    marked = relational.mark(kept, F.col("audio_id") % 4 == 0, status="resolved")
    return relational.append(marked, conflict.where("id % 10 = 0").withColumn("id", F.col("id") + 100000000))


@query("conflict", sql="SELECT id, audio_id, status, CAST(NULL AS VARCHAR) AS note, TRUE AS seen FROM {conflict}")
def migrated(conflict):
    steps = [(3, lambda t: t.withColumn("seen", F.lit(True))), (1, lambda t: t.withColumn("status", F.lit("lost"))), (2, inventory.add_columns(note="string", status="string"))]
    return inventory.migrate(conflict, 1, steps)[0]


@query("conflict", "customer", sql="SELECT id, audio_id, status FROM {conflict} WHERE audio_id NOT IN (SELECT c_custkey FROM {customer} WHERE c_custkey % 3 <> 0)")
def orphan_rows(conflict, customer):
    return relational.orphans(conflict, customer.where("c_custkey % 3 <> 0"), "audio_id", "c_custkey")


@query("queue", "location", sql="SELECT q.id, q.rel_path, l.name, l.enabled FROM {queue} q LEFT JOIN {location} l ON l.location_id = q.dest_location_id WHERE q.content_kind = 'audio' AND q.run_id = 3")
def filtered_lookup(queue, location):
    chosen = relational.where_optional(queue, content_kind="audio", run_id=3, action_kind=None)
    return relational.lookup(chosen, location.withColumnRenamed("location_id", "dest_location_id"), ["dest_location_id"], ["name", "enabled"]).select("id", "rel_path", "name", "enabled")


@query("album", sql="SELECT CASE ordinal % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, count(*) AS n FROM {album} GROUP BY 1")
def source_counts(album):
    return resolve.source_counts(album.withColumn("source", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("ordinal") % 3 + 1).cast("int"))))


@query("supplier", sql=f"""WITH c AS (SELECT s_suppkey AS o, 'Place ' || (s_suppkey % 40) AS name, '/c' || s_suppkey AS root, s_suppkey % 4 <> 1 AS enabled FROM {{supplier}} WHERE s_suppkey % 2 = 0), g AS (SELECT s_suppkey AS o, 'place ' || (s_suppkey % 60) AS name, '/g' || s_suppkey AS root, s_suppkey % 5 <> 1 AS enabled FROM {{supplier}} WHERE s_suppkey % 2 = 1),
    u AS (SELECT 0 AS rank, 0 AS o, 'Pending' AS name, NULL AS root, TRUE AS a UNION ALL SELECT 1, o, name, root, FALSE FROM c WHERE enabled UNION ALL SELECT 2, o, name, root, FALSE FROM g WHERE enabled),
    b AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY rank, o DESC) AS rn FROM u)
    SELECT name, root AS root_path, a AS is_authoritative, {_AS_UUID} AS uuid FROM (SELECT *, {_UUID % "'stowage:location:' || lower(trim(name))"} AS h FROM b WHERE rn = 1) x""")
def location_registry(supplier):
    k = F.col("s_suppkey")
    made = lambda part, word, n, m, at: supplier.where(part).select(k.alias("ordinal"), F.concat(F.lit(word), (k % n).cast("string")).alias("name"), F.lit("library").alias("kind"), F.concat(F.lit(at), k.cast("string")).alias("root_path"), F.lit(False).alias("is_authoritative"), F.lit(False).alias("is_retention"), (k % m != 1).alias("enabled"))
    return reconcile.registry(made(k % 2 == 0, "Place ", 40, 4, "/c"), made(k % 2 == 1, "place ", 60, 5, "/g")).select("name", "root_path", "is_authoritative", "uuid")


# Files and stores


@query("file", sql=r"""SELECT rel_path, CASE WHEN rel_path LIKE '%.lrc' THEN 'sidecar' ELSE 'audio' END AS kind, CASE WHEN rel_path LIKE '%.lrc' THEN 'lrc' END AS role FROM {file} UNION ALL SELECT 'c/' || doc_id || '/' || CASE doc_id % 4 WHEN 0 THEN 'Cover.JPG' WHEN 1 THEN '.nolrc' WHEN 2 THEN 'a.nolrc' ELSE 'x.OGG' END,
    CASE WHEN doc_id % 4 = 3 THEN 'audio' ELSE 'sidecar' END, CASE doc_id % 4 WHEN 0 THEN 'cover' WHEN 3 THEN NULL ELSE 'nolrc' END FROM {file}""")
def file_roles(file):
    other = F.concat(F.lit("c/"), F.col("doc_id").cast("string"), F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in ("Cover.JPG", ".nolrc", "a.nolrc", "x.OGG")]), (F.col("doc_id") % 4 + 1).cast("int")))
    junk = file.select(F.concat("rel_path", F.lit(".txt")).alias("rel_path"))
    return files.tree(file.select("rel_path").unionByName(file.select(other.alias("rel_path"))).unionByName(junk)).select("rel_path", "kind", "role")


@query("file", sql="SELECT DISTINCT regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS directory FROM {file} WHERE rel_path NOT LIKE '%.lrc'")
def album_directories(file):
    return files.album_directories(file)


@query("documents", sql="""WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || source || '-' || lang || (doc_id % 5) AS directory, doc_id FROM {documents}), g AS (SELECT directory, count(*) FILTER (WHERE doc_id % 3 <> 0) AS n, min(CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN directory || '/' || doc_id || '.log' END) AS log FROM d GROUP BY 1)
    SELECT CASE WHEN log IS NOT NULL THEN 'log' ELSE 'dir' END AS kind, coalesce(log, directory) AS path FROM g WHERE n > 0 AND directory NOT LIKE '.%' UNION ALL SELECT 'log', doc_id || '.log' FROM {documents} WHERE doc_id % 11 = 0""")
def staging_order(documents):
    k = F.col("doc_id")
    folder = F.concat(F.when(k % 7 == 0, ".").otherwise(""), "source", F.lit("-"), "lang", (k % 5).cast("string"))
    name = F.concat(k.cast("string"), F.when(k % 3 != 0, ".flac").when(k % 2 == 0, ".log").otherwise(".txt"))
    rows = documents.select(F.concat_ws("/", folder, name).alias("rel_path")).unionByName(documents.where("doc_id % 11 = 0").select(F.concat(k.cast("string"), F.lit(".log")).alias("rel_path")))
    return files.staging(rows)


@query("file", sql=r"""WITH f AS (SELECT regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS directory, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\.[^./]*$', '') AS stem, rel_path, regexp_extract(rel_path, '\.([^.]*)$', 1) AS ext, doc_id FROM {file}),
    a AS (SELECT directory, stem, min_by(rel_path, ext) AS audio FROM f WHERE ext <> 'lrc' GROUP BY 1, 2) SELECT f.doc_id, f.directory, f.stem, a.audio FROM f LEFT JOIN a ON a.directory = f.directory AND a.stem = f.stem WHERE ext = 'lrc'""")
def text_siblings(file):
    path = F.col("rel_path")
    named = file.select("doc_id", text.parent(path).alias("directory"), text.stem(text.file_name(path)).alias("stem"), "rel_path", text.extension(path).alias("ext"))
    return files.sibling(named.where("ext = 'lrc'").select("doc_id", "directory", "stem"), named.where("ext <> 'lrc'").select("directory", "stem", "rel_path", "ext"))


@query("album", sql="SELECT ordinal, trim(albumartist) AS albumartist, album, CASE WHEN ordinal % 3 = 0 THEN 1980 + CAST(ordinal % 40 AS INT) END AS year, ext_id FROM {album} WHERE ordinal % 8 <> 1 AND ordinal % 13 <> 1")
def listing_lines(album):
    k = F.col("ordinal")
    line = F.concat_ws(catalogs.SEPARATOR, F.concat("albumartist", F.lit(" ")), F.when(k % 13 == 1, " ").otherwise(F.col("album")), F.when(k % 3 == 0, (F.lit(1980) + k % 40).cast("string")).when(k % 3 == 1, "0").otherwise("soon"), F.coalesce("ext_id", F.lit("")))
    return catalogs.parse_listing(album.select("ordinal", F.when(k % 8 == 1, "too short").otherwise(line).alias("value")))


@query("album", sql="SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN NULL ELSE albumartist END AS artist, CASE WHEN ordinal % 4 = 0 THEN NULL ELSE album END AS album FROM {album}")
def rip_headers(album):
    k = F.col("ordinal")
    log = F.concat_ws("\n", F.lit("X Lossless Decoder version 1"), F.lit(""), F.when(k % 4 == 0, F.lit("Used drive : X")).otherwise(F.concat("albumartist", F.lit(" / "), "album")), F.lit("Used drive : a / b"), F.lit("c / d"))
    return album.select("ordinal", files.rip_identity(log).alias("i")).select("ordinal", F.col("i.artist").alias("artist"), F.col("i.album").alias("album"))


@query("customer", sql="""SELECT 'fixture' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey ELSE CAST(row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) - 1 AS VARCHAR) END AS source_id, c_name AS title,
    CASE c_custkey % 3 WHEN 0 THEN 'cd' WHEN 1 THEN 'vinyl' ELSE 'other,cd' END AS media, CASE WHEN c_custkey % 2 = 0 THEN CAST(1970 + c_custkey % 50 AS INTEGER) END AS year FROM {customer}""")
def hand_written_items(customer):
    """Many collections of at most forty items, a text each."""
    k = F.col("c_custkey")
    item = F.struct(F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("id"), F.col("c_name").alias("title"), F.when(k % 3 == 1, F.lit("Vinyl")).when(k % 3 == 2, F.lit('["tape?","CD"]')).alias("media"), F.when(k % 2 == 0, 1970 + k % 50).cast("string").alias("year"))
    held = customer.groupBy(F.floor(k / 40)).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("v")))).alias("held"))
    texts = held.select(F.to_json(F.struct(F.transform("held", lambda x: x["v"]).alias("items"))).alias("value"))
    return catalogs.hand_written(customer.sparkSession, texts).select("source", "source_id", "title", F.array_join("media", ",").alias("media"), "year")


@query("album", sql="""SELECT '{"item_key":"c:' || ordinal || '","status":"missing","reason":"x","score":' || CASE WHEN ordinal % 2 = 0 THEN '0.123' ELSE '1.0' END || ',"ignored":' || CASE WHEN ordinal % 3 = 0 THEN 'true' ELSE 'false' END || ',"matched":{"albumartist":"' || albumartist || '","album":"' || album || '"}}' AS value FROM {album}""")
def audit_report(album):
    k = F.col("ordinal")
    rows = album.select(F.concat(F.lit("c:"), k.cast("string")).alias("item_key"), F.lit("missing").alias("status"), F.lit("x").alias("reason"), F.when(k % 2 == 0, 0.12345).otherwise(1.0).alias("score"), (k % 3 == 0).alias("ignored"), "albumartist", "album")
    return catalogs.report(rows)


@query("album", sql="SELECT ordinal, albumartist, album, item_id, text FROM (SELECT ordinal, albumartist, album, ordinal + 5 AS item_id, '[00:01.00]' || album AS text FROM {album}) x WHERE album <> ''")
def stored_catalogs(album):
    """Written and read back through the sources: a stored table, a foreign catalog's export, timed texts, an ignore list."""
    spark, folder = album.sparkSession, new_folder(album.sparkSession)
    album.select("ordinal", "albumartist", "album").unionByName(album.select("ordinal", "albumartist", F.when(F.col("ordinal") % 2 == 0, "").alias("album"))).write.parquet(f"{folder}/albums")
    album.select(F.col("ordinal").cast("string").cast("binary").alias("path"), (F.col("ordinal") + 5).alias("id")).write.parquet(f"{folder}/index")
    album.select(F.concat(F.col("ordinal").cast("string"), F.lit("\x1f[00:01.00]"), "album").alias("value")).write.text(f"{folder}/texts")
    index = catalogs.foreign_index(spark, f"{folder}/index").select(F.col("path").cast("string").cast("long").alias("ordinal"), "item_id")
    lines = files.texts(spark, f"{folder}/texts", "txt").select(F.explode(F.split(F.trim("text"), "\n")).alias("line"))
    said = lines.select(F.split("line", "\x1f")[0].cast("long").alias("ordinal"), F.split("line", "\x1f")[1].alias("text"))
    return catalogs.stored_albums(spark, f"{folder}/albums").join(index, "ordinal").join(said, "ordinal").select("ordinal", "albumartist", "album", "item_id", "text")


@query("customer", sql="SELECT 'c:' || c_custkey AS item_key, c_name AS artist, 'T' AS title, CASE WHEN c_custkey % 2 = 0 THEN 'lost' END AS reason, CAST(c_custkey AS BIGINT) AS ignored_utc FROM {customer}")
def ignore_list(customer):
    """The ignore lists of many owners, written as documents and read back."""
    folder = new_folder(customer.sparkSession)
    k = F.col("c_custkey")
    rows = customer.select(F.floor(k / 40).alias("owner"), F.concat(F.lit("c:"), k.cast("string")).alias("item_key"), F.col("c_name").alias("artist"), F.lit("T").alias("title"), F.when(k % 2 == 0, "lost").alias("reason"), k.cast("long").alias("ignored_utc"))
    catalogs.ignored_document(rows, "owner").select("value").write.text(folder)
    return catalogs.read_ignored(customer.sparkSession, folder, whole=False)


def _page_store(folder: str):
    """A service whose pages lie in a folder, by number; it tells how many there are."""

    def fetch(url: str, headers: dict) -> tuple[int, dict, bytes]:
        import pyarrow.fs as pafs

        store, base = pafs.FileSystem.from_uri(folder)
        (part,) = [i.path for i in store.get_file_info(pafs.FileSelector(f"{base}/page={url.rsplit('=', 1)[1]}")) if i.base_name.startswith("part-")]
        with store.open_input_stream(part) as f:
            return 200, {}, f.read()

    return fetch


@query("customer", sql="SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS title, CAST(c_custkey AS BIGINT) AS ordinal FROM {customer}")
def cached_releases(customer):
    """Pages of a service, fetched by tasks into a cache, and read again from the cache alone."""
    spark, folder = customer.sparkSession, new_folder(customer.sparkSession)
    k, size = F.col("c_custkey"), 50
    pages = -(-customer.count() // size)
    release = F.struct(k.alias("id"), F.struct(F.col("c_name").alias("title")).alias("basic_information"))
    held = customer.groupBy((F.floor(k / size) + 1).alias("page")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), release.alias("v")))).alias("held"))
    page = F.to_json(F.struct(F.transform("held", lambda x: x["v"]).alias("releases"), F.struct(F.lit(pages).alias("pages")).alias("pagination")))
    held.select("page", page.alias("value")).write.partitionBy("page").text(f"{folder}/service")
    paged.register(spark, "page_store", _page_store(f"{folder}/service"))
    options = {"url": "store:?page={page}", "cache": f"{folder}/cache", "streams": 8, "requestsPerMinute": 1e9}
    paged.releases(spark, size, "page_store", **options).write.format("noop").mode("overwrite").save()
    return paged.releases(spark, size, "page_store", mode="cached", **options).select("id", F.col("basic_information.title").alias("title"), "ordinal")


@query("album", sql="SELECT CAST(ordinal AS BIGINT) + 5 AS item_id, '/m/' || ordinal || '/' || albumartist AS path FROM {album}")
def foreign_catalogs(album):
    """Foreign catalogs as SQLite files, each written by a task, and read by ranges of their row ids."""
    import sqlite3

    spark, folder = album.sparkSession, new_folder(album.sparkSession)
    plain = folder.removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os

        import pandas as pd
        from pyspark import TaskContext

        os.makedirs(plain, exist_ok=True)
        part = f"{plain}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.part"
        db = sqlite3.connect(part)
        db.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, path BLOB)")
        for rows in batches:
            db.executemany("INSERT INTO items VALUES (?, ?)", [(int(i), p.encode()) for i, p in zip(rows["id"], rows["path"])])
        db.commit()
        db.close()
        name = f"{plain}/{TaskContext.get().partitionId()}.db"
        os.replace(part, name)
        yield pd.DataFrame({"name": [name]})

    rows = album.select((F.col("ordinal").cast("long") + 5).alias("id"), F.concat(F.lit("/m/"), F.col("ordinal").cast("string"), F.lit("/"), "albumartist").alias("path"))
    names = [r["name"] for r in rows.repartition(4, "id").mapInPandas(write, "name string").collect()]  # four files
    found = [sqlite.foreign_items(spark, name, partitions=4) for name in names]
    return functools.reduce(lambda a, b: a.unionByName(b), found).select("item_id", F.col("path").cast("string").alias("path"))


@query("documents", sql="SELECT DISTINCT 'created' AS event, 'lang=' || lang || '/source=' || source AS rel_path FROM {documents} UNION ALL SELECT DISTINCT 'updated', 'lang=' || lang || '/source=' || source FROM {documents} WHERE doc_id % 3 = 0")
def folder_events(documents):
    """A watched tree that Spark writes in two rounds, with a restarted query after each: folders made, then changed."""
    spark, folder = documents.sparkSession, new_folder(documents.sparkSession)
    events.register(spark)

    def keep(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    for rows in (documents, documents.where("doc_id % 3 = 0")):
        rows.select("lang", "source", F.col("doc_id").cast("string").alias("value")).repartition(4).write.mode("append").partitionBy("lang", "source").text(f"{folder}/tree")
        seen = spark.readStream.format("file_events").options(path=f"{folder}/tree", state=f"{folder}/journal", depth=2).load()
        seen.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").where(F.contains("rel_path", F.lit("/source=")) & F.col("is_dir")).select("event", "rel_path")


@query("queue", sql="""SELECT id, action_kind, content_id FROM {queue} WHERE action_kind = 'delete' UNION ALL
    SELECT (SELECT max(id) FROM {queue} WHERE action_kind = 'delete') + row_number() OVER (ORDER BY content_id, id), action_kind, content_id FROM {queue} WHERE action_kind = 'copy'""")
def numbered_actions(queue):
    """Copies appended to the deletions, with ids of their own after the last."""
    deletes, copies = (queue.where(F.col("action_kind") == kind).select("id", "action_kind", "content_id") for kind in ("delete", "copy"))
    fresh = ordered.append_numbered(deletes, copies.withColumn("_was", F.col("id")), ["content_id", "_was"])
    return fresh.drop("_was")


# Inventory of a scan

_NOW = 5000


def _inventory(track, file):
    """Contents of even ids were known before, at another path; their albums too. All files of one location are scanned."""
    spark = track.sparkSession
    named = track.withColumns({"identity_kind": F.lit("file_sha256"), "albumartist": F.lit(None).cast("string"), "ext_id": F.lit(None).cast("string"), "file_sha256": F.sha2("identity", 256), "mtime_ns": F.col("doc_id")})
    old = track.where("doc_id % 2 = 0").select("identity", "artist", "album").distinct()
    content, album_key = F.xxhash64("identity"), keys.album_key(F.col("artist"), F.col("album"), F.lit(None).cast("string"))
    day = F.lit(7).cast("long")
    audio = old.select(content.alias("content_id"), "identity", F.lit("file_sha256").alias("identity_kind"), F.lit("old").alias("artist"), F.lit("kept").alias("album"), F.lit(None).cast("string").alias("title"), day.alias("first_seen_utc"), day.alias("last_seen_utc")).dropDuplicates(["content_id"])
    albums = old.select(album_key.alias("album_key"), "artist", "album").distinct().select(F.xxhash64("album_key").alias("album_id"), "album_key", F.col("artist").alias("albumartist"), "album", F.lit("x1").alias("ext_id"), day.alias("first_seen_utc"), day.alias("last_seen_utc"))
    links = spark.createDataFrame([], "album_id long, content_id long")
    presence = old.select(content.alias("content_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("location_id"), F.lit(True).alias("present"), F.concat(F.lit("old/"), "identity").alias("rel_path"), F.lit("s").alias("file_sha256"), day.alias("byte_size"), day.alias("mtime_ns"), day.alias("observed_utc")).dropDuplicates(["content_id", "location_id"])
    side = file.where("rel_path like '%.lrc'").select("rel_path", F.lit("lrc").alias("role"), F.lit("s").alias("file_sha256")).unionByName(file.select(text.parent(F.col("rel_path")).alias("d")).distinct().select(F.concat("d", F.lit("/cover.jpg")).alias("rel_path"), F.lit("cover").alias("role"), F.lit("s").alias("file_sha256")))
    tracks = named.select("rel_path", "identity", "identity_kind", "artist", "albumartist", "album", "title", "ext_id", "file_sha256", "byte_size", "mtime_ns")
    return inventory.inventory(1, _NOW, tracks, side, audio, presence, albums, links), audio, tracks


@query("track", "file", sql="SELECT identity, max(artist) AS artist, max(album) AS album, max(title) AS title, CASE WHEN bool_or(doc_id % 2 = 0) THEN 7 ELSE 5000 END AS first_seen_utc, CAST(5000 AS BIGINT) AS last_seen_utc FROM {track} GROUP BY 1".replace("THEN 7 ELSE 5000 END", "THEN CAST(7 AS BIGINT) ELSE 5000 END"))
def inventory_audio(track, file):
    made = _inventory(track, file)[0]["audio"]
    best = track.groupBy("identity").agg(F.max("album").alias("a"))  # of equal identities any album may stand; the largest is compared
    return made.join(best, "identity").select("identity", "artist", F.col("a").alias("album"), "title", "first_seen_utc", "last_seen_utc")


@query("track", "file", sql="SELECT artist AS albumartist, album, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'x1' END AS ext_id, CASE WHEN bool_or(doc_id % 2 = 0) THEN CAST(7 AS BIGINT) ELSE 5000 END AS first_seen_utc FROM {track} GROUP BY 1, 2")
def inventory_albums(track, file):
    return _inventory(track, file)[0]["albums"].select("albumartist", "album", "ext_id", "first_seen_utc")


@query("track", "file", sql="""SELECT identity, CAST(1 AS BIGINT) AS location_id, TRUE AS present, CAST(5000 AS BIGINT) AS observed_utc, count(*) AS files FROM {track} GROUP BY 1 UNION ALL SELECT DISTINCT identity, CAST(9 AS BIGINT), TRUE, CAST(7 AS BIGINT), CAST(0 AS BIGINT) FROM {track} WHERE doc_id % 2 = 0""")
def inventory_presence(track, file):
    made = _inventory(track, file)[0]["presence"]
    names = track.groupBy("identity").agg(F.count("*").alias("n")).withColumn("content_id", F.xxhash64("identity"))
    return made.join(names, "content_id").select("identity", "location_id", "present", "observed_utc", F.when(F.col("location_id") == 1, F.col("n")).otherwise(F.lit(0)).cast("long").alias("files"))


@query("track", "file", sql="""SELECT count(*) AS scanned, count(DISTINCT identity) FILTER (WHERE NOT known) AS new, count(DISTINCT identity) FILTER (WHERE known) AS updated FROM (SELECT identity, bool_or(doc_id % 2 = 0) OVER (PARTITION BY identity) AS known FROM {track}) x""")
def scan_counts(track, file):
    _, audio, tracks = _inventory(track, file)
    return inventory.scan_counts(audio, tracks).select("scanned", "new", "updated")


# Gates, gaps and retiming


@query("file", sql="""WITH t AS (SELECT doc_id AS track, location_id * 100 + doc_id % 23 AS group_id, doc_id % 8 <> 1 AS marked FROM {file}) SELECT group_id, track, marked FROM t WHERE NOT marked AND group_id % 7 <> 0""")
def incomplete_tracks(file):
    tracks = file.select((F.col("location_id") * 100 + F.col("doc_id") % 23).alias("group_id"), F.col("doc_id").alias("track"), (F.col("doc_id") % 8 != 1).alias("marked"))
    return gates.incomplete_tracks(tracks, tracks.where("group_id % 7 = 0").select("group_id"))


@query("file", sql="""WITH t AS (SELECT location_id * 100 + doc_id % 23 AS group_id, doc_id % 8 <> 1 AS marked FROM {file}), g AS (SELECT group_id, bool_and(marked) OR group_id % 7 = 0 AS ok FROM t GROUP BY 1) SELECT count(*) AS scanned, count(*) FILTER (WHERE ok) AS promoted, count(*) FILTER (WHERE NOT ok) AS waiting FROM g""")
def sweep_totals(file):
    tracks = file.select((F.col("location_id") * 100 + F.col("doc_id") % 23).alias("group_id"), (F.col("doc_id") % 8 != 1).alias("marked"))
    return gates.sweep_totals(gates.promotion(gates.completeness(tracks, tracks.where("group_id % 7 = 0").select("group_id"))))


@query("timed_line", sql="SELECT doc_id, pos, time - lag(time) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM {timed_line}")
def line_gaps(timed_line):
    return sequence.gaps(timed_line, ("doc_id",), "pos", "time").select("doc_id", "pos", "gap")


@query("timed_line", sql="SELECT doc_id, pos, CAST(round(CASE WHEN doc_id % 2 = 0 THEN 300.0 * (pos + 1) / (count(*) OVER (PARTITION BY doc_id) + 1) ELSE pos * 3.0 END * 1000) AS BIGINT) AS ms FROM {timed_line}")
def spread_lines(timed_line):
    """Lines without any time: over the duration where there is one, else at a fixed gap."""
    rows = timed_line.select("doc_id", "pos", F.lit(None).cast("double").alias("time"), F.when(F.col("doc_id") % 2 == 0, 300.0).otherwise(0.0).alias("duration"))
    return sequence.interpolate(rows, duration="duration").select("doc_id", "pos", F.round(F.col("time") * 1000).cast("long").alias("ms"))


@query("spoken", sql="""SELECT doc_id, string_agg(line, chr(10) ORDER BY t, marker, pos) || chr(10) AS retimed FROM (SELECT doc_id, pos, 0 AS marker, pos * CAST(2.5 AS DOUBLE) AS t, printf('[%02d:%05.2f]%s', CAST(floor(pos * 2.5 / 60) AS INT), CAST(pos * 2.5 - floor(pos * 2.5 / 60) * 60 AS DOUBLE), text) AS line FROM {spoken}
    UNION ALL SELECT DISTINCT doc_id, 0, 1, CAST(1 AS DOUBLE), '[00:01.00]' FROM {spoken}) x GROUP BY 1""")
def retime_texts(spoken):
    """Every fifth line is not heard and lies between its neighbours; a marker without text keeps its time."""
    k = F.col("pos")
    line = F.format_string("[%02d:%05.2f]%s", (k % 60).cast("int"), (k % 60).cast("double"), F.col("text"))
    texts = spoken.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n[00:01.00]\n[ar:none]")).alias("text"))
    word = lambda end, add: F.struct((k * 2 + add).cast("int").alias("pos"), F.concat(F.lit("w"), k.cast("string"), F.lit(end)).alias("text"), (k * 2.5 + add).alias("start"), F.lit(0.9).alias("confidence"))
    words = spoken.where("pos % 5 <> 4").select("doc_id", F.explode(F.array(word("x", 0), word("y", 1))).alias("w")).select("doc_id", "w.*")
    return sequence.retime(texts, words)


@query("spoken", sql="SELECT doc_id, pos, regexp_replace(text, '\\([^)]*\\)', ' ', 'g') AS bare, 'w' || pos || 'x' AS first_token, CAST(3 AS INT) AS tokens FROM {spoken}")
def line_words(spoken):
    found = timed.tokenize(F.col("text"))
    return spoken.select("doc_id", "pos", timed.strip_parentheticals(F.col("text")).alias("bare"), F.get(found, F.lit(0)).alias("first_token"), F.size(found).alias("tokens"))


# Version vectors and lineage against stored state


@query("clock", sql="""SELECT doc_id, '<' || string_agg('"' || actor || '":' || n, ',' ORDER BY actor) || '>' AS bumped FROM (SELECT doc_id, actor, max(n) + 1 AS n FROM {clock} WHERE actor = 'click' GROUP BY 1, 2 UNION ALL SELECT doc_id, actor, max(n) AS n FROM {clock} WHERE actor <> 'click' GROUP BY 1, 2 HAVING max(n) > 0
    UNION ALL SELECT doc_id, 'click', 1 FROM {clock} GROUP BY 1 HAVING count(*) FILTER (WHERE actor = 'click') = 0) x GROUP BY 1""".replace("'<'", "chr(123)").replace("'>'", "chr(125)"))
def vclock_bump(clock):
    top = clock.groupBy("doc_id", "actor").agg(F.max("n").cast("long").alias("n")).groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("actor", "n")))).alias("json"))
    return top.select("doc_id", clocks.to_json(clocks.bump(clocks.from_json(F.col("json")), F.lit("click"))).alias("bumped"))


_STORED = """SELECT doc_id, location_id, CASE kind WHEN 'same' THEN 'b' || doc_id WHEN 'old' THEN 'a' || doc_id ELSE 'new' || location_id || '/' || doc_id END AS sha, kind FROM
    (SELECT d.doc_id, CAST(l.location_id AS BIGINT) AS location_id, CASE WHEN l.location_id = 1 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'linear' ELSE 'same' END WHEN l.location_id = 2 THEN CASE WHEN d.doc_id % 4 = 0 THEN 'edit' ELSE 'old' END ELSE 'same' END AS kind FROM {doc} d CROSS JOIN (SELECT 1 AS location_id UNION ALL SELECT 2 UNION ALL SELECT 3) l) x"""


@query("doc", "stored_version", sql=f"""WITH o AS ({_STORED}) SELECT doc_id, location_id, sha, CASE WHEN kind = 'edit' THEN 'concurrent' ELSE 'behind' END AS relation FROM o WHERE kind IN ('old', 'edit') OR (kind = 'same' AND doc_id % 3 = 0)""")
def stale_copies(doc, stored_version):
    held = _against_stored(doc, stored_version)
    said = lambda rows, what: rows.select("doc_id", "location_id", "sha", F.lit(what).alias("relation"))
    return said(lineage.concurrent(held), "concurrent").unionByName(said(lineage.behind(held), "behind"))


@query("doc", "stored_version", sql=f"""WITH o AS ({_STORED}) SELECT doc_id, location_id, sha, CASE kind WHEN 'old' THEN CAST(1 AS BIGINT) WHEN 'same' THEN 2 WHEN 'linear' THEN 3 ELSE CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END END AS version_id,
    kind = 'linear' OR (kind = 'same' AND doc_id % 3 <> 0) AS is_head, kind = 'old' OR (kind = 'same' AND doc_id % 3 = 0) AS is_behind, kind = 'edit' AS is_concurrent, CASE WHEN doc_id % 3 = 0 THEN CAST(3 AS BIGINT) ELSE 2 END AS head_version_id FROM o""")
def lineage_stored(doc, stored_version):
    return _against_stored(doc, stored_version)


def _against_stored(doc, stored_version):
    """Against versions 1 and 2 (the head, which some documents have lost and adopt): location 1 holds the head and goes on
    from it in every third document, location 2 holds version 1 and edits it in every fourth, location 3 holds the head."""
    k, at = F.col("doc_id"), F.col("location_id")
    rows = doc.select("doc_id", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)])).alias("location_id"))
    own = F.concat(F.lit("new"), at.cast("string"), F.lit("/"), k.cast("string"))
    head, first = F.concat(F.lit("b"), k.cast("string")), F.concat(F.lit("a"), k.cast("string"))
    seen = rows.withColumn("sha", F.when((at == 1) & (k % 3 == 0), own).when((at == 2) & (k % 4 == 0), own).when(at == 2, first).otherwise(head)).withColumn("actor", F.concat(F.lit("at"), at.cast("string")))
    prior = rows.withColumn("version_id", F.when(at == 2, 1).otherwise(2).cast("long"))
    heads = doc.select("doc_id", F.when(k % 5 != 0, 2).cast("long").alias("version_id"))
    return lineage.lineage(seen, stored_version, prior, heads)


# Streams


def _streamed(rows, name: str, made, mode: str = "update"):
    """``rows`` as a stream of files, run to its end through ``made``; each batch's result is appended, with its number."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession)
    rows.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")

    def keep(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    with flows.single_flight(spark, f"{folder}/{name}.lock") as alone:
        if alone:
            flow = made(source).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
            flow.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("file", sql="SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN (doc_id % 40) || '.log' ELSE (doc_id % 40) || '.flac' END AS rel_path FROM {file}")
def stream_triggers(file):
    """Files seen again and again start one import each."""
    rows = file.select(F.concat((F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".log").otherwise(".flac")).alias("rel_path"), F.lit("2024-01-01").cast("timestamp").alias("ts")).unionByName(file.select("rel_path", F.lit("2024-01-01").cast("timestamp").alias("ts"))).unionByName(file.select(F.lit(".hidden").alias("rel_path"), F.lit("2024-01-01").cast("timestamp").alias("ts")))
    return _streamed(rows, "triggers", flows.triggers, "append").select("rel_path")


@query("name", sql="SELECT nation, CAST(count(DISTINCT disc_no) AS INT) AS have, CASE WHEN min(disc_total) = max(disc_total) THEN CAST(max(disc_total) AS INT) ELSE 1 END AS need, NOT (min(disc_total) = max(disc_total) AND max(disc_total) > 1 AND count(DISTINCT disc_no) < max(disc_total)) AS ready FROM {name} GROUP BY 1")
def stream_completeness(name):
    """The last state of each group once its discs have come."""
    rows = name.select(F.col("nation").cast("long").alias("nation"), F.col("disc_no").cast("int").alias("disc_no"), F.col("disc_total").cast("int").alias("disc_total")).repartition(6)
    found = _streamed(rows, "completeness", lambda s: flows.completeness(s, "nation"))
    return relational.latest(found, ["nation"], ["batch"]).select(F.col("nation").cast("int").alias("nation"), "have", "need", "ready")


@query("seen", sql="SELECT doc_id, location_id, version_id, sha, is_head FROM {folded}")
def stream_lineage(seen):
    """Observations in several batches and tasks, a document's in one of them, give what the batch fold gives."""
    rows = seen.repartition(8, "doc_id")
    found = _streamed(rows, "lineage", flows.lineage, "append")
    return found.select("doc_id", "location_id", "version_id", "sha", "is_head")


MADE["stored_version"] = lambda spark, d: bound(spark, d, "doc").select("doc_id", F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("version_id"), F.concat(F.lit(s), F.col("doc_id").cast("string")).alias("sha"), F.lit(f'{{"p":{v}}}').alias("vclock")) for v, s in ((1, "a"), (2, "b"))])).alias("v")).select("doc_id", "v.*")
