"""The queries over the driver's tables and their SQL: each applies operators of the library to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.functions import binary, codec, errors, listing, paths
from stowage.operators import chunks, members as rules, order, selection, source_tree
from stowage.plans import manifest
from stowage.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHUNK = manifest.CHUNK
MEMBERS = f"WITH {manifest.SQL}"
#: The end of the body that the queries on rules assume.
END = 10**15


def query(sql: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


# Chunks, layout and digests.


@query(f"""
SELECT doc_id, i AS chunk_index, octet_length(c)::BIGINT AS n, sha256(c) AS sha256
FROM (SELECT doc_id, i, array_slice(encode(text), i * {CHUNK} + 1, (i + 1) * {CHUNK}) AS c
      FROM (SELECT doc_id, text, unnest(range((strlen(text) + {CHUNK - 1}) // {CHUNK})) AS i FROM documents))
""")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.cut(_documents(spark, sf_dir), "data", CHUNK)
    return rows.select("doc_id", "chunk_index", "n", F.sha2("chunk", 256).alias("sha256"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text <> ''")
def member_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.cut(_documents(spark, sf_dir), "data", CHUNK)
    return chunks.digest_members(rows, "doc_id", "chunk").select("doc_id", F.lower(F.hex("digest")).alias("digest"))


@query()
def member_digest_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.digest_all(_documents(spark, sf_dir), "doc_id", "data", CHUNK, "blake3")
    return rows.select("doc_id", F.lower(F.hex("digest")).alias("digest"))


@query("""
SELECT doc_id AS pos, strlen(text) AS n, 16 + coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset
FROM documents
""")
def body_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.octet_length("text").cast("long").alias("n"))
    placed = order.number(rows, [F.col("pos")], "place", {"data_offset": "n"})
    return placed.select("pos", "n", (F.col("data_offset") + 16).alias("data_offset"))


@query(f"""
{MEMBERS}, c AS (
  SELECT pos, data_offset, unnest(chunk_sizes) AS size_compressed, generate_subscripts(chunk_sizes, 1) - 1 AS chunk_index FROM members)
SELECT pos, chunk_index, size_compressed,
  (data_offset + coalesce(sum(size_compressed) OVER (PARTITION BY pos ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM c
""")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir).select("pos", "data_offset", F.posexplode("chunk_sizes").alias("chunk_index", "size_compressed"))
    rows = rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))
    return chunks.chunk_offsets(rows, "pos", "data_offset", "size_compressed").select("pos", "chunk_index", "size_compressed", "offset")


@query(f"""
SELECT doc_id, i AS chunk_index, least({CHUNK}, strlen(text) - i * {CHUNK}) AS expected
FROM (SELECT doc_id, text, unnest(range((strlen(text) + {CHUNK - 1}) // {CHUNK})) AS i FROM documents)
""")
def expected_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    index = F.explode(F.sequence(F.lit(0).cast("long"), binary.expected_chunks(F.col("n"), CHUNK) - 1))
    rows = rows.filter("n > 0").withColumn("chunk_index", index)
    return rows.select("doc_id", "chunk_index", binary.expected_length(F.col("n"), F.col("chunk_index"), CHUNK).alias("expected"))


@query("""
WITH b AS (SELECT doc_id, encode(text) AS b FROM documents),
u AS (SELECT doc_id, octet_length(b) AS n, unnest(range(1, octet_length(b) + 1)) AS i, b FROM b),
s AS (SELECT doc_id, max(n) AS n, sum(('0x' || hex(array_slice(b, i, i)))::BIGINT) AS low, sum((n - i + 1) * ('0x' || hex(array_slice(b, i, i)))::BIGINT) AS high FROM u GROUP BY doc_id)
SELECT doc_id, ((n + high) % 65521 * 65536 + (1 + low) % 65521)::BIGINT AS adler FROM s
UNION ALL SELECT doc_id, 1 FROM documents WHERE text = ''
""")
def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", binary.adler32("data").alias("adler"))


@query("""
WITH l AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, encode(concat_ws('|', l_orderkey, l_linenumber, l_returnflag, l_linestatus)) AS b FROM lineitem),
u AS (SELECT *, octet_length(b) AS n, unnest(range(1, octet_length(b) + 1)) AS i FROM l)
SELECT l_orderkey, l_linenumber, ((max(n) + sum((n - i + 1) * ('0x' || hex(array_slice(b, i, i)))::BIGINT)) % 65521 * 65536
  + (1 + sum(('0x' || hex(array_slice(b, i, i)))::BIGINT)) % 65521)::BIGINT AS adler
FROM u GROUP BY r, l_orderkey, l_linenumber
""")
def adler32_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    data = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").cast("binary")
    return rows.select("l_orderkey", "l_linenumber", binary.adler32_native(data).alias("adler"))


@query(f"""
{MEMBERS} SELECT pos, 79 + 4 + strlen(path) + CASE WHEN type IN (3, 4) THEN 2 + strlen(link) ELSE 0 END + 4 * chunk_count AS entry_size FROM members
""")
def index_entry_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir, places=False)
    size = binary.index_entry_size(F.col("path"), F.col("link"), F.col("type"), F.col("chunk_count"))
    return rows.select("pos", size.alias("entry_size"))


@query(f"""
{MEMBERS} SELECT count(*)::BIGINT AS members, sum(79 + 4 + strlen(path) + CASE WHEN type IN (3, 4) THEN 2 + strlen(link) ELSE 0 END + 4 * chunk_count)::BIGINT AS index_size,
  sum(strlen(path) + strlen(link))::BIGINT AS name_bytes, sum(chunk_count)::BIGINT AS chunks, count(*) FILTER (type = 1 AND size_original > 0)::BIGINT AS ranges,
  sum(size_compressed)::BIGINT AS body
FROM members
""")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir, places=False)
    size = binary.index_entry_size(F.col("path"), F.col("link"), F.col("type"), F.col("chunk_count"))
    return rows.agg(
        F.count("*").alias("members"), F.sum(size).alias("index_size"), F.sum(F.octet_length("path") + F.octet_length("link")).alias("name_bytes"),
        F.sum("chunk_count").alias("chunks"), F.count_if(~rules.without_data()).alias("ranges"), F.sum("size_compressed").alias("body"),
    )


@query("""
SELECT n_chars AS n, n_chars + 5 * greatest(1, (n_chars + 65534) // 65535) + 1 AS deflate_bound, n_chars + 5 * greatest(1, (n_chars + 65534) // 65535) + 7 AS zlib_bound
FROM (SELECT DISTINCT n_chars * n_chars AS n_chars FROM documents)
""")
def codec_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("n_chars") * F.col("n_chars")).alias("n")).distinct()
    return rows.select("n", binary.deflate_bound(F.col("n")).alias("deflate_bound"), binary.zlib_bound(F.col("n")).alias("zlib_bound"))


@query("SELECT doc_id, true AS same, strlen(text) AS n FROM documents")
def deflate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("packed", codec.deflate(F.col("data")))
    rows = rows.withColumn("out", codec.inflate(F.col("packed")))
    same = (F.col("out.data") == F.col("data")) & F.col("out.code").isNull() & (F.col("out.used") == F.octet_length("packed"))
    same = same & (F.octet_length("packed") <= binary.deflate_bound(F.octet_length("data").cast("long")))
    return rows.select("doc_id", same.alias("same"), F.octet_length("out.data").cast("long").alias("n"))


@query("SELECT page_id, true AS same, true AS header_ok, strlen(html) AS n FROM pages")
def zlib_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    rows = rows.withColumn("packed", codec.zlib_encode(F.col("data")))
    rows = rows.withColumn("out", codec.zlib_decode(F.col("packed")))
    same = (F.col("out.data") == F.col("data")) & F.col("out.code").isNull()
    return rows.select("page_id", same.alias("same"), binary.zlib_header_ok(F.col("packed")).alias("header_ok"), F.octet_length("out.data").cast("long").alias("n"))


@query("SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations")
def stream_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    packed = materialize(codec.stream_encode(rows, "conv_id", "turn", "data"), "stream")
    return codec.stream_decode(packed, "conv_id", "turn", "data").select("conv_id", "turn", F.sha2("data", 256).alias("sha256"))


@query("""
SELECT event_id, len(b)::BIGINT AS n, u16, u32, u64::VARCHAR AS u64
FROM (SELECT event_id, lpad(hex(event_id * 2654435761 % 4294967296), 8, '0') || lpad(hex(user_id), 8, '0') AS b,
        (event_id * 2654435761 % 65536) AS u16, (event_id * 2654435761 % 4294967296) AS u32,
        (event_id * 2654435761 % 4294967296)::HUGEINT + 4294967296::HUGEINT * user_id AS u64 FROM events)
""")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("event_id") * 2654435761 % 4294967296
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lpad(F.hex("user_id"), 8, "0"), F.lpad(F.hex(low), 8, "0")).alias("hex"))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(F.col("hex"), i, F.lit(2))), ""))
    rows = rows.withColumn("b", data)
    return rows.select(
        "event_id", (F.octet_length("b") * 2).cast("long").alias("n"), binary.little_endian(F.col("b"), 0, 2).alias("u16"),
        binary.little_endian(F.col("b"), 0, 4).alias("u32"), binary.little_endian(F.col("b"), 0, 8).cast("string").alias("u64"),
    )


@query("""
WITH h AS (SELECT doc_id % 12 AS k, doc_id FROM documents)
SELECT doc_id, CASE k WHEN 1 THEN 'FMT_MAGIC' WHEN 2 THEN 'FMT_VERSION' WHEN 4 THEN 'FMT_RESERVED' WHEN 5 THEN 'FMT_COMP_ALG' WHEN 6 THEN 'FMT_HASH_ALG'
  WHEN 7 THEN 'FMT_RESERVED' WHEN 8 THEN 'FMT_TRUNCATED' WHEN 9 THEN 'FMT_MAGIC' END AS code FROM h
""")
def header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Number 3 changes the minor version, which nothing looks at; 9 breaks two rules; 10, 11 and 0 none.
    made = {0: "61726B210A0100000101000000000000", 1: "62726B210A0100000101000000000000", 2: "61726B210A0200000101000000000000", 3: "61726B210A0107000101000000000000",
            4: "61726B210A0100010101000000000000", 5: "61726B210A0100000201000000000000", 6: "61726B210A0100000103000000000000", 7: "61726B210A0100000101000000000001",
            8: "61726B210A01000001010000000000", 9: "61726B210B0200000101000000000000", 10: "61726B210A0100000102000000000000", 11: "61726B210A0100000101000000000000"}
    data = F.unhex(F.element_at(F.array(*[F.lit(made[k]) for k in range(12)]), (F.col("doc_id") % 12 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", binary.header_code(data).alias("code"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'FMT_MAGIC' WHEN 2 THEN 'FMT_RESERVED' WHEN 3 THEN 'FMT_TRUNCATED' WHEN 4 THEN 'FMT_MAGIC' WHEN 5 THEN 'FMT_TRUNCATED' END AS code
FROM documents
""")
def footer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbers 3 and 5 have a byte too few and one too many, 4 breaks two rules, 0 none; the fields before are not looked at.
    ends = {0: "0A41524B0000000000000000", 1: "0A41524A0000000000000000", 2: "0A41524B0000000000000001", 3: "0A41524B00000000000000",
            4: "0B41524B0100000000000000", 5: "0A41524B000000000000000000"}
    end = F.element_at(F.array(*[F.lit(ends[k]) for k in range(6)]), (F.col("doc_id") % 6 + 1).cast("int"))
    data = F.unhex(F.concat(F.lpad(F.hex("doc_id"), 104, "0"), end))
    return table(spark, sf_dir, "documents").select("doc_id", binary.footer_code(data).alias("code"))


@query("""
WITH f AS (SELECT o_orderkey, o_orderkey % 7 AS k, 16 + o_custkey * 100 AS begins, 84 + o_orderkey * 10 AS size FROM orders)
SELECT o_orderkey, CASE WHEN k = 1 THEN 'FMT_INDEX' WHEN k = 2 AND begins > 16 THEN 'FMT_INDEX' WHEN k = 3 THEN 'FMT_INDEX' WHEN k = 4 THEN 'FMT_TRUNCATED' WHEN k = 5 THEN 'FMT_INDEX' END AS code FROM f
""")
def footer_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    at = F.when(k == 1, 15).otherwise(16 + F.col("o_custkey") * 100)
    size = F.when(k == 2, 0).otherwise(84 + F.col("o_orderkey") * 10)
    whole = F.when(k == 4, 79).when(k == 3, at + size + 65).otherwise(at + size + 64)
    count = F.when(k == 5, F.call_function("div", size, F.lit(84).cast("long")) + 1).otherwise(F.call_function("div", size, F.lit(84).cast("long")))
    return table(spark, sf_dir, "orders").select("o_orderkey", binary.layout_code(whole, at, size, count).alias("code"))


@query("""
SELECT code, CASE WHEN code = 'USAGE' THEN 1 WHEN code LIKE 'IO%' THEN 2 WHEN code LIKE 'FMT%' THEN 3 WHEN code LIKE 'HASH%' THEN 4 WHEN code LIKE 'PATH%' THEN 5 WHEN code = 'MODIFIED' THEN 6 ELSE 1 END::INTEGER AS exit, count(*)::BIGINT AS n
FROM (SELECT ['USAGE', 'IO_READ', 'FMT_INDEX', 'HASH_MEMBER', 'PATH_ENCODING', 'MODIFIED', 'other', 'FMT_DATA', 'IO_LINK'][(doc_id % 9 + 1)::INTEGER] AS code FROM documents) GROUP BY ALL
""")
def exit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["USAGE", "IO_READ", "FMT_INDEX", "HASH_MEMBER", "PATH_ENCODING", "MODIFIED", "other", "FMT_DATA", "IO_LINK"]
    code = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(code.alias("code"))
    return rows.groupBy("code", errors.exit_class(F.col("code")).alias("exit")).agg(F.count("*").alias("n"))


@query(f"{MEMBERS} SELECT pos, path, type::INTEGER AS type FROM members WHERE pos = 42")
def member_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.members(spark, sf_dir, places=False).filter("pos = 42").select("pos", "path", "type")


@query("""
SELECT event_id, CASE WHEN a + b < 18446744073709551616::HUGEINT THEN a + b END::VARCHAR AS total
FROM (SELECT event_id, (event_id % 1000)::HUGEINT * 18446744073709551 AS a, (user_id % 1000)::HUGEINT * 18446744073709551 AS b FROM events)
""")
def checked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = lambda c: (F.col(c) % 1000).cast("decimal(20,0)") * F.lit(18446744073709551).cast("decimal(18,0)")
    total = binary.checked_sum(binary.big(big("event_id")), binary.big(big("user_id")))
    return table(spark, sf_dir, "events").select("event_id", total.cast("string").alias("total"))


@query(f"""
{MEMBERS} SELECT pos, type <> 1 OR size_original = 0 AS bare, coalesce(list_sum(chunk_sizes), 0)::BIGINT = size_compressed AS sums_up,
  data_offset + size_compressed AS "end" FROM members
""")
def member_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir)
    total = F.aggregate("chunk_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    end = binary.checked_sum(F.col("data_offset"), F.col("size_compressed")).cast("long")
    return rows.select("pos", rules.without_data().alias("bare"), (total == F.col("size_compressed")).alias("sums_up"), end.alias("end"))


@query(f"{MEMBERS} SELECT pos, path FROM members ORDER BY path, pos")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.members(spark, sf_dir, places=False).select("pos", "path").orderBy("path", "pos")


# Paths.

_PATH_SQL = """CASE WHEN strlen({p}) = 0 THEN 'FMT_INDEX' WHEN strlen({p}) > 1023 THEN 'PATH_TOO_LONG' WHEN {p} LIKE '/%' THEN 'PATH_ABSOLUTE' WHEN {p} LIKE '%/' THEN 'FMT_INDEX'
  WHEN list_filter(string_split({p}, '/'), lambda c: c IN ('', '.', '..'))[1] = '..' THEN 'PATH_TRAVERSAL'
  WHEN len(list_filter(string_split({p}, '/'), lambda c: c IN ('', '.', '..'))) > 0 THEN 'FMT_INDEX' END"""
_URL = "CASE page_id % 6 WHEN 0 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 1 THEN url WHEN 2 THEN regexp_replace(url, '^[a-z]+:/', '') WHEN 3 THEN replace(regexp_replace(url, '^[a-z]+://', ''), '/', '/../') WHEN 4 THEN './' || regexp_replace(url, '^[a-z]+://', '') ELSE repeat(url, 40) END"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, plain = F.col("page_id") % 6, F.regexp_replace("url", "^[a-z]+://", "")
    path = F.when(k == 0, plain).when(k == 1, F.col("url")).when(k == 2, F.regexp_replace("url", "^[a-z]+:/", "")).when(k == 3, F.replace(plain, F.lit("/"), F.lit("/../")))
    return table(spark, sf_dir, "pages").select("page_id", path.when(k == 4, F.concat(F.lit("./"), plain)).otherwise(F.repeat("url", 40)).alias("path"))


@query(f"SELECT page_id, {_PATH_SQL.format(p='p')} AS code FROM (SELECT page_id, {_URL} AS p FROM pages)")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", paths.member_path_code(F.col("path")).alias("code"))


@query(f"""
SELECT page_id, CASE WHEN strlen(p) = 0 OR strlen(p) > 1023 THEN 'FMT_INDEX' WHEN p LIKE '/%' THEN 'PATH_ABSOLUTE' WHEN list_contains(string_split(p, '/'), '..') THEN 'PATH_TRAVERSAL' END AS symlink,
  CASE WHEN strlen(p) > 1023 THEN 'FMT_INDEX' ELSE {_PATH_SQL.format(p='p')} END AS hardlink FROM (SELECT page_id, {_URL} AS p FROM pages)
""")
def link_target_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _urls(spark, sf_dir).select("page_id", paths.symlink_target_code(path).alias("symlink"), paths.hardlink_target_code(path).alias("hardlink"))


@query("""
WITH p AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS p, string_split(source || '/' || lang || '/' || doc_id, '/') AS c FROM documents)
SELECT doc_id, c[-1] AS base, array_to_string(c[1:-2], '/') AS parent, array_to_string(c[1:-2], '/') || '/' || c[-1] AS joined, 'root/' || p = 'root' OR starts_with('root/' || p, 'root/') AS inside, p AS below FROM p
""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit("root")
    whole = F.concat(root, F.lit("/"), path)
    return table(spark, sf_dir, "documents").select(
        "doc_id", paths.basename(path).alias("base"), paths.parent(path).alias("parent"), paths.join(paths.parent(path), paths.basename(path)).alias("joined"),
        paths.contains(root, whole).alias("inside"), paths.below(root, whole).alias("below"),
    )


_TREE = "source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-x' END || '/' || lang || '/' || doc_id"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "").otherwise("-x"), F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query(f"SELECT doc_id, path, row_number() OVER (ORDER BY list_transform(string_split(path, '/'), lambda c: encode(c)), doc_id) - 1 AS seq FROM (SELECT doc_id, {_TREE} AS path FROM documents)")
def traversal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.number(_tree(spark, sf_dir), [*order.traversal(F.col("path")), F.col("doc_id")], "seq")


@query(f"""
WITH p AS (SELECT string_split({_TREE}, '/') AS c FROM documents)
SELECT array_to_string(c[1:k], '/') AS ancestor, count(*)::BIGINT AS below FROM (SELECT c, unnest(range(1, len(c))) AS k FROM p) GROUP BY 1
""")
def ancestor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tree(spark, sf_dir).select(F.explode(paths.ancestors(F.col("path"))).alias("ancestor"))
    return rows.groupBy("ancestor").agg(F.count("*").alias("below"))


# Rules across members.


@query(f"""
{MEMBERS}, first AS (SELECT path, min(struct_pack(pos := pos, type := type)) AS t FROM members GROUP BY path)
SELECT m.pos, m.link, CASE WHEN t.pos < m.pos THEN t.pos END AS target_pos, CASE WHEN t.pos < m.pos THEN t.type END::INTEGER AS target_type
FROM members m LEFT JOIN first ON first.path = m.link WHERE m.type = 4
""")
def hardlink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hardlink_targets(manifest.members(spark, sf_dir, places=False)).select("pos", "link", "target_pos", "target_type")


@query(f"""
{MEMBERS}, a AS (SELECT pos, c, unnest(range(1, len(c))) AS k FROM (SELECT pos, string_split(path, '/') AS c FROM members)),
w AS (SELECT pos, array_to_string(c[1:k], '/') AS ancestor FROM a),
first AS (SELECT path, min(struct_pack(pos := pos, type := type)) AS t FROM members GROUP BY path),
j AS (SELECT w.*, CASE WHEN t IS NULL THEN 'missing' WHEN t.pos >= w.pos THEN 'after child' WHEN t.type <> 2 THEN 'not a directory' END AS reason FROM w LEFT JOIN first ON first.path = w.ancestor)
SELECT * FROM j WHERE reason IS NOT NULL
""")
def missing_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.missing_ancestors(manifest.members(spark, sf_dir, places=False))


@query(f"{MEMBERS}, d AS (SELECT path, pos, lag(pos) OVER (PARTITION BY path ORDER BY pos) AS last_pos FROM members) SELECT * FROM d WHERE last_pos IS NOT NULL")
def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicates(manifest.members(spark, sf_dir, places=False))


_ENTRY_SQL = f"""{MEMBERS}, e AS (
  SELECT *, {_PATH_SQL.format(p='path')} AS path_code,
    CASE WHEN type = 3 THEN CASE WHEN link = '' THEN 'FMT_INDEX' WHEN link LIKE '/%' THEN 'PATH_ABSOLUTE' WHEN list_contains(string_split(link, '/'), '..') THEN 'PATH_TRAVERSAL' END
         WHEN type = 4 THEN {_PATH_SQL.format(p='link')} END AS link_code,
    type <> 1 OR size_original = 0 AS bare FROM members),
codes AS (
  SELECT pos, CASE WHEN type NOT IN (1, 2, 3, 4) THEN 'FMT_MEMBER_TYPE' WHEN path_code IS NOT NULL THEN path_code WHEN link_code IS NOT NULL THEN link_code
    WHEN bare AND (size_original <> 0 OR size_compressed <> 0 OR data_offset <> 0 OR chunk_count <> 0) THEN 'FMT_INDEX'
    WHEN NOT bare AND chunk_count <> (size_original + {CHUNK - 1}) // {CHUNK} THEN 'FMT_INDEX'
    WHEN NOT bare AND coalesce(list_sum(chunk_sizes), 0) <> size_compressed THEN 'FMT_INDEX'
    WHEN NOT bare AND (data_offset < 16 OR data_offset + size_compressed > {END}) THEN 'FMT_INDEX' END AS code FROM e)"""


@query(f"{_ENTRY_SQL} SELECT pos, code FROM codes WHERE code IS NOT NULL")
def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir)
    return rows.select("pos", rules.entry_code(F.lit(END), CHUNK).alias("code")).filter("code IS NOT NULL")


_RANGES = "r AS (SELECT pos, data_offset AS start, data_offset + size_compressed AS \"end\" FROM members WHERE type = 1 AND size_original > 0)"


@query(f"{MEMBERS}, {_RANGES}, o AS (SELECT *, lag(\"end\") OVER (ORDER BY start, \"end\" DESC, pos) AS last_end FROM r) SELECT * FROM o WHERE start < last_end")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.overlaps(chunks.consecutive(manifest.members(spark, sf_dir)))


_GAPS = f"""{_RANGES}, g AS (
  SELECT pos, coalesce(lag("end") OVER (ORDER BY start, "end" DESC, pos), 16) AS expected, start FROM r
  UNION ALL SELECT NULL, coalesce(max("end"), 16), {END} FROM r)"""


@query(f"{MEMBERS}, {_GAPS} SELECT * FROM g WHERE start <> expected")
def body_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.gaps(chunks.consecutive(manifest.members(spark, sf_dir)), END)


_ERRORS = f"""{_ENTRY_SQL}, first AS (SELECT path, min(struct_pack(pos := pos, type := type)) AS t FROM members GROUP BY path),
links AS (SELECT m.pos, CASE WHEN t.pos < m.pos THEN t.type END AS target_type FROM members m LEFT JOIN first ON first.path = m.link WHERE m.type = 4),
twice AS (SELECT pos, lag(pos) OVER (PARTITION BY path ORDER BY pos) AS last_pos FROM members),
up AS (SELECT pos, array_to_string(c[1:k], '/') AS ancestor FROM (SELECT pos, c, unnest(range(1, len(c))) AS k FROM (SELECT pos, string_split(path, '/') AS c FROM members))),
{_GAPS}, o AS (SELECT *, lag("end") OVER (ORDER BY start, "end" DESC, pos) AS last_end FROM r),
errors AS (
  SELECT 6 AS stage, pos, code FROM codes WHERE code IS NOT NULL
  UNION SELECT 7, pos, 'FMT_INDEX' FROM links WHERE target_type IS NULL
  UNION SELECT 8, pos, 'FMT_INDEX' FROM twice WHERE last_pos IS NOT NULL
  UNION SELECT 9, up.pos, 'FMT_INDEX' FROM up LEFT JOIN first ON first.path = up.ancestor WHERE t IS NULL OR t.pos >= up.pos OR t.type <> 2
  UNION SELECT 13, pos, 'FMT_INDEX' FROM o WHERE start < last_end
  UNION SELECT 14, pos, 'FMT_INDEX' FROM links WHERE target_type <> 1
  UNION SELECT 15, pos, 'FMT_INDEX' FROM g WHERE start <> expected)"""


@query(f"{_ERRORS} SELECT stage::INTEGER AS stage, pos, code FROM errors")
def all_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.errors(materialize(manifest.members(spark, sf_dir), "members"), END, CHUNK)


@query(f"{_ERRORS} SELECT stage::INTEGER AS stage, pos, code FROM errors ORDER BY stage, pos NULLS LAST LIMIT 1")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_error(rules.errors(materialize(manifest.members(spark, sf_dir), "members"), END, CHUNK))


# Selection and conflicts.


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels by path, each toxic one twice, and some that no member has."""
    labels = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    path = F.when(i % 31 == 4, F.concat(F.lit("gone/f"), i.cast("string"))).otherwise(F.concat(F.lit("d"), (i % 10).cast("string"), F.lit("/f"), i.cast("string")))
    return labels.select(F.explode(F.when(F.col("toxic") == 1, F.array(i * 2, i * 2 + 1)).otherwise(F.array(i * 2))).alias("request"), path.alias("path"))


_REQUESTED = "requested AS (SELECT unnest(CASE WHEN toxic = 1 THEN [doc_id * 2, doc_id * 2 + 1] ELSE [doc_id * 2] END) AS request, CASE WHEN doc_id % 31 = 4 THEN 'gone/f' || doc_id ELSE 'd' || (doc_id % 10) || '/f' || doc_id END AS path FROM labels)"
_SELECTED = """selected AS (
  SELECT pos FROM members WHERE path IN (SELECT path FROM requested)
  UNION SELECT min(t.pos) FROM members m JOIN members t ON t.path = m.link WHERE m.type = 4 AND m.path IN (SELECT path FROM requested) GROUP BY t.path)"""


@query(f"{MEMBERS}, {_REQUESTED} SELECT request, requested.path, min(pos) AS pos FROM requested LEFT JOIN members USING (path) GROUP BY ALL")
def lookup_in_request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.lookup(manifest.members(spark, sf_dir, places=False), _requested(spark, sf_dir)).orderBy("request")


@query(f"{MEMBERS}, {_REQUESTED}, {_SELECTED} SELECT pos FROM selected")
def selection_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selection(manifest.members(spark, sf_dir, places=False), _requested(spark, sf_dir))


@query(f"{MEMBERS}, {_REQUESTED} SELECT DISTINCT path FROM requested WHERE path NOT IN (SELECT path FROM members)")
def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.missing(manifest.members(spark, sf_dir, places=False), _requested(spark, sf_dir))


@query(f"""
{MEMBERS}, {_REQUESTED}, {_SELECTED}, there AS (
  SELECT path, CASE WHEN type = 2 THEN CASE WHEN pos % 2 = 0 THEN 'dir' ELSE 'file' END ELSE 'file' END AS kind FROM members WHERE type = 2 OR pos % 5 = 0),
chosen AS (SELECT DISTINCT path FROM members WHERE pos IN (SELECT pos FROM selected)),
above AS (SELECT DISTINCT array_to_string(c[1:k], '/') AS path FROM (SELECT c, unnest(range(1, len(c))) AS k FROM (SELECT string_split(path, '/') AS c FROM chosen)))
SELECT DISTINCT path, kind FROM (SELECT path, kind FROM chosen JOIN there USING (path)
  UNION ALL SELECT path, kind FROM above JOIN there USING (path) WHERE kind <> 'dir' AND path NOT IN (SELECT path FROM chosen))
""")
def preflight_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir, places=False)
    kind = F.when((F.col("type") == 2) & (F.col("pos") % 2 == 0), "dir").otherwise("file")
    there = rows.filter("type = 2 OR pos % 5 = 0").select("path", kind.alias("kind"))
    return selection.conflicts(rows, selection.selection(rows, _requested(spark, sf_dir)), there).distinct()


@query(f"{MEMBERS} SELECT pos, path FROM members WHERE type = 2 ORDER BY pos DESC")
def folders_in_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.members(spark, sf_dir, places=False).filter("type = 2").select("pos", "path").orderBy(F.desc("pos"))


# Listings.


def _size_sql(n: str) -> str:
    def unit(one: int, name: str) -> str:
        tenths = f"({n} % {one} * 10 + {one // 2}) // {one}"
        return f"({n} // {one} + CASE WHEN {tenths} >= 10 THEN 1 ELSE 0 END) || '.' || CASE WHEN {tenths} >= 10 THEN 0 ELSE {tenths} END || '{name}'"

    return f"CASE WHEN {n} < 1024 THEN {n} || 'B' WHEN {n} < 1048576 THEN {unit(1024, 'KB')} WHEN {n} < 1073741824 THEN {unit(1024**2, 'MB')} ELSE {unit(1024**3, 'GB')} END"


@query(f"SELECT doc_id, {_size_sql('n')} AS human FROM (SELECT doc_id, n_chars * n_chars * (doc_id % 7 + 1) AS n FROM documents)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 7 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", listing.human_size(size).alias("human"))


_TYPE_SQL = "CASE type WHEN 1 THEN 'file' WHEN 2 THEN 'dir' WHEN 3 THEN 'symlink' WHEN 4 THEN 'hardlink' ELSE 'unknown' END"
_MODE_SQL = "'0' || ((mode // 64) % 8) || ((mode // 8) % 8) || (mode % 8)"


@query(f"{MEMBERS} SELECT pos, rpad({_TYPE_SQL}, 8, ' ') || ' ' || lpad(size_original::VARCHAR, 12, ' ') || ' ' || {_MODE_SQL} || ' ' || lpad((CASE WHEN mtime_ns < 0 THEN mtime_ns::HUGEINT + 18446744073709551616::HUGEINT ELSE mtime_ns END)::VARCHAR, 20, ' ') || ' ' || path AS line FROM members")
def long_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir, places=False)
    line = listing.verbose_line(F.col("type"), F.col("size_original"), F.col("mode"), F.col("mtime_ns"), F.col("path"))
    return rows.select("pos", line.alias("line")).orderBy("pos")


@query(f"""
{MEMBERS} SELECT pos, rpad({_TYPE_SQL}, 8, ' ') || ' ' || lpad({_size_sql('size_original')}, 12, ' ') || ' ' || {_MODE_SQL} || ' '
  || strftime(make_timestamp((mtime_ns - (mtime_ns % 1000000000 + 1000000000) % 1000000000) // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ' ' || path AS line FROM members
""")
def human_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.members(spark, sf_dir, places=False)
    line = listing.verbose_line(F.col("type"), F.col("size_original"), F.col("mode"), F.col("mtime_ns"), F.col("path"), human=True)
    return rows.select("pos", line.alias("line"))


@query("""
WITH t AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns FROM events), s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ns ELSE -ns END AS ns FROM t)
SELECT event_id, ns, (ns % 1000000000 + 1000000000) % 1000000000 AS nanos, (ns - (ns % 1000000000 + 1000000000) % 1000000000) // 1000000000 AS seconds FROM s
""")
def modification_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ns = micros * 1000 + F.col("event_id") % 1000
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, ns).otherwise(-ns).alias("ns"))
    rows = rows.withColumns({"nanos": listing.mtime_nanos(F.col("ns")), "seconds": listing.mtime_seconds(F.col("ns"))})
    return rows.select("event_id", listing.encode_mtime(F.col("seconds"), F.col("nanos")).alias("ns"), "nanos", "seconds")


# Source trees.


@query("WITH d AS (SELECT doc_id, sha256(text) AS k FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first FROM d")
def content_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The archiver goes by device and number; here equal contents stand for one file.
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    return source_tree.first_seen(rows, "k", "doc_id", "doc_id").select("doc_id", "first")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: two roots, few inode numbers, a device that changes within some folders."""
    i = F.col("doc_id")
    kind = F.when(i % 13 == 1, "special").when(i % 11 == 2, "symlink").otherwise("file")
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("r"), (i % 2).cast("string")).alias("root"), F.concat(F.lit("d"), (i % 20).cast("string"), F.lit("/f"), i.cast("string")).alias("member_path"), kind.alias("kind"),
        F.lit(1).cast("long").alias("dev"), (F.col("n_chars") % 50).alias("ino"), (i % 3 + 1).alias("nlink"), i.alias("seq"), F.when(kind == "symlink", F.lit("t")).otherwise("").alias("link_target"),
        F.col("n_chars").alias("size"), (i * 1000).alias("mtime_ns"),
    )
    folders = files.filter("seq < 20").select(
        "root", F.concat(F.lit("d"), (F.col("seq") % 20).cast("string")).alias("member_path"), F.lit("dir").alias("kind"), F.when(F.col("seq") % 7 == 3, 2).otherwise(1).cast("long").alias("dev"),
        F.lit(0).cast("long").alias("ino"), F.lit(2).cast("long").alias("nlink"), (F.col("seq") - 20).alias("seq"), F.lit("").alias("link_target"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"),
    )
    return files.unionByName(folders)


_ENTRIES = """entries AS (
  SELECT 'r' || (doc_id % 2) AS root, 'd' || (doc_id % 20) || '/f' || doc_id AS member_path, CASE WHEN doc_id % 13 = 1 THEN 'special' WHEN doc_id % 11 = 2 THEN 'symlink' ELSE 'file' END AS kind,
    1 AS dev, n_chars % 50 AS ino, doc_id % 3 + 1 AS nlink, doc_id AS seq, CASE WHEN doc_id % 13 <> 1 AND doc_id % 11 = 2 THEN 't' ELSE '' END AS link_target, n_chars AS size, doc_id * 1000 AS mtime_ns FROM documents
  UNION ALL SELECT 'r' || (doc_id % 2), 'd' || (doc_id % 20), 'dir', CASE WHEN doc_id % 7 = 3 THEN 2 ELSE 1 END, 0, 2, doc_id - 20, '', 0, 0 FROM documents WHERE doc_id < 20)"""


@query(f"""
WITH {_ENTRIES}, f AS (SELECT root, dev, ino, min_by(member_path, seq) AS first FROM entries WHERE kind = 'file' AND nlink > 1 AND ino <> 0 GROUP BY ALL)
SELECT e.root, e.member_path, CASE WHEN kind = 'file' AND nlink > 1 AND first IS NOT NULL AND first <> member_path THEN 'hardlink' WHEN kind = 'special' THEN 'skip' ELSE kind END AS action,
  CASE WHEN kind = 'file' AND nlink > 1 AND first IS NOT NULL AND first <> member_path THEN first WHEN kind = 'symlink' THEN link_target ELSE '' END AS link
FROM entries e LEFT JOIN f ON kind = 'file' AND nlink > 1 AND e.ino <> 0 AND e.root = f.root AND e.dev = f.dev AND e.ino = f.ino
""")
def entry_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_tree.classify(_entries(spark, sf_dir)).select("root", "member_path", "action", "link")


@query(f"""
WITH {_ENTRIES}, off AS (SELECT root, member_path FROM entries WHERE kind = 'dir' AND dev <> 1)
SELECT root, member_path FROM entries e WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.root = e.root AND (e.member_path = off.member_path OR starts_with(e.member_path, off.member_path || '/')))
""")
def mount_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    devices = rows.select("root").distinct().withColumn("root_dev", F.lit(1).cast("long"))
    return source_tree.boundary(rows, devices).select("root", "member_path")


@query(f"WITH {_ENTRIES} SELECT member_path FROM entries WHERE kind = 'file' AND (seq % 19 = 4 OR seq % 29 = 6 OR seq % 37 = 8)")
def modified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    after = rows.filter("seq % 37 <> 8").withColumns({"size": F.when(F.col("seq") % 19 == 4, F.col("size") + 1).otherwise(F.col("size")), "mtime_ns": F.when(F.col("seq") % 29 == 6, 1).otherwise(F.col("mtime_ns"))})
    return source_tree.modified(rows, after)


@query("""
SELECT root, seq, member_path FROM (
  SELECT 0 AS root, 'page/' || page_id AS member_path, row_number() OVER (ORDER BY encode('page/' || page_id)) - 1 AS seq FROM pages
  UNION ALL SELECT 1, 'item/' || item_id, row_number() OVER (ORDER BY encode('item/' || item_id)) - 1 + (SELECT count(*) FROM pages) FROM benchmark)
""")
def sources_in_a_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "pages").select(F.lit(0).alias("root"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("member_path"))
    b = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("root"), F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("member_path"))
    return order.number(a.unionByName(b), [F.col("root"), *order.traversal(F.col("member_path"))], "seq")


def utf8_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts are UTF-8 after every third of them lost its last byte."""
    rows = _documents(spark, sf_dir).filter(F.octet_length("data") > 0)
    cut = F.when(F.col("doc_id") % 3 == 0, F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 1)).otherwise(F.col("data"))
    return rows.select("doc_id", F.is_valid_utf8(cut).alias("valid"))


QUERIES["utf8_valid"] = utf8_valid
ORACLES["utf8_valid"] = "SELECT doc_id, NOT (doc_id % 3 = 0 AND strlen(text[-1:]) > 1) AS valid FROM documents WHERE text <> ''"
