"""The engine's queries over the driver's tables, each with its DuckDB SQL.

There are no media files among the tables, so their columns are read as media
structures: a user's events are a track's packets, orders are chunks, parts are
pictures, embeddings are PCM samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe import catalog
from reelframe.functions import audio, bytesx, detect, dictionary, pixels, timebase
from reelframe.operators import errors, muxing, playback, registry, sampletable, seek
from reelframe.sources import headers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: track, n, size, duration, is_keyframe."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.select(
        F.col("user_id").alias("track"), n.alias("n"), F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).cast("long").alias("size"),
        F.get_json_object("props", "$.k").cast("long").alias("duration"), (F.col("event_type") == "click").alias("is_keyframe"), "event_type", "event_id",
    )


PACKETS_SQL = """
packets AS (
  SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
         CAST(floor(abs(coalesce(value, 0))) AS BIGINT) AS size, CAST(json_extract_string(props, '$.k') AS BIGINT) AS duration,
         event_type = 'click' AS is_keyframe, event_type, event_id
  FROM events
)"""
DTS_SQL = f"""
WITH {PACKETS_SQL}, timed AS (
  SELECT *, CAST(coalesce(sum(duration) OVER (PARTITION BY track ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM packets
)"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampletable.timestamps(packets(spark, sf_dir), ["track"], ["n"], "duration")


# --- bytes -------------------------------------------------------------------

#: Headers that detection is tried on: each rule, near misses and short values.
HEADERS = [
    "1A45DFA3A3428681", "00000020667479706D703432", "00000018667479707765626D", "00000018667479704D344120", "000000186674797061766966", "000000186674797068656963", "0000001866747970", "4F67675300020000",
    "524946462400000041564920", "524946462400000057415645", "524946462400000057454250", "5249464624000000", "000001BA44000400", "47" + "00" * 187 + "47", "474000" + "00" * 185 + "47", "47400010", "3026B2758E66CF11", "464C560105000000", "464C5602", "4E555453",
    "664C614300000022", "4944330300000000000A" + "00" * 10 + "664C6143", "49443303001000000000" + "00" * 10 + "664C6143", "49443303000000008000", "494433FF000000000000", "494433", "FFFB9064", "FFFA9064", "FBFF9064", "FAFF0000", "4D616320960F0000",
    "FFD8FFE000104A46", "89504E470D0A1A0A", "89504E", "424D460000000000", "4749463839610100", "49492A0008000000", "4D4D002A00000008", "0000010001002020", "762F310102000000", "69636E7300000100",
    "0000000167420020", "000000014001", "0000012742", "00000140", "00000001", "3C21444F43545950", "00000000", "",
]


def _detect_sql(h: str, compat: bool) -> str:
    """The rules in SQL, over a column of hex text."""
    at = lambda p, n: f"substr({h}, {2 * p + 1}, {2 * n})"
    num = lambda p: f"CAST('0x' || {at(p, 1)} AS INTEGER)"
    iso = f"{at(4, 4)} = '66747970'"
    m4a, heif = f"WHEN {iso} AND {at(8, 4)} = '4D344120' THEN 'm4a'", f"WHEN {iso} AND {at(8, 4)} IN ('61766966', '68656963', '68657663') THEN 'heif'"
    ts, sync = ("47000000", ("FAFF", "FBFF")) if compat else ("47", ("FFFA", "FFFB"))
    skip = f"({num(6)} * 2097152 + {num(7)} * 16384 + {num(8)} * 128 + {num(9)} + 10 + CASE WHEN ({num(5)} & 16) <> 0 THEN 10 ELSE 0 END)"
    safe = f"length({h}) >= 20 AND {at(3, 1)} <> 'FF' AND {at(4, 1)} <> 'FF' AND {num(6)} < 128 AND {num(7)} < 128 AND {num(8)} < 128 AND {num(9)} < 128"
    nal = f"CASE WHEN {h} LIKE '00000001%' AND length({h}) >= 10 THEN {num(4)} WHEN {h} LIKE '000001%' THEN {num(3)} END"
    prefix = lambda p, name: f"WHEN {h} LIKE '{p}%' THEN '{name}'"
    riff = lambda code, name: f"WHEN {h} LIKE '52494646%' AND {at(8, 4)} = '{code}' THEN '{name}'"
    rules = [prefix("1A45DFA3", "mkv"), f"WHEN {iso} AND {at(8, 4)} = '7765626D' THEN 'webm'", *([] if compat else [m4a, heif]), f"WHEN {iso} THEN 'mp4'", prefix("4F676753", "ogg"), riff("41564920", "avi"), prefix("000001BA", "mpeg_ps")]
    rules += [f"WHEN {h} LIKE '{ts}%' AND {at(188, 1)} = '47' THEN 'mpeg_ts'", prefix("3026B275", "asf"), prefix("464C5601", "flv"), prefix("4E555453", "nut"), prefix("664C6143", "flac"), riff("57415645", "wav")]
    rules += [f"WHEN {h} LIKE '494433%' THEN CASE WHEN {safe} THEN CASE WHEN substr({h}, CAST(2 * {skip} + 1 AS BIGINT), 8) = '664C6143' THEN 'flac' ELSE 'mp3' END ELSE 'mp3' END"]
    rules += [prefix(sync[0], "mp3"), prefix(sync[1], "mp3"), m4a, prefix("4D616320", "ape"), prefix("FFD8FF", "jpeg"), prefix("89504E47", "png"), riff("57454250", "webp"), prefix("424D", "bmp"), prefix("47494638", "gif")]
    rules += [prefix("49492A00", "tiff"), prefix("4D4D002A", "tiff"), prefix("00000100", "ico"), prefix("762F3101", "exr"), prefix("69636E73", "icns"), heif]
    name = "compat" if compat else "default"
    return f"""
      CASE WHEN length({h}) < 8 THEN NULL {" ".join(rules)} END AS container_{name},
      CASE WHEN length({h}) < 8 OR (CASE {" ".join(rules)} END) IS NOT NULL THEN NULL WHEN (({nal}) & 31) = 7 THEN 'h264' WHEN ((({nal}) >> 1) & 63) = 32 THEN 'h265' END AS codec_{name}"""


def _detected(df: DataFrame, b: str, key: str) -> DataFrame:
    out = detect.with_format(detect.with_format(df, b, "compat", True), b, "default", False)
    return out.select(key, *(F.col(f"{name}.{part}").alias(f"{part}_{name}") for name in ("compat", "default") for part in ("container", "codec")))


@query(f"""WITH t(i, h) AS (VALUES {", ".join(f"({k}, '{h}')" for k, h in enumerate(HEADERS))})
SELECT doc_id, {_detect_sql("h", True)}, {_detect_sql("h", False)} FROM documents JOIN t ON doc_id % {len(HEADERS)} = i""")
def detect_header(spark, sf_dir):
    table = F.array(*(F.lit(h) for h in HEADERS))
    d = read(spark, sf_dir, "documents", "doc_id").withColumn("b", F.unhex(F.get(table, (F.col("doc_id") % len(HEADERS)).cast("int"))))
    return _detected(d, "b", "doc_id")


@query(f"SELECT page_id, {_detect_sql('h', True)}, {_detect_sql('h', False)} FROM (SELECT page_id, hex(encode(left(html, 500))) AS h FROM pages)")
def detect_pages(spark, sf_dir):
    return _detected(read(spark, sf_dir, "pages", "page_id", "html").withColumn("b", F.encode("html", "UTF-8")), "b", "page_id")


@query("""WITH x AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS v FROM events)
SELECT event_id, CASE WHEN (v & 2155905152) = 0 THEN ((v >> 24) & 127) * 2097152 + ((v >> 16) & 127) * 16384 + ((v >> 8) & 127) * 128 + (v & 127) END AS size FROM x""")
def synchsafe_skip(spark, sf_dir):
    v = F.col("event_id") * F.lit(2654435761) % F.lit(4294967296)
    return read(spark, sf_dir, "events", "event_id").select("event_id", bytesx.synchsafe(F.unhex(F.lpad(F.hex(v), 8, "0")), 0).alias("size"))


def _le_sql(n: int) -> str:
    return " || ".join(f"substr(h, {2 * k + 1}, 2)" for k in reversed(range(n)))


def _signed(x: str) -> str:
    return f"CASE WHEN length(h) >= 16 THEN CAST(CASE WHEN {x} >= 9223372036854775808 THEN CAST({x} AS HUGEINT) - 18446744073709551616 ELSE {x} END AS BIGINT) END"


@query(f"""WITH x AS (SELECT doc_id, hex(encode(left(text, 8))) AS h FROM documents)
SELECT doc_id, {", ".join(f"CASE WHEN length(h) >= {2 * n} THEN CAST('0x' || substr(h, 1, {2 * n}) AS BIGINT) END AS be{8 * n}, CASE WHEN length(h) >= {2 * n} THEN CAST('0x' || {_le_sql(n)} AS BIGINT) END AS le{8 * n}" for n in (2, 3, 4))},
  {_signed("CAST('0x' || substr(h, 1, 16) AS UBIGINT)")} AS be64, {_signed(f"CAST('0x' || {_le_sql(8)} AS UBIGINT)")} AS le64 FROM x""")
def le_be_loads(spark, sf_dir):
    b = F.encode("text", "UTF-8")
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *(c for n in (2, 3, 4, 8) for c in (bytesx.be(b, 0, n).alias(f"be{8 * n}"), bytesx.le(b, 0, n).alias(f"le{8 * n}"))))


@query("""WITH b AS (SELECT doc_id, doc_id % 40 AS f, substr(hex(encode(left(text, 4))), 1, 8) AS h FROM documents), y AS (SELECT doc_id, f, length(h) * 4 AS n, CAST('0x' || h AS BIGINT) AS v FROM b),
z AS (SELECT doc_id, f, n, least(13, greatest(n - f, 0)) AS have, v FROM y)
SELECT doc_id, f AS first_bit, CASE WHEN have = 0 THEN 0 ELSE (v >> CAST(n - f - have AS INTEGER)) & ((1::BIGINT << CAST(have AS INTEGER)) - 1) END AS bits FROM z""")
def bit_reader(spark, sf_dir):
    b = F.substring(F.encode("text", "UTF-8"), 1, 4)
    first = F.col("doc_id") % 40
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", first.alias("first_bit"), bytesx.bits(b, first, 13).alias("bits"))


@query("""SELECT doc_id, CASE WHEN doc_id % 50 + 4 <= octet_length(encode(text)) THEN hex(substr(encode(text), 1, 0)) || substr(hex(encode(text)), CAST(2 * (doc_id % 50) + 1 AS BIGINT), 8) END AS slice,
  CASE WHEN n_chars - doc_id % 100 BETWEEN 0 AND n_chars THEN n_chars - doc_id % 100 END AS from_end, CASE WHEN 10 + doc_id % 90 <= n_chars THEN 10 + doc_id % 90 END AS from_here FROM documents""".replace("hex(substr(encode(text), 1, 0)) || ", ""))
def random_reads(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return d.select(
        "doc_id", F.hex(bytesx.read_at(F.encode("text", "UTF-8"), F.col("doc_id") % 50, 4)).alias("slice"),
        bytesx.seek_position("end", -(F.col("doc_id") % 100), F.lit(0), F.col("n_chars")).alias("from_end"), bytesx.seek_position("cur", F.col("doc_id") % 90, F.lit(10), F.col("n_chars")).alias("from_here"),
    )


@query("""SELECT item_id, substr(h, 1, 10) || substr(h, 17, 10) || substr(h, 33, 10) AS packed FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)""")
def plane_copy(spark, sf_dir):
    return read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.hex(bytesx.plane_copy(F.encode("text", "UTF-8"), 8, 5, 3)).alias("packed"))


# --- catalogue ---------------------------------------------------------------

#: What the events ask for.
REQUESTED = {"click": "flac", "view": "h264", "purchase": "png", "signup": "vc3", "error": "pcm_s16le"}
PROFILED = {"click": "h264", "view": "aac", "purchase": "h265", "signup": "vp9", "error": "prores"}


def _case(values: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _mapped(values: dict[str, str]) -> Column:
    return F.expr(_case(values))


@query(f"""WITH d AS {catalog.values_sql("codec_descriptors")}, r AS (SELECT event_id, {_case(REQUESTED)} AS codec FROM events),
a AS (SELECT codec, name, row_number() OVER (PARTITION BY codec ORDER BY reg_order) AS k FROM d WHERE enabled AND can_decode), e AS (SELECT codec, name, row_number() OVER (PARTITION BY codec ORDER BY reg_order) AS k FROM d WHERE enabled AND can_encode)
SELECT event_id, r.codec, a.name AS decoder, e.name AS encoder FROM r LEFT JOIN a ON a.codec = r.codec AND a.k = 1 LEFT JOIN e ON e.codec = r.codec AND e.k = 1""")
def registry_resolve(spark, sf_dir):
    d = registry.register(catalog.dimension(spark, "codec_descriptors"))
    r = read(spark, sf_dir, "events", "event_id", "event_type").select("event_id", _mapped(REQUESTED).alias("codec"))
    r = registry.resolve(r, d, "codec", "can_decode").withColumnRenamed("implementation", "decoder")
    return registry.resolve(r, d, "codec", "can_encode").withColumnRenamed("implementation", "encoder")


@query(f"""WITH d AS {catalog.values_sql("codec_descriptors")}
SELECT event_id, {_case(REQUESTED)} AS codec FROM events WHERE {_case(REQUESTED)} IN (SELECT codec FROM d WHERE enabled AND can_decode)""")
def registry_has(spark, sf_dir):
    r = read(spark, sf_dir, "events", "event_id", "event_type").select("event_id", _mapped(REQUESTED).alias("codec"))
    return registry.has(r, catalog.dimension(spark, "codec_descriptors"), "codec", "can_decode")


@query(f"""WITH f AS {catalog.values_sql("format_descriptors")}, again AS (SELECT * FROM f UNION ALL SELECT reg_order + 100, container, name || '_2', can_demux, can_mux FROM f WHERE reg_order < 2)
SELECT container, arg_min(name, reg_order) AS first_name, arg_max(name, reg_order) AS last_name FROM again GROUP BY container""")
def format_registry(spark, sf_dir):
    f = catalog.dimension(spark, "format_descriptors")
    again = f.unionByName(f.where("reg_order < 2").withColumn("reg_order", F.col("reg_order") + 100).withColumn("name", F.concat("name", F.lit("_2"))))
    first, last = registry.register_formats(again), registry.register_formats(again, replace=True)
    return first.select("container", F.col("name").alias("first_name")).join(last.select("container", F.col("name").alias("last_name")), "container")


@query(f"""WITH m AS {catalog.values_sql("codec_meta")}, r AS (SELECT event_id, {_case(REQUESTED)} AS codec FROM events)
SELECT event_id, r.codec, m.name AS codec_name, m.long_name AS codec_long_name, m.type AS media_type FROM r LEFT JOIN m USING (codec)""")
def codec_meta_join(spark, sf_dir):
    r = read(spark, sf_dir, "events", "event_id", "event_type").select("event_id", _mapped(REQUESTED).alias("codec"))
    return registry.metadata(r, catalog.dimension(spark, "codec_meta"), "codec")


@query(f"""WITH p AS {catalog.values_sql("profiles")}, r AS (SELECT event_id, {_case(PROFILED)} AS codec, CAST(json_extract_string(props, '$.k') AS INTEGER) AS profile FROM events)
SELECT event_id, r.codec, r.profile, coalesce(p.profile_name, '') AS profile_name FROM r LEFT JOIN p ON p.codec = r.codec AND p.profile = r.profile""")
def profile_join(spark, sf_dir):
    r = read(spark, sf_dir, "events", "event_id", "event_type", "props").select("event_id", _mapped(PROFILED).alias("codec"), F.get_json_object("props", "$.k").cast("int").alias("profile"))
    return registry.profile_names(r, catalog.dimension(spark, "profiles"), "codec", "profile")


@query(f"""WITH s AS {catalog.values_sql("sample_entries")}, e AS (SELECT *, row_number() OVER (ORDER BY entry) - 1 AS i FROM s), c AS (SELECT count(*) AS n FROM s)
SELECT p_partkey, entry, codec FROM part, c JOIN e ON p_partkey % n = i""")
def sample_entry_codecs(spark, sf_dir):
    names = sorted(e for e, _ in catalog.SAMPLE_ENTRIES)
    p = read(spark, sf_dir, "part", "p_partkey").withColumn("entry", F.get(F.array(*(F.lit(e) for e in names)), (F.col("p_partkey") % len(names)).cast("int")))
    return p.join(F.broadcast(catalog.dimension(spark, "sample_entries")), "entry").select("p_partkey", "entry", "codec")


@query(f"""WITH m AS {catalog.values_sql("matroska_codecs")}, e AS (SELECT *, row_number() OVER (ORDER BY codec_id) - 1 AS i FROM m), c AS (SELECT count(*) AS n FROM m)
SELECT p_partkey, codec_id, codec FROM part, c JOIN e ON p_partkey % n = i""")
def matroska_codec_ids(spark, sf_dir):
    ids = sorted(i for i, _ in catalog.MATROSKA_CODECS)
    p = read(spark, sf_dir, "part", "p_partkey").withColumn("codec_id", F.get(F.array(*map(F.lit, ids)), (F.col("p_partkey") % len(ids)).cast("int")))
    return p.join(F.broadcast(catalog.dimension(spark, "matroska_codecs")), "codec_id").select("p_partkey", "codec_id", "codec")


@query(f"""WITH n AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{d}')" for k, d in enumerate(catalog.DISPOSITIONS))}) AS v(k, name)), p AS (SELECT p_partkey, CAST(p_partkey * 37 % 65536 AS INTEGER) AS mask FROM part)
SELECT p_partkey, coalesce(string_agg(name, ',' ORDER BY k) FILTER (WHERE (mask >> k) & 1 = 1), '') AS names, p_partkey % 4 = 0 OR (any_value(mask) >> 13) & 1 = 1 AS picture FROM p, n GROUP BY p_partkey""")
def track_disposition(spark, sf_dir):
    mask = (F.col("p_partkey") * 37 % 65536).cast("int")
    kind = F.when(F.col("p_partkey") % 4 == 0, "image").otherwise("audio")
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.array_join(registry.dispositions(mask), ",").alias("names"), registry.is_picture(kind, mask).alias("picture"))


@query("SELECT * FROM (VALUES ('bmp', 'rgba'), ('gif', 'rgba'), ('jpeg', 'rgba'), ('png', 'rgba'), ('tga', 'rgba'), ('tiff', 'rgba'), ('png', 'gray8'), ('tga', 'gray8'), ('tiff', 'gray8'), ('flac', 's32'), ('pcm_s24le', 's32'), ('pcm_s32le', 's32')) AS v(name, format)")
def codec_capabilities(spark, sf_dir):
    d, c = catalog.dimension(spark, "codec_descriptors"), catalog.dimension(spark, "capabilities")
    pick = lambda f, **more: registry.supporting(d, c, **more).select("name", F.lit(f).alias("format"))
    return pick("rgba", pixel_format="rgba").unionByName(pick("gray8", pixel_format="gray8")).unionByName(pick("s32", sample_format="s32"))


# --- sample tables -----------------------------------------------------------


@query("""WITH r AS (SELECT p_brand AS track, p_partkey AS value, p_size - 3 AS n_runs, coalesce(sum(greatest(p_size - 3, 0)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM part)
SELECT track, CAST(first + k AS BIGINT) AS n, value FROM r, unnest(range(greatest(n_runs, 0))) AS u(k)""")
def rle_expand(spark, sf_dir):
    runs = read(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size").select(F.col("p_brand").alias("track"), F.col("p_partkey").alias("idx"), (F.col("p_size") - 3).alias("runs"))
    return sampletable.rle_expand(runs, ["track"], "idx", "runs", "idx")


def _chunks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    chunk = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    o = o.select(F.col("o_custkey").alias("track"), chunk.alias("chunk"), "o_orderstatus", F.ascii("o_orderpriority").alias("code"))
    stsc = o.where("chunk = 1 or o_orderstatus = 'F'").select("track", F.col("chunk").alias("first_chunk"), (F.col("code") % 5).cast("long").alias("samples_per_chunk"))
    return o.select("track", "chunk", (F.col("chunk") * 100_000).alias("offset")), stsc


CHUNKS_SQL = """WITH o AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS chunk, o_orderstatus, ascii(o_orderpriority) AS code FROM orders),
stsc AS (SELECT track, chunk AS first_chunk, code % 5 AS per, lead(chunk) OVER (PARTITION BY track ORDER BY chunk) AS next FROM o WHERE chunk = 1 OR o_orderstatus = 'F'),
c AS (SELECT o.track, o.chunk, o.chunk * 100000 AS "offset", CAST(per AS BIGINT) AS samples_per_chunk FROM o JOIN stsc s ON s.track = o.track AND o.chunk >= first_chunk AND (next IS NULL OR o.chunk < next))"""


@query(CHUNKS_SQL + " SELECT * FROM c")
def chunk_fanout(spark, sf_dir):
    chunks, stsc = _chunks(spark, sf_dir)
    return sampletable.chunk_samples(stsc, chunks, "track")


ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query(CHUNKS_SQL + f""", sizes AS (SELECT o_custkey AS track, row_number() OVER (PARTITION BY o_custkey ORDER BY {", ".join(ITEM_ORDER)}) - 1 AS n, CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
slots AS (SELECT track, chunk, "offset", row_number() OVER (PARTITION BY track ORDER BY chunk, k) - 1 AS n FROM c, unnest(range(samples_per_chunk)) AS u(k))
SELECT s.track, s.n, size, chunk, CAST("offset" + coalesce(sum(size) OVER (PARTITION BY s.track, chunk ORDER BY s.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM sizes s JOIN slots t ON s.track = t.track AND s.n = t.n""")
def sample_offsets(spark, sf_dir):
    chunks, stsc = _chunks(spark, sf_dir)
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    items = read(spark, sf_dir, "lineitem", *ITEM_ORDER, "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*ITEM_ORDER)).cast("long") - 1
    sizes = items.select(F.col("o_custkey").alias("track"), n.alias("n"), F.col("l_quantity").cast("long").alias("size"))
    return sampletable.assign_samples(sampletable.chunk_samples(stsc, chunks, "track"), sizes, "track").select("track", "n", "size", "chunk", "pos")


EDITS_SQL = "edits AS (SELECT track, n AS idx, duration - 20 AS media_time, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS rate FROM packets), origin AS (SELECT track, arg_min(media_time, idx) AS origin FROM edits WHERE media_time >= 0 AND rate = 1 GROUP BY track)"


def _origin(p: DataFrame) -> DataFrame:
    edits = p.select("track", F.col("n").alias("idx"), (F.col("duration") - 20).alias("media_time"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("rate"))
    return sampletable.edit_origin(edits, "track", "idx", "media_time", "rate")


@query(f"WITH {PACKETS_SQL}, {EDITS_SQL} SELECT track, origin FROM origin")
def edit_list(spark, sf_dir):
    return _origin(packets(spark, sf_dir))


@query(DTS_SQL + f", {EDITS_SQL} SELECT t.track, n, dts - coalesce(origin, 0) AS dts, dts - coalesce(origin, 0) + (n % 3) * 10 AS pts FROM timed t LEFT JOIN origin o ON o.track = t.track")
def sample_pts(spark, sf_dir):
    p = packets(spark, sf_dir)
    p = p.join(_origin(p), "track", "left")
    return sampletable.timestamps(p, ["track"], ["n"], "duration", F.col("n") % 3 * 10, F.col("origin")).select("track", "n", "dts", "pts")


@query(f"WITH {PACKETS_SQL} SELECT track, n, track % 4 = 0 OR n IN (SELECT q.n FROM packets q WHERE q.track = packets.track AND q.is_keyframe) AS is_keyframe FROM packets")
def keyframes(spark, sf_dir):
    p = packets(spark, sf_dir)
    sync = p.where("is_keyframe and track % 4 <> 0").select("track", "n")
    return sampletable.keyframes(p.select("track", "n"), sync, "track", "n")


@query(DTS_SQL + " SELECT track, min(dts) AS start_time, CASE WHEN max(dts + duration) - min(dts) > 0 THEN max(dts + duration) - min(dts) ELSE 7 END AS duration, count(*) AS nb_frames FROM timed GROUP BY track")
def track_summary(spark, sf_dir):
    return sampletable.track_summary(timed(spark, sf_dir).withColumn("pts", F.col("dts")), ["track"], F.lit(7).cast("long"))


@query(f"""WITH {PACKETS_SQL}, r AS (SELECT track % 10 AS source, track, n, size, max(size) OVER (PARTITION BY track ORDER BY n) AS ready FROM packets)
SELECT source, track, n, size, row_number() OVER (PARTITION BY source ORDER BY ready, track, n) - 1 AS seq FROM r""")
def interleave_merge(spark, sf_dir):
    p = packets(spark, sf_dir).select((F.col("track") % 10).alias("source"), "track", "n", "size")
    return sampletable.interleave(p, ["source"], "track", "n", "size")


@query(f"""WITH {PACKETS_SQL}, t AS (SELECT track, CASE track % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'video' ELSE 'audio' END AS type FROM (SELECT DISTINCT track FROM packets))
SELECT track % 10 AS source, track, type, row_number() OVER (PARTITION BY track % 10 ORDER BY track) - 1 AS index FROM t WHERE type <> 'none'""")
def live_tracks(spark, sf_dir):
    p = packets(spark, sf_dir).select((F.col("track") % 10).alias("source"), "track")
    kind = F.when(F.col("track") % 5 == 0, "none").when(F.col("track") % 5 == 1, "video").otherwise("audio")
    return sampletable.live_tracks(p.distinct().withColumn("type", kind), p, ["source"], "track")


# --- seeking -----------------------------------------------------------------

TARGETS = [-5, 0, 100, 500, 1000, 1_000_000]


def _targets(spark, p: DataFrame, mode: str) -> DataFrame:
    return p.select("track").distinct().withColumn("target", F.explode(F.array(*(F.lit(t).cast("long") for t in TARGETS)))).withColumn("mode", F.lit(mode))


def _seek_sql(best: str, mode: str) -> str:
    return DTS_SQL + f""", t AS (SELECT DISTINCT track, target FROM packets, unnest({TARGETS}::BIGINT[]) AS u(target)),
    b AS (SELECT t.track, target, {best} AS best, count(*) AS n_all FROM t JOIN timed p ON p.track = t.track GROUP BY ALL)
    SELECT track, target, '{mode}' AS mode, CASE WHEN target >= 0 THEN coalesce(best, n_all) END AS start_n, CASE WHEN target < 0 THEN 1001 ELSE 0 END AS error_code FROM b"""


def _seek(mode: str):
    def run(spark, sf_dir):
        p = timed(spark, sf_dir)
        return seek.seek(p, _targets(spark, p, mode), "track")

    run.__name__ = f"seek_{mode}"
    return run


_NEAR = "arg_min(n, abs(dts - target) * 1000000 + n)"
for _mode, _best in {
    "previous": "max(n) FILTER (WHERE is_keyframe AND dts <= target)",
    "next": "min(n) FILTER (WHERE is_keyframe AND dts >= target)",
    "closest": _NEAR + " FILTER (WHERE is_keyframe)",
    "any": _NEAR,
}.items():
    query(_seek_sql(_best, _mode))(_seek(_mode))


@query(f"""WITH {PACKETS_SQL}, p AS (SELECT track, n * 7 AS at, n AS point FROM packets WHERE n % 10 = 0), q AS (SELECT track, n * 5 + 3 AS at FROM packets)
SELECT q.track, q.at, max(p.at) AS as_of, max(p.point) AS point FROM q LEFT JOIN p ON p.track = q.track AND p.at <= q.at GROUP BY q.track, q.at""")
def flac_seekpoint_asof(spark, sf_dir):
    p = packets(spark, sf_dir)
    points = p.where("n % 10 = 0").select("track", (F.col("n") * 7).alias("at"), F.col("n").alias("point"))
    return seek.as_of(p.select("track", (F.col("n") * 5 + 3).alias("at")), points, "track", "at", ["point"])


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 0 END AS stream, CASE WHEN event_id % 3 = 0 THEN CAST(trunc(event_id * 1000.0 * 48000 / 1000000) AS BIGINT) ELSE event_id * 1000 END AS ticks,
  (event_id * 1000) // 1000000 * 44100 + ((event_id * 1000) % 1000000) * 44100 // 1000000 AS flac_sample, 44 + event_id * 2 * (24 // 8) AS wav_byte FROM events""")
def seek_units(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id")
    stream, ts = F.when(F.col("event_id") % 3 == 0, -1).otherwise(0), F.col("event_id") * 1000
    return e.select("event_id", stream.alias("stream"), timebase.seek_ticks(stream, ts, F.lit(48000)).alias("ticks"), seek.flac_sample(ts, F.lit(True), F.lit(44100)).alias("flac_sample"), seek.wav_byte(F.lit(44), F.col("event_id"), F.lit(2), F.lit(24)).alias("wav_byte"))


# --- containers whose packets are arithmetic ---------------------------------


@query("SELECT doc_id, k AS seq, k * 4096 AS pos, least(4096, n_chars - k * 4096) AS size, k * 4096 // 4 AS pts FROM documents, unnest(range((n_chars + 4095) // 4096)) AS u(k)")
def wav_packets(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "n_chars")
    return headers.wav_packets(d, F.col("n_chars"), F.lit(2), F.lit(16)).select("doc_id", "seq", "pos", "size", "pts")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 3 AND hz < 32000 THEN 576 ELSE 1152 END AS spf,
  CASE WHEN kbps > 0 THEN CAST(trunc(size / (kbps * 125.0) * hz) AS BIGINT) ELSE 0 END AS samples FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 44100 ELSE 22050 END AS hz, CAST(l_quantity AS BIGINT) * 8 - 80 AS kbps, CAST(l_partkey * 1000 AS DOUBLE) AS size FROM lineitem)""")
def mp3_duration(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    hz, kbps = F.when(F.col("l_suppkey") % 2 == 0, 44100).otherwise(22050), F.col("l_quantity").cast("long") * 8 - 80
    spf = timebase.mp3_samples_per_frame(F.col("l_linenumber"), hz)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", spf.alias("spf"), timebase.mp3_duration(F.col("l_partkey") * 1000, kbps, hz).alias("samples"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pts FROM conversations")
def webp_cumulative_pts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", sampletable.running(F.char_length("text"), ["conv_id"], ["turn"]).alias("pts"))


@query("SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN 16 WHEN 1 THEN 192 WHEN 2 THEN 576 WHEN 3 THEN 1152 WHEN 4 THEN 2304 WHEN 5 THEN 4608 WHEN 6 THEN p_size + 1 WHEN 7 THEN p_size * 256 + 1 ELSE 256 << CAST(p_partkey % 16 - 8 AS INTEGER) END AS block FROM part")
def flac_block_sizes(spark, sf_dir):
    code = F.col("p_partkey") % 16
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", timebase.flac_block_size(code, F.lit(16), F.col("p_size"), F.col("p_size") * 256).alias("block"))


@query("SELECT p_partkey, p_size AS png_width, p_size * 3 AS png_height, CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 16 END AS png_depth, p_size * 7 AS bmp_width, -p_size AS bmp_height, 24 AS bmp_bits, p_size * 11 AS tga_width, p_size * 13 AS tga_height, 32 AS tga_depth FROM part")
def image_headers(spark, sf_dir):
    """Headers of PNG, BMP and TGA files made from part, read back by the header expressions."""
    be = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    le = lambda c, n: F.concat(*(F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)))
    s = F.col("p_size").cast("long")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(s, 4), be(s * 3, 4), F.when(F.col("p_partkey") % 2 == 0, "08").otherwise("10"), F.lit("02000000"))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 8 + "36000000" + "28000000"), le(s * 7, 4), le(-s, 4), F.lit("01001800" + "00000000" + "00" * 20))
    tga = F.concat(F.lit("0000020000000000" + "00" * 4), le(s * 11, 2), le(s * 13, 2), F.lit("2008"))
    d = read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.unhex(png).alias("png"), F.unhex(bmp).alias("bmp"), F.unhex(tga).alias("tga"))
    p, b, t = headers.png(F.col("png")), headers.bmp(F.col("bmp")), headers.tga(F.col("tga"))
    return d.select(
        "p_partkey", p["width"].alias("png_width"), p["height"].alias("png_height"), p["depth"].alias("png_depth"),
        b["width"].alias("bmp_width"), b["height"].alias("bmp_height"), b["bits"].alias("bmp_bits"), t["width"].alias("tga_width"), t["height"].alias("tga_height"), t["depth"].alias("tga_depth"),
    )


# --- pictures and samples ----------------------------------------------------


@query(f"""WITH f AS {catalog.values_sql("pixel_formats")}, g AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i FROM f), p AS (SELECT p_partkey, p_size * 3 + 1 AS w, p_size * 2 + 1 AS h, p_partkey % 32 AS i FROM part),
x AS (SELECT p_partkey, name AS pixel_format, k AS plane, CASE WHEN k = 0 THEN w WHEN name = 'pal8' THEN 256 ELSE (w + sub_x - 1) // sub_x END AS plane_width, CASE WHEN k = 0 THEN h WHEN name = 'pal8' THEN 1 ELSE (h + sub_y - 1) // sub_y END AS plane_height, CASE WHEN k = 0 THEN bpp0 ELSE bpp1 END AS bpp FROM p JOIN g USING (i), unnest(range(planes)) AS u(k))
SELECT p_partkey, pixel_format, plane, plane_width, plane_height, (plane_width * bpp + 15) // 16 * 16 AS stride, (plane_width * bpp + 15) // 16 * 16 * plane_height AS plane_bytes FROM x""")
def plane_geometry(spark, sf_dir):
    names = sorted(r[0] for r in catalog.PIXEL_FORMATS)
    p = read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_size") * 3 + 1).alias("w"), (F.col("p_size") * 2 + 1).alias("h"), F.get(F.array(*(F.lit(n) for n in names)), (F.col("p_partkey") % 32).cast("int")).alias("pixel_format"))
    return pixels.planes(p, "w", "h", "pixel_format").drop("w", "h")


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 10 END AS bits, (p_partkey * 37) % 256 AS y, (p_partkey * 91) % 256 AS u, (p_partkey * 53) % 256 AS v FROM part),
s AS (SELECT *, CAST(255 AS FLOAT) / CAST((1 << bits) - 1 AS FLOAT) AS scale FROM x),
l AS (SELECT p_partkey, CAST(trunc(CAST(y AS FLOAT) * scale) AS INTEGER) AS y, CAST(trunc(CAST(u AS FLOAT) * scale) AS INTEGER) - 128 AS u, CAST(trunc(CAST(v AS FLOAT) * scale) AS INTEGER) - 128 AS v FROM s)
SELECT p_partkey, least(greatest(y + CAST(trunc(CAST(1.5748 AS FLOAT) * CAST(v AS FLOAT)) AS INTEGER), 0), 255) AS r,
  least(greatest(y - CAST(trunc(CAST(0.1873 AS FLOAT) * CAST(u AS FLOAT)) AS INTEGER) - CAST(trunc(CAST(0.4681 AS FLOAT) * CAST(v AS FLOAT)) AS INTEGER), 0), 255) AS g,
  least(greatest(y + CAST(trunc(CAST(1.8556 AS FLOAT) * CAST(u AS FLOAT)) AS INTEGER), 0), 255) AS b FROM l""")
def yuv_to_rgb(spark, sf_dir):
    k = F.col("p_partkey")
    r, g, b = pixels.yuv_to_rgb(k * 37 % 256, k * 91 % 256, k * 53 % 256, F.when(k % 2 == 0, 8).otherwise(10))
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ((v >> 10) & 31) << 3 AS r, ((v >> 5) & 31) << 3 AS g, (v & 31) << 3 AS b, CAST(255 AS BIGINT) * 16777216 + ((v & 31) << 3) * 65536 + (((v >> 5) & 31) << 3) * 256 + (((v >> 10) & 31) << 3) AS rgba, CASE WHEN v % 20 < 16 THEN (v % 20) * 17 END AS gray FROM (SELECT *, CAST((l_partkey * 31 + l_suppkey) % 65536 AS BIGINT) AS v FROM lineitem)")
def bgr_palette_555(spark, sf_dir):
    v = ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 65536).cast("long")
    r, g, b = pixels.rgb555(v)
    palette = F.array(*(F.lit(17 * k) for k in range(16)))
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(*li.columns, r.alias("r"), g.alias("g"), b.alias("b"), pixels.with_alpha(r, g, b).alias("rgba"), pixels.palette_colour(palette, (v % 20).cast("int")).alias("gray"))


def _cmyk_sql(x: str) -> str:
    left = lambda v: f"(CAST(1 AS FLOAT) - CAST({v} AS FLOAT) / CAST(255 AS FLOAT))"
    return f"CAST(trunc({left(x)} * {left('k')} * CAST(255 AS FLOAT)) AS INTEGER)"


@query(f"SELECT p_partkey, {_cmyk_sql('c')} AS r, {_cmyk_sql('m')} AS g, {_cmyk_sql('y')} AS b FROM (SELECT p_partkey, p_partkey * 3 % 256 AS c, p_partkey * 7 % 256 AS m, p_partkey * 11 % 256 AS y, p_size AS k FROM part)")
def cmyk_to_rgba(spark, sf_dir):
    k = F.col("p_partkey")
    r, g, b = pixels.cmyk_to_rgb(k * 3 % 256, k * 7 % 256, k * 11 % 256, F.col("p_size"))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT p_partkey, p_size // CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END AS cx, p_partkey // CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS cy FROM part")
def chroma_index(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    x, y = pixels.chroma_index(F.when(kind == 2, 1).otherwise(2), F.when(kind == 0, 2).otherwise(1), F.col("p_size"), F.col("p_partkey"))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", x.alias("cx"), y.alias("cy"))


@query("SELECT vec_id, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS peak, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 9) AS mean, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)), 9) AS rms FROM embeddings")
def pcm_levels(spark, sf_dir):
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", audio.peak(e).alias("peak"), F.round(audio.mean(e), 9).alias("mean"), F.round(audio.rms(e), 9).alias("rms"))


def _ints(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.floor(x.cast("double") * 1000).cast("string")), ",")


def _ints_sql(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',')"


@query(f"SELECT vec_id, {_ints_sql('embedding[1::2]')} AS left, {_ints_sql('embedding[2::2]')} AS right FROM embeddings".replace("embedding[1::2]", "list_filter(embedding, lambda x, i: i % 2 = 1)").replace("embedding[2::2]", "list_filter(embedding, lambda x, i: i % 2 = 0)").replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def deinterleave(spark, sf_dir):
    d = audio.deinterleave(F.col("embedding"), 2)
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", _ints(d[0]).alias("left"), _ints(d[1]).alias("right"))


@query(f"SELECT vec_id, {_ints_sql('list_transform(range(64), lambda i: embedding[1 + i // 2 + (i % 2) * 32])')} AS samples FROM embeddings")
def interleave(spark, sf_dir):
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", _ints(audio.interleave(F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)))).alias("samples"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN p_size * 65536 WHEN 3 THEN p_size * 256 ELSE p_size END AS sample, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 0 END * p_size * 2 AS bytes, greatest(0, least(1.5, p_size / 20.0 - 0.5)) AS gain FROM part")
def sample_formats(spark, sf_dir):
    k, s = F.col("p_partkey") % 5, F.col("p_size")
    bits = F.get(F.array(*map(F.lit, (0, 8, 16, 24, 32))), k.cast("int"))
    name = F.get(F.array(*map(F.lit, ("u8", "s16", "f32", "f64", "none"))), k.cast("int"))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", audio.normalise_bits(s, bits).alias("sample"), audio.buffer_bytes(s, F.lit(2), name).alias("bytes"), audio.gain(s / 20.0 - 0.5).alias("gain"))


@query("SELECT doc_id, k * 960 AS first, least(960, n_chars - k * 960) AS samples FROM documents, unnest(range((n_chars + 959) // 960)) AS u(k)")
def opus_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", F.explode(audio.opus_chunks(F.col("n_chars"), F.lit(48000))).alias("c"))
    return d.select("doc_id", "c.first", "c.samples")


# --- metadata and time -------------------------------------------------------


@query("""SELECT event_id, k AS as_int, CAST(k AS DOUBLE) AS as_double, CAST(k AS VARCHAR) AS as_text, k AS prefix_int, k + 0.5 AS prefix_double, 7 AS missing, CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END AS flag_text, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS flag_int,
  printf('%.6f', k / 8.0) AS half_text, CAST(trunc(k / 8.0) AS BIGINT) AS half_int, CAST(k AS VARCHAR) || '/' || CAST(event_id % 3 AS VARCHAR) AS ratio_text, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE k / (event_id % 3) END AS ratio, 'default' AS no_coercion, '<unsupported type>' AS list_text
FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def dict_coerce(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    variant = lambda text: F.parse_json(text)
    text = F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('.5abc"'))
    ratio = F.concat(F.lit('{"num":'), F.col("k").cast("string"), F.lit(',"den":'), (F.col("event_id") % 3).cast("string"), F.lit("}"))
    m = F.create_map(
        F.lit("k"), variant(F.col("k").cast("string")), F.lit("text"), variant(text), F.lit("flag"), variant((F.col("event_type") == "click").cast("string")),
        F.lit("half"), variant(F.format_string("%.6f", F.col("k") / 8.0)), F.lit("ratio"), variant(ratio), F.lit("list"), variant(F.lit("[1]")),
    )
    e = e.select("event_id", m.alias("m"))
    at = lambda key: F.try_element_at("m", F.lit(key))
    return e.select(
        "event_id", dictionary.get_int(F.col("m"), "k", -1).alias("as_int"), dictionary.get_double(F.col("m"), "k", -1).alias("as_double"), dictionary.to_text(at("k")).alias("as_text"),
        dictionary.get_int(F.col("m"), "text", -1).alias("prefix_int"), dictionary.to_double(at("text")).alias("prefix_double"), dictionary.get_int(F.col("m"), "none", 7).alias("missing"),
        dictionary.to_text(at("flag")).alias("flag_text"), dictionary.to_int(at("flag")).alias("flag_int"), dictionary.to_text(at("half")).alias("half_text"), dictionary.to_int(at("half")).alias("half_int"),
        dictionary.to_text(at("ratio")).alias("ratio_text"), dictionary.to_double(at("ratio")).alias("ratio"), dictionary.get_string(F.col("m"), "k", "default").alias("no_coercion"), dictionary.to_text(at("list")).alias("list_text"),
    )


@query("SELECT event_id, user_id + 1 AS num, event_id % 4 AS den, CASE WHEN event_id % 4 = 0 THEN 0 ELSE (user_id + 1) / CAST(event_id % 4 AS DOUBLE) END AS ratio, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS DOUBLE) * (user_id + 1) / (event_id % 4) END AS seconds, CASE WHEN event_id % 10 = 0 THEN '00:00' ELSE printf('%02d:%02d', event_id // 60, event_id % 60) END AS clock, least(event_id / 100.0, 1e9) AS progress FROM events")
def rational_seconds(spark, sf_dir):
    e, num, den = F.col("event_id"), F.col("user_id") + 1, F.col("event_id") % 4
    clock = timebase.mmss(F.when(e % 10 == 0, F.lit(-1.0)).otherwise(e + 0.5))
    return read(spark, sf_dir, "events", "event_id", "user_id").select("event_id", num.alias("num"), den.alias("den"), timebase.rational(num, den).alias("ratio"), timebase.seconds(e, num, den).alias("seconds"), clock.alias("clock"), timebase.progress(e, F.lit(100.0)).alias("progress"))


# --- player rules ------------------------------------------------------------

ROUTED = {"click": "video", "view": "audio", "purchase": "audio", "signup": "image", "error": "video"}


@query(f"SELECT user_id, type, min(event_id) AS index FROM (SELECT user_id, event_id, {_case(ROUTED)} AS type FROM events) WHERE type IN ('audio', 'video') GROUP BY ALL")
def stream_routing(spark, sf_dir):
    t = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select("user_id", F.col("event_id").alias("index"), _mapped(ROUTED).alias("type"))
    return playback.route(t, ["user_id"])


@query(DTS_SQL + " SELECT track, n, CASE WHEN dts / 1000.0 - n * 0.05 > 0.010 THEN 'hold' WHEN dts / 1000.0 - n * 0.05 < -0.100 THEN 'drop' ELSE 'show' END AS action FROM (SELECT track, n, CAST(dts AS DOUBLE) AS dts FROM timed)".replace("n * 0.05", "n / 20.0"))
def frame_pacing(spark, sf_dir):
    return timed(spark, sf_dir).select("track", "n", playback.pacing(F.col("dts") / 1000.0, F.col("n") / 20.0).alias("action"))


@query("""WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), y AS (SELECT *, CASE WHEN t - lag(t) OVER w < 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t)),
z AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) - 1 AS burst FROM y)
SELECT user_id, CAST(burst AS BIGINT) AS burst, min(t) AS first, max(t) AS last, count(*) AS requests, arg_max(event_id, t) AS event_id FROM z GROUP BY user_id, burst""")
def seek_debounce(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id", "ts").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return playback.debounce(e, "user_id", "at", F.lit(6 * 3600 * 1_000_000), ["event_id"])


@query(f"""WITH {PACKETS_SQL}, w AS (SELECT track, n, least(sum(size) OVER (PARTITION BY track ORDER BY n) / 5000.0, 1) AS fill FROM packets)
SELECT track, min(n) AS start_n, CAST(arg_min(fill, n) AS DOUBLE) AS fill FROM w WHERE fill >= 0.3 GROUP BY track""")
def buffer_start(spark, sf_dir):
    return playback.buffer_start(packets(spark, sf_dir), "track", ["n"], "size", 5000.0).withColumn("start_n", F.col("start_n").cast("long"))


@query("SELECT event_id, user_id % 100 / 100.0 >= 0.75 AND event_id % 100 / 100.0 >= 0.75 AND event_type <> 'error' AS paused, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id / (event_id % 5 * 4.0) END AS clock FROM events")
def player_clock(spark, sf_dir):
    e = F.col("event_id")
    video, sound = F.col("user_id") % 100 / 100.0, F.when(F.col("event_type") != "error", e % 100 / 100.0)
    return read(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", playback.read_ahead_pauses(video, sound).alias("paused"), playback.audio_clock(e, e % 5, F.lit(4)).alias("clock"))


@query(f"""WITH {PACKETS_SQL}, x AS (SELECT track, n, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY n) AS epoch FROM packets)
SELECT track, n, CAST(epoch AS BIGINT) AS epoch FROM (SELECT *, row_number() OVER (PARTITION BY track, epoch ORDER BY n) AS k FROM x) WHERE k <= 12""")
def seek_epochs(spark, sf_dir):
    p = playback.epochs(packets(spark, sf_dir), "track", ["n"], F.col("event_type") == "signup")
    return playback.prefetch(p.withColumn("seq", F.col("n")), ["track", "epoch"], F.lit(0)).select("track", "n", "epoch")


# --- muxing and errors -------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE CAST(trunc(CAST(CASE WHEN event_id % 7 = 0 THEN event_id * 2 ELSE event_id END AS DOUBLE) * 1001 / 30000 * 1e9) AS BIGINT) END AS ns FROM events""")
def mux_timestamps(spark, sf_dir):
    e = F.col("event_id")
    pts, dts = F.when(e % 7 == 0, -1).otherwise(e), F.when(e % 11 == 0, -1).otherwise(e * 2)
    return read(spark, sf_dir, "events", "event_id").select("event_id", timebase.mux_nanoseconds(pts, dts, F.when(e % 5 == 0, 0).otherwise(1001), F.lit(30000)).alias("ns"))


@query("SELECT event_id, user_id, 3007 AS error_code FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def mux_orphans(spark, sf_dir):
    tracks = read(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"))
    return muxing.orphans(read(spark, sf_dir, "events", "event_id", "user_id"), tracks, ["user_id"])


@query(f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{m}')" for k, m in enumerate([*catalog.RATE_MODES, "other"]))}) AS v(i, mode)),
x AS (SELECT p_partkey, mode, CASE WHEN i < 10 THEN i END AS mode_index, p_size - 10 AS target, CASE WHEN p_partkey % 2 = 0 THEN p_size / 2.0 END AS quality, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS qp FROM part JOIN m ON p_partkey % 11 = i)
SELECT p_partkey, mode, mode_index, coalesce(mode IN ('vbr', 'cbr', 'abr'), false) AS updates, CASE WHEN mode IN ('crf', 'icq') AND quality IS NOT NULL THEN 0 WHEN mode = 'cqp' AND qp IS NOT NULL THEN 0 WHEN mode IN ('cbr', 'vbr', 'abr', 'hqcbr', 'hqvbr', 'qvbr', 'vbr_lat') AND target > 0 THEN 0 ELSE 4004 END AS error_code FROM x""")
def rate_control(spark, sf_dir):
    k = F.col("p_partkey")
    mode = F.get(F.array(*map(F.lit, [*catalog.RATE_MODES, "other"])), (k % 11).cast("int"))
    code = muxing.rate_control_error(mode, F.col("p_size") - 10, F.when(k % 2 == 0, F.col("p_size") / 2.0), F.when(k % 3 == 0, F.col("p_size")))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", mode.alias("mode"), muxing.mode_index(mode).alias("mode_index"), muxing.bitrate_updates(mode).alias("updates"), code.alias("error_code"))


@query(f"""WITH e AS {catalog.values_sql("errors")}, x AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 6) * 1000 + event_id % 5 END AS code, value FROM events)
SELECT event_id, x.code, coalesce(e.name, CASE WHEN x.code IS NULL THEN 'success' END) AS name, CASE WHEN x.code IS NULL THEN 'success' ELSE ['success', 'common', 'io', 'format', 'codec', 'frame'][x.code // 1000 + 1] END AS band, CASE WHEN x.code IS NULL THEN event_id ELSE -1 END AS value_or FROM x LEFT JOIN e ON e.code = x.code""")
def error_bands(spark, sf_dir):
    e = F.col("event_id")
    x = read(spark, sf_dir, "events", "event_id").withColumn("code", F.when(e % 6 != 0, (e % 6 * 1000 + e % 5)))
    dim = catalog.dimension(spark, "errors").select(F.col("code").alias("c"), "name")
    x = x.join(F.broadcast(dim), F.coalesce("code", F.lit(0)) == F.col("c"), "left")
    return x.select("event_id", "code", "name", errors.band(F.col("code")).alias("band"), errors.unwrap_or(F.col("event_id"), F.col("code"), -1).alias("value_or"))


@query("SELECT coalesce(code, 0) AS error_code, count(*) AS n FROM (SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 6) * 1000 + event_id % 5 END AS code FROM events) GROUP BY 1")
def error_counts(spark, sf_dir):
    e = F.col("event_id")
    return errors.counts(read(spark, sf_dir, "events", "event_id").select(F.when(e % 6 != 0, (e % 6 * 1000 + e % 5)).alias("error_code")))


@query(DTS_SQL + """, b AS (SELECT track, max(n) FILTER (WHERE is_keyframe AND dts <= 1000) AS best, count(*) AS n_all FROM timed GROUP BY track)
SELECT b.track, coalesce(best, n_all) AS start_n, t.dts AS start_dts, t.size FROM b LEFT JOIN timed t ON t.track = b.track AND t.n = coalesce(best, n_all)""")
def seek_packet(spark, sf_dir):
    """For each track, the key packet to start from for time 1000."""
    p = timed(spark, sf_dir)
    targets = p.select("track").distinct().select("track", F.lit(1000).cast("long").alias("target"), F.lit("previous").alias("mode"))
    found = seek.seek(p, targets, "track").select(F.col("track").alias("t"), "start_n")
    return found.join(p, (F.col("t") == F.col("track")) & (F.col("start_n") == F.col("n")), "left").select(F.col("t").alias("track"), "start_n", F.col("dts").alias("start_dts"), "size")
