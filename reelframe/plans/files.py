"""Queries over files: their bytes are made from the driver's tables, parsed and decoded again, and compared with SQL over the source columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe import catalog
from reelframe.functions import bitstream, dictionary
from reelframe.operators import decode, plugins, registry, seekfile
from reelframe.plans.queries import DTS_SQL, PACKETS_SQL, packets, query, read, timed
from reelframe.sources import demux, sinks


def be(c, n: int) -> Column:
    """Hex digits of a big-endian number of n bytes."""
    return F.lpad(F.hex(F.lit(c).cast("long") if isinstance(c, int) else c.cast("long")), 2 * n, "0")


def le(c, n: int) -> Column:
    """Hex digits of a little-endian number of n bytes."""
    c = F.lit(c) if isinstance(c, int) else c
    return F.concat(*(F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)))


def le_sql(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', ({x} >> {8 * k}) & 255)" for k in range(n))


def text_hex(c: str) -> Column:
    return F.hex(F.encode(c, "UTF-8"))


def as_files(df: DataFrame, path: Column, digits: Column) -> DataFrame:
    """Sources of files whose content is given in hex; path names the row."""
    return with_content(df, path, F.unhex(digits))


def with_content(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Sources of files of the content given; path names the row."""
    return demux.sources(df.select(path.cast("string").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content")))


def key_of(name: str = "path") -> Column:
    return F.regexp_extract(name, r"^(\d+)", 1).cast("long")


def wav_hex(size: Column, data: Column, channels: int, rate: int, bits: int) -> Column:
    block = channels * bits // 8
    return F.concat(F.lit("52494646"), le(size + 36, 4), F.lit("57415645666D742010000000" + "0100"), le(channels, 2), le(rate, 4), le(rate * block, 4), le(block, 2), le(bits, 2), F.lit("64617461"), le(size, 4), data)


# --- sound ---------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, hex(text) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0)
SELECT doc_id, k AS seq, k * 4096 AS pts, least(4096, n - k * 4096) AS nb_samples, n AS track_samples, sha256(substr(h, 8192 * k + 1, 8192)) AS plane_sha256 FROM d, unnest(range((n + 4095) // 4096)) AS u(k)""")
def wav_text(spark, sf_dir):
    """Whole texts as the samples of 8-bit WAV files: detected, demuxed to packets of 4096 bytes, decoded."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("octet_length(text) > 0")
    src = as_files(d, F.col("doc_id"), wav_hex(F.octet_length("text"), text_hex("text"), 1, 8000, 8))
    tracks = demux.tracks(src)
    frames = decode.decode(demux.packets(src), tracks)
    n = tracks.select(F.col("path").alias("t_path"), F.col("duration").alias("track_samples"))
    return frames.join(n, F.col("path") == F.col("t_path")).select(
        key_of().alias("doc_id"), "seq", "pts", F.col("audio.nb_samples").alias("nb_samples"), "track_samples", F.sha2(F.hex(F.col("audio.planes")[0]), 256).alias("plane_sha256"),
    )


STEREO_SQL = f"WITH {PACKETS_SQL}, s AS (SELECT track, n, size % 32768 AS l, (duration * 7919) % 65536 - 32768 AS r FROM packets)"


def _stereo(spark, sf_dir) -> DataFrame:
    """Sources of 16-bit stereo WAV files, one for each user: the sizes and durations of the user's packets."""
    p = packets(spark, sf_dir).select("track", "n", (F.col("size") % 32768).alias("l"), ((F.col("duration") * 7919) % 65536 - 32768).alias("r"))
    rows = p.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(le(F.col("l"), 2), le(F.col("r"), 2)).alias("h")))).alias("x"))
    return as_files(rows, F.col("track"), wav_hex(F.size("x") * 4, F.array_join(F.col("x.h"), ""), 2, 8000, 16))


@query(STEREO_SQL + f" SELECT track, 's16' AS sample_format, count(*) AS nb_samples, string_agg({le_sql('l', 2)} || {le_sql('r', 2)}, '' ORDER BY n) AS plane FROM s GROUP BY track")
def pcm_stereo(spark, sf_dir):
    src = _stereo(spark, sf_dir)
    f = decode.decode(demux.packets(src), demux.tracks(src))
    return f.select(key_of().alias("track"), F.col("audio.sample_format").alias("sample_format"), F.col("audio.nb_samples").alias("nb_samples"), F.hex(F.col("audio.planes")[0]).alias("plane"))


@query(STEREO_SQL + f" SELECT track, count(*) AS nb_samples, count(*) AS track_samples, 16 AS bits, string_agg({le_sql('l', 4)}, '' ORDER BY n) AS left_plane, string_agg({le_sql('r', 4)}, '' ORDER BY n) AS right_plane FROM s GROUP BY track")
def flac_round_trip(spark, sf_dir):
    """WAV to FLAC and back: planar 32-bit samples at 16 bits of depth."""
    wav = _stereo(spark, sf_dir)
    src = demux.sources(sinks.mux_flac(demux.packets(wav), demux.tracks(wav)).select("path", F.octet_length("content").cast("long").alias("length"), "content"))
    tracks = demux.tracks(src)
    f = decode.decode(demux.packets(src), tracks)
    n = tracks.select(F.col("path").alias("t_path"), F.col("duration").alias("track_samples"))
    return f.join(n, F.col("path") == F.col("t_path")).select(
        key_of().alias("track"), F.col("audio.nb_samples").alias("nb_samples"), "track_samples", F.col("audio.bits_per_sample").alias("bits"), F.hex(F.col("audio.planes")[0]).alias("left_plane"), F.hex(F.col("audio.planes")[1]).alias("right_plane"),
    )


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as shuffles have, for rows that are small until files are made from them: a few MB of a table would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _mp3s(spark, sf_dir) -> DataFrame:
    p = spread(read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name"))
    frame = F.rpad(F.concat(F.lit(bytes.fromhex("FFFB9000")), F.encode("p_name", "UTF-8")), 417, F.lit(b"\0"))
    return with_content(p, F.col("p_partkey"), F.concat(F.lit(b"ID3\4" + bytes(6)), F.rpad(frame, F.col("p_size") * 417, frame)))


@query("SELECT p_partkey, k AS seq, k * 1152 AS pts, 10 + k * 417 AS pos, 1152 AS duration, 417 AS size, 44100 AS sample_rate, 2 AS channels FROM part, unnest(range(p_size)) AS u(k)")
def mp3_packets(spark, sf_dir):
    """MP3 files of p_size frames behind an empty ID3 tag: a packet for each frame, its pts the samples before it."""
    p = demux.packets(_mp3s(spark, sf_dir), track=["audio"])
    return p.select(F.col("path").cast("long").alias("p_partkey"), "seq", "pts", "pos", "duration", F.octet_length("payload").alias("size"), F.col("track_audio.sample_rate").alias("sample_rate"), F.col("track_audio.channels").alias("channels"))


def _pages(c: DataFrame) -> DataFrame:
    """Sources of Ogg files, one for each conversation: an Opus head, then a page for each turn."""
    def page(flags, granule, n, size, body):
        full = (size / 255).cast("int")
        return F.concat(F.lit("4F67675300"), flags, le(granule, 8), le(F.lit(5), 4), le(n, 4), F.lit("00" * 4), le(full + 1, 1), F.repeat(F.lit("FF"), full), le(size % 255, 1), body)

    head = page(F.lit("02"), F.lit(0), F.lit(0), F.lit(19), F.lit("4F707573486561640102" + "0000" + "80BB0000" + "000000"))
    turns = page(F.lit("00"), (F.col("turn") + 1) * 960, F.col("turn") + 1, F.octet_length("text"), text_hex("text"))
    rows = c.select("conv_id", "turn", turns.alias("h")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("x"))
    return as_files(rows, F.col("conv_id"), F.concat(head, F.array_join(F.col("x.h"), "")))


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, hex(text) AS h FROM conversations)
SELECT conv_id, seq, (turn + 1) * 960 AS pts, 'opus' AS codec, 48000 AS ticks, sha256(h) AS payload_sha256 FROM c
UNION ALL SELECT DISTINCT conv_id, 0, 0, 'opus', 48000, sha256('4F707573486561640102000080BB0000000000') FROM c""")
def ogg_packets(spark, sf_dir):
    src = _pages(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"))
    t = demux.tracks(src).select(F.col("path").alias("t_path"), "codec", F.col("time_base.den").alias("ticks"))
    return demux.packets(src).join(t, F.col("path") == F.col("t_path")).select(key_of().alias("conv_id"), "seq", "pts", "codec", "ticks", F.sha2(F.hex("payload"), 256).alias("payload_sha256"))


# --- pictures --------------------------------------------------------------------


def pixels_of(src: DataFrame, name: str) -> DataFrame:
    f = decode.decode(demux.packets(src), demux.tracks(src))
    return f.select(key_of().alias("p_partkey"), F.col("sub_seq").alias("frame"), F.col("picture.pixel_format").alias("pixel_format"), F.col("picture.width").alias("width"), F.col("picture.height").alias("height"), F.hex(F.col("picture.planes")[0]["data"]).alias(name))


def _bgr(c: Column) -> Column:
    return F.concat(F.substring(c, 5, 2), F.substring(c, 3, 2), F.substring(c, 1, 2))


def _bmps(spark, sf_dir) -> DataFrame:
    """Sources of 24-bit BMP files of two by two pixels from the digest of p_name; rows run upward and are padded."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.upper(F.md5("p_name")).alias("m"))
    px = [_bgr(F.substring("m", 6 * k + 1, 6)) for k in range(4)]
    head = "424D" + "46000000" + "00" * 4 + "36000000" + "28000000" + "02000000" + "02000000" + "0100" + "1800" + "00" * 24
    return as_files(p, F.col("p_partkey"), F.concat(F.lit(head), px[2], px[3], F.lit("0000"), px[0], px[1], F.lit("0000")))


RGBA_SQL = "SELECT p_partkey, 0 AS frame, 'rgba' AS pixel_format, 2 AS width, 2 AS height, " + " || 'FF' || ".join(f"substr(m, {6 * k + 1}, 6)" for k in range(4)) + " || 'FF' AS rgba FROM (SELECT p_partkey, upper(md5(p_name)) AS m FROM part)"


@query(RGBA_SQL)
def bmp_pixels(spark, sf_dir):
    return pixels_of(_bmps(spark, sf_dir), "rgba")


@query(RGBA_SQL)
def png_round_trip(spark, sf_dir):
    """BMP pictures written as PNG files, which are read again."""
    bmp = _bmps(spark, sf_dir)
    png = sinks.mux_png(decode.decode(demux.packets(bmp), demux.tracks(bmp)))
    return pixels_of(demux.sources(png.select("path", F.octet_length("content").cast("long").alias("length"), "content")), "rgba")


@query(RGBA_SQL)
def tga_pixels(spark, sf_dir):
    """Run-length TGA files, rows downward; the container is named by the caller, since TGA has no signature."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.upper(F.md5("p_name")).alias("m"))
    px = [_bgr(F.substring("m", 6 * k + 1, 6)) for k in range(4)]
    content = F.unhex(F.concat(F.lit("00000A" + "00" * 9 + "0200" + "0200" + "18" + "20"), F.lit("80"), px[0], F.lit("02"), px[1], px[2], px[3]))
    files = p.select(F.col("p_partkey").cast("string").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return pixels_of(demux.sources(files, container="tga"), "rgba")


@query("""WITH c AS (SELECT p_partkey, p_name, unnest(range(1, CAST(length(p_name) AS BIGINT) + 1)) AS i FROM part)
SELECT p_partkey, 0 AS frame, 'rgba' AS pixel_format, length(p_name) AS width, 1 AS height, string_agg(repeat(printf('%02X', ascii(substr(p_name, i, 1)) * 2), 3) || 'FF', '' ORDER BY i) AS rgba FROM c GROUP BY p_partkey, p_name""")
def gif_pixels(spark, sf_dir):
    """GIF files of one row: the letters of p_name as indices of a gray palette, in codes of eight bits behind a clear code."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name")
    n = F.char_length("p_name")
    palette = "".join(f"{2 * k:02X}" * 3 for k in range(128))
    return pixels_of(as_files(p, F.col("p_partkey"), F.concat(F.lit("474946383961"), le(n, 2), F.lit("0100" + "F60000" + palette + "2C" + "00" * 4), le(n, 2), F.lit("0100" + "00" + "07"), le(n + 2, 1), F.lit("80"), text_hex("p_name"), F.lit("81" + "00" + "3B"))), "rgba")


@query("SELECT p_partkey, 0 AS frame, 'gray8' AS pixel_format, length(p_name) AS width, 1 AS height, hex(p_name) AS gray FROM part")
def tiff_pixels(spark, sf_dir):
    """Uncompressed gray TIFF files in either byte order."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name")
    n = F.char_length("p_name")

    def content(num, order, magic):
        def entry(tag, kind, value):
            return F.concat(num(F.lit(tag), 2), num(F.lit(kind), 2), num(F.lit(1), 4), num(value, 2) if kind == 3 else num(value, 4), F.lit("0000" if kind == 3 else ""))

        fields = [(256, 3, n), (257, 3, F.lit(1)), (258, 3, F.lit(8)), (259, 3, F.lit(1)), (262, 3, F.lit(1)), (273, 4, F.lit(8)), (277, 3, F.lit(1)), (278, 3, F.lit(1)), (279, 4, n)]
        return F.concat(F.lit(order + magic), num(n + 8, 4), text_hex("p_name"), num(F.lit(len(fields)), 2), *(entry(*f) for f in fields), F.lit("00" * 4))

    digits = F.when(F.col("p_partkey") % 2 == 0, content(le, "4949", "2A00")).otherwise(content(be, "4D4D", "002A"))
    return pixels_of(as_files(p, F.col("p_partkey"), digits), "gray")


@query("SELECT p_partkey, p_size * 3 AS width, p_size * 5 AS height, 'jpeg' AS codec, 1 AS packets, 23 + length(p_name) AS size FROM part")
def jpeg_headers(spark, sf_dir):
    """JPEG files up to the frame header, behind a comment of p_name: their size, and the file as one packet."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name")
    digits = F.concat(F.lit("FFD8FFFE"), be(F.char_length("p_name") + 2, 2), text_hex("p_name"), F.lit("FF01FFC2000B08"), be(F.col("p_size") * 5, 2), be(F.col("p_size") * 3, 2), F.lit("01011100"), F.lit("FFD9"))
    src = as_files(p, F.col("p_partkey"), digits)
    t = demux.tracks(src).select(F.col("path").alias("t_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), "codec")
    n = demux.packets(src).groupBy("path").agg(F.count(F.lit(1)).alias("packets"), F.max(F.octet_length("payload")).alias("size"))
    return t.join(n, F.col("path") == F.col("t_path")).select(key_of().alias("p_partkey"), "width", "height", "codec", "packets", "size")


@query("""WITH c AS (SELECT p_partkey, p_name, unnest(range(1, CAST(length(p_name) AS BIGINT) + 1)) AS i FROM part)
SELECT p_partkey, 0 AS frame, 'rgba' AS pixel_format, 8 * length(p_name) AS width, 8 AS height,
  repeat(string_agg(repeat(repeat(printf('%02X', 192 + ascii(substr(p_name, i, 1)) // 2), 3) || 'FF', 8), '' ORDER BY i), 8) AS rgba FROM c GROUP BY p_partkey, p_name""")
def jpeg_pixels(spark, sf_dir):
    """Gray JPEG files with a flat block for each letter of p_name: a code of two bits, eight bits of its level, the end of the block, then a restart marker."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name")
    n = F.char_length("p_name")
    level = lambda i: 128 + 2 * F.floor(F.ascii(F.substr(F.col("p_name"), i, F.lit(1))) / 2)
    block = lambda i: F.concat(be(level(i) * 64 + 31, 2), F.when(i < n, F.concat(F.lit("FFD"), ((i - 1) % 8).cast("string"))).otherwise(""))
    table = lambda kind, counts, symbol: f"FFC40014{kind}{counts}" + "00" * (16 - len(counts) // 2) + symbol
    head = F.concat(F.lit("FFD8" + "FFDB004300" + "04" * 64 + "FFC0000B080008"), be(8 * n, 2), F.lit("01011100" + table("00", "0001", "08") + table("10", "01", "00") + "FFDD00040001" + "FFDA0008010100003F00"))
    return pixels_of(as_files(p, F.col("p_partkey"), F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), n), block), ""), F.lit("FFD9"))), "rgba")


WEBP_SQL = "WITH c AS (SELECT conv_id, turn, row_number() OVER w - 1 AS seq, length(text) AS delay, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pts FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


def _webps(spark, sf_dir) -> DataFrame:
    """Sources of animated WebP files: a frame for each turn, shown for a millisecond for each letter."""
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    frame = F.concat(F.lit("414E4D46" + "10000000" + "00" * 12), le(F.char_length("text"), 3), F.lit("00"))
    rows = c.select("conv_id", "turn", frame.alias("h")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("x"))
    return as_files(rows, F.col("conv_id"), F.concat(F.lit("52494646"), le(F.size("x") * 24 + 22, 4), F.lit("57454250" + "56503858" + "0A000000" + "02000000"), le(F.col("conv_id") % 100, 3), le(F.col("conv_id") % 50, 3), F.array_join(F.col("x.h"), "")))


@query(WEBP_SQL + " SELECT conv_id, seq, pts, delay AS duration, conv_id % 100 + 1 AS width, conv_id % 50 + 1 AS height, CAST(sum(delay) OVER (PARTITION BY conv_id) AS BIGINT) AS track_duration, count(*) OVER (PARTITION BY conv_id) AS nb_frames FROM c")
def webp_packets(spark, sf_dir):
    src = _webps(spark, sf_dir)
    t = demux.tracks(src).select(F.col("path").alias("t_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("duration").alias("track_duration"), "nb_frames")
    return demux.packets(src).join(t, F.col("path") == F.col("t_path")).select(key_of().alias("conv_id"), "seq", "pts", "duration", "width", "height", "track_duration", "nb_frames")


# --- containers of several tracks -----------------------------------------------------


def _movie(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Packets and tracks, one path for each user: clicks and views are video, the rest sound; a payload is its packet's event type and number."""
    p = timed(spark, sf_dir)
    video = F.col("event_type").isin("click", "view")
    per_stream = Window.partitionBy("track", "stream_index").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("stream_index", F.when(video, 0).otherwise(1)).withColumn("dts", F.coalesce(F.sum("duration").over(per_stream), F.lit(0)))
    out = p.select(
        F.col("track").cast("string").alias("path"), F.col("n").alias("seq"), "stream_index", (F.col("dts") + F.col("n") % 3).alias("pts"), "dts", "duration", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("flags"),
        (F.col("is_keyframe") | ~video).alias("is_keyframe"), F.encode(F.concat_ws(":", "event_type", "n"), "UTF-8").alias("payload"), F.lit(0).alias("error_code"),
    )
    kinds = out.select("path", "stream_index").distinct()
    picture = F.col("stream_index") == 0
    tracks = kinds.select(
        "path", F.col("stream_index").alias("index"), F.col("stream_index").alias("id"), F.when(picture, "video").otherwise("audio").alias("type"), F.when(picture, "vp9").otherwise("pcm_s16le").alias("codec"), F.lit(None).cast("binary").alias("extradata"),
        F.when(~picture, F.struct(F.lit(8000).cast("long").alias("sample_rate"), F.lit(2).cast("long").alias("channels"), F.lit(16).cast("long").alias("bit_depth"))).alias("audio"),
        F.when(picture, F.struct(F.lit(64).cast("long").alias("width"), F.lit(48).cast("long").alias("height"))).alias("video"), F.struct(F.lit(1).alias("num"), F.lit(1000).alias("den")).alias("time_base"),
    )
    return out, tracks


MOVIE_SQL = DTS_SQL + """, m AS (SELECT track, n, event_type || ':' || n AS payload, duration, is_keyframe OR event_type NOT IN ('click', 'view') AS is_keyframe, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS stream_index FROM timed),
mt AS (SELECT *, CAST(coalesce(sum(duration) OVER (PARTITION BY track, stream_index ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts, CAST(28 + coalesce(sum(length(payload)) OVER (PARTITION BY track ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM m)"""


def _movies(spark, sf_dir) -> DataFrame:
    files = sinks.mux_mp4(*_movie(spark, sf_dir))
    return demux.sources(files.select("path", F.octet_length("content").cast("long").alias("length"), "content"))


@query(MOVIE_SQL + " SELECT track, n AS seq, stream_index, dts + n % 3 AS pts, dts, duration, pos, is_keyframe, payload FROM mt")
def mp4_packets(spark, sf_dir):
    """ISO files written and demuxed again: chunks, sizes, both times, key frames and bytes of every packet."""
    p = demux.packets(_movies(spark, sf_dir))
    return p.select(key_of().alias("track"), "seq", "stream_index", "pts", "dts", "duration", "pos", "is_keyframe", F.decode("payload", "UTF-8").alias("payload"))


@query(MOVIE_SQL + " SELECT track, stream_index AS index, CASE stream_index WHEN 0 THEN 'video' ELSE 'audio' END AS type, CASE stream_index WHEN 0 THEN 'vp9' ELSE 'pcm_s16le' END AS codec, min(dts + n % 3) AS start_time, max(dts + n % 3 + duration) - min(dts + n % 3) AS duration, count(*) AS nb_frames, any_value(CASE stream_index WHEN 0 THEN 64 END) AS width, any_value(CASE stream_index WHEN 1 THEN 8000 END) AS sample_rate FROM mt GROUP BY track, stream_index")
def mp4_tracks(spark, sf_dir):
    t = demux.tracks(_movies(spark, sf_dir))
    return t.select(key_of().alias("track"), "index", "type", "codec", "start_time", "duration", "nb_frames", F.col("video.width").alias("width"), F.col("audio.sample_rate").alias("sample_rate"))


@query(MOVIE_SQL + " SELECT track, type, depth, count(*) AS boxes FROM (SELECT DISTINCT track, stream_index FROM mt) s, (VALUES ('trak', 1), ('mdia', 2), ('minf', 3), ('stbl', 4), ('stsd', 5), ('stts', 5), ('stsc', 5), ('stco', 5), ('stsz', 5), ('mdhd', 3), ('hdlr', 3), ('tkhd', 2)) b(type, depth) GROUP BY ALL UNION ALL SELECT DISTINCT track, t, 0, 1 FROM mt, unnest(['ftyp', 'mdat', 'moov']) u(t)")
def mp4_boxes(spark, sf_dir):
    b = demux.boxes(_movies(spark, sf_dir)).where(~F.col("type").isin("mvhd", "ctts", "stss"))
    return b.groupBy(key_of().alias("track"), "type", "depth").agg(F.count(F.lit(1)).alias("boxes"))


@query(MOVIE_SQL + ", k AS (SELECT *, CAST(trunc(CAST(dts + n % 3 AS DOUBLE) / 1000 * 1e9) AS BIGINT) AS ns FROM mt), x AS (SELECT *, ns // 1000000 AS pts FROM k) SELECT track, row_number() OVER (PARTITION BY track ORDER BY ns, n) - 1 AS seq, stream_index, pts, is_keyframe, payload FROM x")
def matroska_round_trip(spark, sf_dir):
    """Matroska files written in order of time and demuxed again, in ticks of a millisecond; times go through seconds as doubles and are cut."""
    files = sinks.mux_matroska(*_movie(spark, sf_dir))
    src = demux.sources(files.select("path", F.octet_length("content").cast("long").alias("length"), "content"))
    return demux.packets(src).select(key_of().alias("track"), "seq", "stream_index", "pts", "is_keyframe", F.decode("payload", "UTF-8").alias("payload"))


@query(MOVIE_SQL + ", k AS (SELECT *, dts + n % 3 AS pts FROM mt) SELECT track, min(pts) AS first_cue, count(*) > 0 AS has_cues FROM k GROUP BY track")
def matroska_cues(spark, sf_dir):
    files = sinks.mux_matroska(*_movie(spark, sf_dir))
    src = demux.sources(files.select("path", F.octet_length("content").cast("long").alias("length"), "content"))
    return demux.cue_points(src).groupBy(key_of().alias("track")).agg(F.min("time").alias("first_cue"), (F.count(F.lit(1)) > 0).alias("has_cues"))


# --- bitstreams -------------------------------------------------------------------------


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '0000000167420020' ELSE '' END || '00000001' || hex(text) || '0000000141' AS annexb FROM benchmark")
def annexb_units(spark, sf_dir):
    """Length-prefixed units of whole texts and one byte, with an empty unit between, as start-code units; key frames begin with the parameter sets."""
    b = read(spark, sf_dir, "benchmark", "item_id", "text")
    sample = F.unhex(F.concat(be(F.octet_length("text"), 4), text_hex("text"), F.lit("00000000" + "00000001" + "41")))
    return b.select("item_id", F.hex(bitstream.annexb_of(4, bytes.fromhex("0000000167420020"))(sample, F.col("item_id") % 2 == 0)).alias("annexb"))


def _table_sql(bits: int, polynomial: int) -> str:
    """SQL of the 256 entries of a table of remainders, one step of a bit after the other."""
    step = "(range(256))" if bits == 8 else "(list_transform(range(256), lambda x: x << 8))"
    for _ in range(8):
        step = f"list_transform({step}, lambda x: CASE WHEN x & {1 << bits - 1} <> 0 THEN xor(x << 1, {polynomial}) & {(1 << bits) - 1} ELSE x << 1 END)"
    return step


CHECK_SQL = f"""WITH t AS (SELECT {_table_sql(8, 7)} AS t8, {_table_sql(16, 0x8005)} AS t16),
b AS (SELECT item_id, list_transform(range(1, strlen(text) + 1), lambda i: CAST('0x' || substr(hex(text), 2 * i - 1, 2) AS BIGINT)) AS b FROM benchmark)
SELECT item_id, CAST(list_reduce(b, lambda c, x: t8[xor(c, x) + 1], 0::BIGINT) AS INTEGER) AS crc8, CAST(list_reduce(b, lambda c, x: xor((c << 8) & 65535, t16[xor(c >> 8, x) + 1]), 0::BIGINT) AS INTEGER) AS crc16,
  CAST(list_reduce(list_transform(b, lambda x: CAST(CASE WHEN x > 127 THEN 18446744073709551360 + x ELSE x END AS HUGEINT)), lambda c, x: (xor(c, x) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS VARCHAR) AS fnv1a64 FROM b, t"""


@query(CHECK_SQL)
def checksums(spark, sf_dir):
    """CRC-8, CRC-16 and FNV-1a of whole texts."""
    b = F.encode("text", "UTF-8")
    return read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", bitstream.crc8_of()(b).alias("crc8"), bitstream.crc16_of()(b).alias("crc16"), bitstream.fnv1a64_of()(b).alias("fnv1a64"))


# --- seeking by container ------------------------------------------------------------------


def _targets(df: DataFrame, values: list[int], stream: int = 0) -> DataFrame:
    """Targets (path, stream, target) of each path."""
    return df.select("path").distinct().select("path", F.lit(stream).alias("stream"), F.explode(F.array(*(F.lit(x).cast("long") for x in values))).alias("target"))


@query(WEBP_SQL + ", t AS (SELECT conv_id, unnest([0, 100, 1000, 10000]) AS target FROM (SELECT DISTINCT conv_id FROM c)) SELECT t.conv_id, target, max(seq) AS start_seq, 0 AS error_code FROM t JOIN c ON c.conv_id = t.conv_id AND pts <= target GROUP BY ALL")
def webp_seek(spark, sf_dir):
    """The last frame of an animation that starts at or before each target."""
    p = demux.packets(_webps(spark, sf_dir))
    return seekfile.webp(p, _targets(p, [0, 100, 1000, 10000])).select(key_of().alias("conv_id"), "target", "start_seq", "error_code")


MP3_TARGETS = [-5, 0, 1000, 20000, 50000]


@query(f"""WITH p AS (SELECT p_partkey, p_size AS n, CAST(trunc((10 + p_size * 417) / 16000.0::DOUBLE * 44100) AS BIGINT) AS duration, unnest({MP3_TARGETS}) AS target FROM part),
b AS (SELECT *, CASE WHEN target > 0 THEN CAST(trunc(target::DOUBLE * 128 * 125 / 44100) AS BIGINT) ELSE 0 END AS byte FROM p),
f AS (SELECT *, greatest(0, (byte - 10 + 416) // 417) AS k FROM b)
SELECT p_partkey, target, CASE WHEN code = 0 THEN k END AS start_seq, CASE WHEN code = 0 THEN 10 + 417 * k END AS pos, CASE WHEN code = 0 THEN CASE WHEN target = 0 THEN 0 ELSE CAST(trunc((10 + 417 * k)::DOUBLE / 16000 * 44100) AS BIGINT) END END AS pts, code AS error_code
FROM (SELECT *, CASE WHEN target < 0 OR (target > 0 AND target >= duration) THEN 1001 WHEN k >= n THEN 3010 ELSE 0 END AS code FROM f)""")
def mp3_seek(spark, sf_dir):
    """MP3 seeking by the bit rate: refused behind the duration, resumed at the next frame, timed by where that lies."""
    asked = F.array(*(F.struct(F.lit(0).alias("stream"), F.lit(x).cast("long").alias("target")) for x in MP3_TARGETS))
    found = seekfile.mp3_files(_mp3s(spark, sf_dir), asked)
    return found.select(F.col("path").cast("long").alias("p_partkey"), "target", "start_seq", "pos", "pts", "error_code")


@query(STEREO_SQL + ", c AS (SELECT track, count(*) AS n FROM s GROUP BY track), t AS (SELECT track, n, unnest([0, 5, 60, 1000]) AS target FROM c) SELECT track, target, CASE WHEN target < n THEN 0 END AS start_seq, CASE WHEN target < n THEN target // 16 * 16 END AS pts, CASE WHEN target < n THEN 0 ELSE 3005 END AS error_code FROM t")
def flac_seek(spark, sf_dir):
    """The FLAC block of 16 samples that holds each target."""
    wav = _stereo(spark, sf_dir)
    files = sinks.mux_flac(demux.packets(wav), demux.tracks(wav), block=16)
    src = demux.sources(files.select("path", F.octet_length("content").cast("long").alias("length"), "content"))
    t = demux.tracks(src)
    found = seekfile.flac(demux.packets(src), t, _targets(t, [0, 5, 60, 1000]))
    return found.select(key_of().alias("track"), "target", F.when(F.col("error_code") == 0, F.col("start_seq") - F.floor(F.col("pts") / 16)).alias("start_seq"), "pts", "error_code")


@query(MOVIE_SQL + ", k AS (SELECT track, min(CAST(trunc(CAST(dts + n % 3 AS DOUBLE) / 1000 * 1e9) AS BIGINT) // 1000000) AS low FROM mt GROUP BY track) SELECT track, target, low AS time, 0 AS error_code FROM k, (VALUES (0), (1)) t(target) UNION ALL SELECT track, -1, low, 1001 FROM k")
def matroska_seek(spark, sf_dir):
    """Matroska seeking by cues: targets before the first cue start there."""
    src = demux.sources(sinks.mux_matroska(*_movie(spark, sf_dir)).select("path", F.octet_length("content").cast("long").alias("length"), "content"))
    cues, clusters = demux.cue_points(src), demux.clusters(src)
    found = seekfile.matroska(cues, clusters, _targets(clusters, [-1, 0, 1]))
    return found.select(key_of().alias("track"), "target", "time", "error_code")


@query("""SELECT kind, conv_id, target, CASE WHEN kind = 'still' OR target = 0 THEN 0 END AS start_seq, CASE WHEN kind = 'still' OR target = 0 THEN 0 ELSE 3010 END AS error_code
FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('ogg'), ('still')) k(kind), (VALUES (0), (960)) t(target)""")
def ogg_and_still_seek(spark, sf_dir):
    t = _targets(read(spark, sf_dir, "conversations", "conv_id").select(F.col("conv_id").cast("string").alias("path")), [0, 960])
    both = seekfile.ogg(t).withColumn("kind", F.lit("ogg")).unionByName(seekfile.still(t).withColumn("kind", F.lit("still")))
    return both.select("kind", key_of().alias("conv_id"), "target", "start_seq", "error_code")


@query(MOVIE_SQL + ", t AS (SELECT DISTINCT track, unnest([0, 500, 100000]) AS target FROM mt), c AS (SELECT track, count(*) AS n FROM mt GROUP BY track) SELECT t.track, target, coalesce(max(CASE WHEN is_keyframe AND dts <= target THEN mt.n END), any_value(c.n)) AS start_seq, 0 AS error_code FROM t JOIN mt USING (track) JOIN c USING (track) GROUP BY t.track, target")
def generic_seek(spark, sf_dir):
    """Back to the last key packet in file order at or before each target, of any stream."""
    p = demux.packets(_movies(spark, sf_dir))
    return seekfile.generic(p, _targets(p, [0, 500, 100000])).select(key_of().alias("track"), "target", "start_seq", "error_code")


# --- decoders from outside -----------------------------------------------------------------------


class Counter:
    """A decoder with state: holds each packet back until the next, and tells how many bytes it has seen."""

    def __init__(self, track: dict) -> None:
        self.seen, self.held = 0, None

    def decode(self, payload: bytes, pts: int):
        out = self.flush()
        self.seen += len(payload)
        self.held = (pts, payload)
        return out

    def flush(self):
        if self.held is None:
            return []
        (pts, payload), self.held = self.held, None
        return [(pts, decode._audio("u8", 8, 8000, 1, [payload], self.seen, False), None)]


@query(MOVIE_SQL + """, e AS (SELECT *, dts + n % 3 AS pts, n // 20 AS epoch FROM mt WHERE stream_index = 1), w AS (SELECT *, sum(length(payload)) OVER (PARTITION BY track, epoch ORDER BY n) AS seen FROM e)
SELECT track, pts, CAST(seen AS BIGINT) AS seen, payload, 0 AS error_code FROM w UNION ALL SELECT track, CASE WHEN true THEN dts + n % 3 END, NULL, NULL, 4001 FROM mt WHERE stream_index = 0""")
def stateful_decode(spark, sf_dir):
    """A decoder from outside for one stream, fresh in each epoch and flushed at its end; a codec whose library isn't there gives error rows."""
    p, t = _movie(spark, sf_dir)
    p = p.withColumn("epoch", F.floor(F.col("seq") / 20))
    f = plugins.decode_streams(p, t, {"pcm_s16le": "reelframe.plans.files:Counter", "vp9": "no_such_library:Decoder"}, "epoch")
    return f.select(key_of().alias("track"), "pts", F.col("audio.nb_samples").alias("seen"), F.decode(F.col("audio.planes")[0], "UTF-8").alias("payload"), "error_code")


@query(f"""WITH d AS {catalog.values_sql("codec_descriptors")}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY reg_order) AS k FROM d WHERE codec IS NOT NULL AND type <> 'none' AND name <> '')
SELECT user_id, r.name, r.reg_order, r.codec FROM (SELECT DISTINCT user_id FROM events) e, r WHERE k = 1 AND type = CASE WHEN user_id % 2 = 0 THEN 'audio' ELSE 'image' END""")
def registry_list(spark, sf_dir):
    """Registered codecs of the media type that each user asks for."""
    d = catalog.dimension(spark, "codec_descriptors")
    kinds = registry.listed(d, "audio").unionByName(registry.listed(d, "image")).select("name", "reg_order", "codec", "type")
    users = read(spark, sf_dir, "events", "user_id").distinct().withColumn("kind", F.when(F.col("user_id") % 2 == 0, "audio").otherwise("image"))
    return users.join(F.broadcast(kinds), F.col("kind") == F.col("type")).select("user_id", "name", "reg_order", "codec")


CONTAINERS = ["wav", "mkv", "mp4", "png", "nut"]


@query(f"""WITH f AS {catalog.values_sql("format_descriptors")}, r AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY reg_order) AS k FROM f),
e AS (SELECT DISTINCT user_id, {CONTAINERS}[CAST(user_id % 5 AS INTEGER) + 1] AS container FROM events)
SELECT user_id, e.container, a.name AS reads, b.name AS writes FROM e LEFT JOIN r a ON a.container = e.container AND a.k = 1 AND a.can_demux LEFT JOIN r b ON b.container = e.container AND b.k = 1 AND b.can_mux""")
def format_lookup(spark, sf_dir):
    """The format that reads, and the one that writes, the container that each user asks for."""
    f = catalog.dimension(spark, "format_descriptors")
    users = read(spark, sf_dir, "events", "user_id").distinct().withColumn("container", F.get(F.array(*map(F.lit, CONTAINERS)), (F.col("user_id") % 5).cast("int")))
    out = registry.format_for(users, f, "container", "can_demux").withColumnRenamed("format", "reads")
    return registry.format_for(out, f, "container", "can_mux").withColumnRenamed("format", "writes")


@query("""SELECT event_id, key, CAST(value AS BIGINT) AS value FROM (SELECT event_id, unnest(['opus.application', 'opus.bitrate', 'opus.complexity', 'opus.fec']) AS key,
  unnest([2048 + event_id % 2, k * 1000, k % 11, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END]) AS value FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""")
def encoder_options(spark, sf_dir):
    """Encoder options out of dictionaries: numbers, numbers as text and flags count; a name that isn't a number and unknown keys don't."""
    e = read(spark, sf_dir, "events", "event_id", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    values = {
        "opus.bitrate": F.concat(F.lit('"'), (F.col("k") * 1000).cast("string"), F.lit('bps"')), "opus.application": (F.col("event_id") % 2 + 2048).cast("string"), "opus.complexity": (F.col("k") % 11).cast("string"),
        "opus.fec": (F.col("event_type") == "click").cast("string"), "opus.signal_type": F.lit('"music"'), "opus.unknown": F.lit("1"),
    }
    m = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.parse_json(v))))
    found = e.select("event_id", m.alias("m")).select("event_id", F.explode(dictionary.options(F.col("m"), catalog.OPTION_KEYS)).alias("o"))
    return found.select("event_id", "o.key", "o.value")
