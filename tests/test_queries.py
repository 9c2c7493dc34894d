"""Every media query against its SQL on the small tables, and rules that have no query."""

import duckdb
import pytest
from pyspark.sql import functions as F

from reelframe.functions import bitstream, detect, dictionary, timebase
from reelframe.operators import errors, sampletable, seek
from reelframe.plans import files, queries  # noqa: F401 - files registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield c


def cell(v):
    return "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_check_values():
    assert bitstream.crc8(b"123456789") == 0xF4
    assert bitstream.crc16(b"123456789") == 0xFEE8
    assert bitstream.fnv1a64(b"a") == 0xAF63DC4C8601EC8C and bitstream.fnv1a64(b"\xe9", signed=False) != bitstream.fnv1a64(b"\xe9")
    for v in (0, 127, 128, 2047, 65535, 1 << 30, (1 << 36) - 1):
        n = 1 if v < 128 else next(k for k in range(2, 8) if v < 1 << (5 * k + 1 if k < 7 else 36))
        lead = v if n == 1 else (0xFF << (8 - n) & 0xFF) | (v >> 6 * (n - 1))
        data = bytes([lead & 255, *((v >> 6 * k & 63) | 128 for k in reversed(range(n - 1)))])
        assert bitstream.utf8_number(data) == (v, n)
    assert bitstream.utf8_number(b"\xff") is None and bitstream.utf8_number(b"\xc3") is None


def test_length_prefixed_units():
    s = b"\0\0\0\2ab\0\0\0\0\0\0\0\1c\0\0\0\x09x"
    assert bitstream.to_annexb(s, 4, b"P", True) == b"P\0\0\0\1ab\0\0\0\1c"
    assert bitstream.to_annexb(b"\2ab\1c", 1) == b"\0\0\0\1ab\0\0\0\1c" and bitstream.to_annexb(b"\0\2ab", 2) == b"\0\0\0\1ab"
    assert bitstream.vvc_to_annexb(s) == b"\0\0\0\1ab" and bitstream.vvc_to_annexb(b"\0\0\1x") == b"\0\0\1x"
    config = bytes(21) + bytes([0xFF, 1, 0x20, 0, 1, 0, 2]) + b"VP"
    assert bitstream.hevc_parameter_sets(config) == (4, b"\0\0\0\1VP")
    vvc = bytes([0xF8 | 3 << 1 | 1, 0, 0x20, 0]) + bytes([2, 1 << 1, 51, 9, 9, 0x80, 40, 1]) + bytes(4) + bytes(6) + bytes([2, 13, 0, 1, 7, 15, 0, 1, 0, 2]) + b"SP"
    assert bitstream.vvc_parameter_sets(vvc) == (4, b"\0\0\0\1\7\0\0\0\1SP") and bitstream.vvc_parameter_sets(b"\1") is None
    assert len(bitstream.opus_head(2)) == 19 and bitstream.aac_cookie(b"\x12\x10").endswith(b"\2")


def test_arrow_kernels_pass_nulls(spark):
    df = spark.createDataFrame([(b"\0\2ab", True), (None, False)], "b binary, k boolean")
    rows = df.select(bitstream.annexb_of(2, b"P")("b", "k").alias("x"), bitstream.crc8_of()("b").alias("c")).collect()
    assert {(r.x if r.x is None else bytes(r.x), r.c is None) for r in rows} == {(b"P\0\0\0\1ab", False), (None, True)}


def test_detection_quirks_and_plugged_rules(spark):
    df = spark.createDataFrame([(bytes.fromhex("FFFB9064"),), (b"MINE....",), (b"abc",)], "b binary")
    got = [(r.x.container, r.y.container, r.z.container) for r in detect.with_format(detect.with_format(detect.with_format(df, "b", "x", True), "b", "y"), "b", "z", rules=[(detect.starts("4D494E45"), "mine", None), *detect.standard_rules()]).collect()]
    assert got == [(None, "mp3", "mp3"), (None, None, "mine"), (None, None, None)]


def test_dictionary_updates(spark):
    m = F.create_map(F.lit("a"), F.parse_json(F.lit("1")), F.lit("b"), F.parse_json(F.lit('"12abc"')))
    put = dictionary.put(m, "a", F.parse_json(F.lit("2.5")))
    row = spark.range(1).select(
        dictionary.get_int(put, "a", 0).alias("a"), dictionary.get_int(m, "b", 0).alias("b"), dictionary.contains(dictionary.remove(m, "a"), "a").alias("gone"),
        dictionary.contains(dictionary.index_or_insert(m, "n"), "n").alias("made"), dictionary.entries(put).alias("e"),
    ).first()
    assert (row.a, row.b, row.gone, row.made) == (2, 12, False, True) and [(x.key, x.value) for x in row.e] == [("a", "2.500000"), ("b", "12abc")]


def test_result_combinators(spark):
    df = spark.createDataFrame([(4, None), (5, 0), (6, 3003)], "v int, c int")
    v, c = errors.and_then(F.col("v"), F.col("c"), lambda x: (x * 2, F.when(x == 5, 1001)))
    got = [tuple(r) for r in df.select(v, c, errors.map_value(F.col("v"), F.col("c"), lambda x: x + 1), errors.map_error(F.col("c"), lambda x: x + 1)).collect()]
    assert got == [(8, None, 5, None), (10, 1001, 6, 0), (None, 3003, None, 3004)]


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    df = queries.packets(spark, SF).select("track", "n", "size")
    a = sorted(map(tuple, sampletable.interleave(df, [], "track", "n", "size").collect()))
    b = sorted(map(tuple, sampletable.interleave(df.orderBy(F.rand(3)).repartition(7), [], "track", "n", "size").collect()))
    assert a == b


def test_incomplete_tables_and_seek_edges(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "track long"), spark.createDataFrame([(1,), (3,)], "track long")
    assert {r.track for r in sampletable.incomplete({"a": a, "b": b}, "track").collect()} == {2, 3}
    p = spark.createDataFrame([(1, 0, 5, True), (1, 1, 3, True), (1, 2, 9, False)], "track long, n long, dts long, is_keyframe boolean")
    t = spark.createDataFrame([(1, 6, "previous"), (1, 100, "next"), (1, 4, "closest"), (2, 0, "previous")], "track long, target long, mode string")
    got = {(r.track, r.mode): r.start_n for r in seek.seek(p, t, "track").collect()}
    assert got == {(1, "previous"): 1, (1, "next"): 3, (1, "closest"): 0, (2, "previous"): 0}
    q = seek.seek(p, t.limit(1), "track", compat_skip_first=F.col("track") == 1).first()
    assert q.start_n == 3


def test_rationals(spark):
    df = spark.createDataFrame([((1, 2), (2, 4)), ((1, 2), (1, 2))], "a struct<num:int,den:int>, b struct<num:int,den:int>")
    assert [r[0] for r in df.select(timebase.same_rational(F.col("a"), F.col("b"))).collect()] == [False, True]
