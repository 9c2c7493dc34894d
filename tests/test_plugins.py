"""Decoders from outside: state, epochs, flush, errors."""

from reelframe import schemas
from reelframe.operators import plugins


class Doubler:
    """Gives the previous packet twice; breaks on an empty one."""

    def __init__(self, track):
        assert track["codec"] == "x"
        self.held = None

    def decode(self, payload, pts):
        if not payload:
            raise RuntimeError("empty")
        out, self.held = self.flush(), (pts, payload)
        return out

    def flush(self):
        held, self.held = self.held, None
        return [(held[0], {"sample_format": "u8", "nb_samples": len(held[1]), "planes": [held[1]]}, None)] * 2 if held else []


def tables(spark):
    tracks = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "path string, index int, codec string")
    tracks = tracks.selectExpr("*", *(f"cast(null as {t}) {c}" for c, t in [("extradata", "binary"), ("audio", "struct<sample_rate:long,channels:long>"), ("video", "struct<width:long,height:long>")]))
    rows = [("a", k, 0, 10 * k, 10 * k, b"ab" if k != 2 else b"", 0, k // 3) for k in range(5)] + [("a", 9, 1, 0, 0, b"z", 0, 0), ("a", 10, 0, 99, 99, b"q", 3004, 1)]
    return spark.createDataFrame(rows, "path string, seq long, stream_index int, pts long, dts long, payload binary, error_code int, epoch int").repartition(3), tracks


def test_state_epochs_and_errors(spark):
    packets, tracks = tables(spark)
    f = plugins.decode_streams(packets, tracks, {"x": Doubler, "y": "no_such_module:Thing"}, "epoch")
    assert f.schema == schemas.struct(schemas.FRAMES)
    got = sorted((r.stream_index, r.seq, r.sub_seq, r.pts, r.error_code) for r in f.collect())
    assert got == [(0, 1, 0, 0, 0), (0, 1, 1, 0, 0), (0, 2, 0, 10, 0), (0, 2, 0, 20, 4005), (0, 2, 1, 10, 0), (0, 4, 0, 30, 0), (0, 4, 1, 30, 0), (0, 10, 0, 40, 0), (0, 10, 0, 99, 3004), (0, 10, 1, 40, 0), (1, 9, 0, 0, 4001)]


def test_what_is_available():
    assert plugins.available({"a": "json:loads", "b": "json:no", "c": "no_such_module:x", "d": "", "e": Doubler}) == ["a", "e"]
