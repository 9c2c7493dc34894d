"""Packets to frames.

Stateless codecs decode packet by packet where the packets are. A codec with
state across packets would be grouped by stream; those that are decoded here
(PCM, FLAC frames, whole-image packets) have none, so nothing is shuffled but
tracks to their packets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reelframe import schemas
from reelframe.catalog import PIXEL_FORMATS
from reelframe.operators import pictures
from reelframe.operators.jpeg import jpeg
from reelframe.sources.containers import Malformed, flac

# PCM codec to sample format and NumPy type.
PCM = {"pcm_u8": ("u8", "u1"), "pcm_s16le": ("s16", "<i2"), "pcm_s16be": ("s16", ">i2"), "pcm_s32le": ("s32", "<i4"), "pcm_s32be": ("s32", ">i4"), "pcm_f32le": ("f32", "<f4"), "pcm_f64le": ("f64", "<f8"), "pcm_f32be": ("f32", ">f4"), "pcm_f64be": ("f64", ">f8")}
BATCH_BYTES = 4 << 20
BYTES = {name: bpp for name, _, bpp, *_ in PIXEL_FORMATS}


def _audio(fmt: str, bits: int, rate: int, channels: int, planes: list[bytes], n: int, planar: bool) -> dict:
    return {"sample_format": fmt, "bits_per_sample": bits, "sample_rate": rate, "channels": channels, "planar": planar, "nb_samples": n, "planes": planes}


def pcm(codec: str, payload: bytes, rate: int, channels: int) -> dict:
    """Interleaved native-endian samples; a rest shorter than a block is dropped, an empty packet is an error.

    24-bit samples become the top three bytes' worth of 32-bit ones, unshifted, with bits_per_sample 24.
    """
    if not payload or not channels or channels < 0:
        raise Malformed(4005)
    if codec in ("pcm_s24le", "pcm_s24be"):
        n = len(payload) // (3 * channels)
        raw = np.frombuffer(payload, np.uint8, n * channels * 3).reshape(-1, 3).astype(np.int32)
        raw = raw if codec == "pcm_s24le" else raw[:, ::-1]
        x = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        return _audio("s32", 24, rate, channels, [((x ^ 0x800000) - 0x800000).astype("<i4").tobytes()], n, False)
    fmt, kind = PCM[codec]
    kind = np.dtype(kind)
    n = len(payload) // (kind.itemsize * channels)
    x = np.frombuffer(payload, kind, n * channels)
    return _audio(fmt, 8 * kind.itemsize, rate, channels, [x.astype(kind.newbyteorder("<")).tobytes()], n, False)


@lru_cache(maxsize=64)
def _flac_info(header: bytes) -> dict:
    return flac.metadata(header)[0]


def flac_frames(payload: bytes, header: bytes, pts: int):
    """(pts, audio) of each block in a packet: planar 32-bit samples at the file's own depth."""
    info = _flac_info(header)
    found = False
    for _, head, x, _ in flac.frames(payload, 0, info):
        yield pts, _audio("s32", head["bits"], info["rate"], len(x), [c.astype("<i4").tobytes() for c in x], head["size"], True)
        pts, found = pts + head["size"], True
    if not found:
        raise Malformed(4005)


def picture(name: str, x: np.ndarray, key: bool = True) -> dict:
    height, width = x.shape[:2]
    data = np.ascontiguousarray(x).tobytes()
    return {"pixel_format": name, "width": width, "height": height, "is_keyframe": key, "color_space": "bt709", "transfer": "bt709", "planes": [{"data": data, "linesize": width * BYTES[name]}]}


STILL = {"bmp": pictures.bmp, "tga": pictures.tga, "png": pictures.png, "tiff": pictures.tiff, "jpeg": jpeg}


def frames_of(codec: str | None, payload: bytes, pts: int, track: dict):
    """(pts, audio, picture) of each frame of a packet; Malformed(4001) for a codec without a decoder."""
    if codec in PCM or codec in ("pcm_s24le", "pcm_s24be"):
        yield pts, pcm(codec, payload, track["sample_rate"], track["channels"]), None
    elif codec == "flac":
        for at, audio in flac_frames(payload, track["extradata"], pts):
            yield at, audio, None
    elif codec in STILL:
        yield pts, None, picture(*STILL[codec](payload))
    elif codec == "gif":
        for k, canvas in enumerate(pictures.gif(payload)):
            yield pts + k, None, picture("rgba", canvas, k == 0)
    else:
        raise Malformed(4001)


def _bytes(audio: dict | None, pic: dict | None) -> int:
    return sum(map(len, audio["planes"])) if audio else sum(len(p["data"]) for p in pic["planes"]) if pic else 0


def decoded(batches, schema: pa.Schema):
    """Batches of frames, each of about BATCH_BYTES or one frame, of batches of packets with their tracks' columns."""
    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            p = batch.slice(i, 1).to_pylist()[0]
            base = {k: p[k] for k in ("path", "stream_index", "seq", "pts", "dts")}
            try:
                if p["error_code"]:
                    raise Malformed(p["error_code"])
                k = -1
                for k, (pts, audio, pic) in enumerate(frames_of(p["codec"], bytes(p["payload"] or b""), p["pts"], p)):
                    rows.append(base | {"sub_seq": k, "pts": pts, "audio": audio, "picture": pic, "error_code": 0})
                    held += _bytes(audio, pic)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if k < 0:  # a picture file without a picture
                    raise Malformed(4005)
            except Malformed as e:
                rows.append(base | {"sub_seq": 0, "audio": None, "picture": None, "error_code": e.code})
            except Exception:  # whatever a broken packet does to its decoder, the other packets go on
                rows.append(base | {"sub_seq": 0, "audio": None, "picture": None, "error_code": 4005})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def decode(packets: DataFrame, tracks: DataFrame) -> DataFrame:
    """The frames of packets, by their tracks' codecs. A packet that fails gives a row with error_code and nothing else."""
    schema = to_arrow_schema(schemas.struct(schemas.FRAMES))

    def run(batches):
        yield from decoded(batches, schema)

    t = tracks.select(F.col("path").alias("t_path"), F.col("index").alias("t_index"), "codec", "extradata", F.col("audio.sample_rate").alias("sample_rate"), F.col("audio.channels").alias("channels"))
    own = packets.join(t, (F.col("path") == F.col("t_path")) & (F.col("stream_index") == F.col("t_index")), "left").drop("t_path", "t_index", "flags", "pos")
    return own.mapInArrow(run, schemas.struct(schemas.FRAMES))
