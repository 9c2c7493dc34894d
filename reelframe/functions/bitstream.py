"""Byte kernels that have no built-in expression: Arrow functions over BINARY columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

START = b"\0\0\0\1"


def table(width: int, polynomial: int) -> np.ndarray:
    """The 256 entries of a CRC of this width, most significant bit first."""
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ polynomial, out << 1) & ((1 << width) - 1)
    return out


# The polynomials of FLAC.
CRC8, CRC16 = table(8, 0x07), table(16, 0x8005)
_CRC8, _CRC16 = CRC8.tolist(), CRC16.tolist()


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b]
    return crc


def fnv1a64(data: bytes, signed: bool = True) -> int:
    """FNV-1a; where char is signed, bytes from 0x80 on enter with their sign extended."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ (b | 0xFFFFFFFFFFFFFF00 if signed and b > 127 else b)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def utf8_number(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(value, next position) of an extended UTF-8 number of 1 to 7 bytes; None if malformed or cut short.

    A lead byte 0xFE has six more bytes and adds no bits of its own.
    """
    if at >= len(data):
        return None
    lead = data[at]
    extra = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if lead == 0xFF or (lead >= 0x80 and extra < 1):
        return None
    if at + 1 + extra > len(data):
        return None
    value = lead if not extra else lead & ((1 << max(0, 6 - extra)) - 1)
    for k in range(extra):
        value = value << 6 | data[at + 1 + k] & 0x3F
    return value, at + 1 + extra


def nal_units(sample: bytes, length_bytes: int, stop_at_zero: bool = False):
    """Units of a length-prefixed sample; empty ones are skipped (or end it), an overrun ends it."""
    at = 0
    while at + length_bytes <= len(sample):
        n = int.from_bytes(sample[at : at + length_bytes], "big")
        at += length_bytes
        if not n:
            if stop_at_zero:
                return
            continue
        if at + n > len(sample):
            return
        yield sample[at : at + n]
        at += n


def to_annexb(sample: bytes, length_bytes: int, parameter_sets: bytes = b"", keyframe: bool = False) -> bytes:
    return (parameter_sets if keyframe else b"") + b"".join(START + u for u in nal_units(sample, length_bytes))


def vvc_to_annexb(sample: bytes) -> bytes:
    """4-byte lengths; a sample that already has start codes stays as it is."""
    if sample[:4] == START or sample[:3] == START[1:]:
        return sample
    return b"".join(START + u for u in nal_units(sample, 4, stop_at_zero=True))


def avc_parameter_sets(config: bytes) -> tuple[int, bytes] | None:
    """(length bytes, Annex B parameter sets) of an AVC configuration record."""
    if len(config) < 7:
        return None
    out, at, n = [], 6, config[5] & 31
    for group in range(2):
        for _ in range(n):
            if at + 2 > len(config):
                return None
            size = int.from_bytes(config[at : at + 2], "big")
            out.append(START + config[at + 2 : at + 2 + size])
            at += 2 + size
        if group == 0:
            if at >= len(config):
                break
            n, at = config[at], at + 1
    return (config[4] & 3) + 1, b"".join(out)


def hevc_parameter_sets(config: bytes) -> tuple[int, bytes] | None:
    """(length bytes, Annex B parameter sets) of an HEVC configuration record."""
    if len(config) < 23:
        return None
    out, at = [], 23
    for _ in range(config[22]):
        if at + 3 > len(config):
            return None
        n, at = int.from_bytes(config[at + 1 : at + 3], "big"), at + 3
        for _ in range(n):
            if at + 2 > len(config):
                return None
            size = int.from_bytes(config[at : at + 2], "big")
            out.append(START + config[at + 2 : at + 2 + size])
            at += 2 + size
    return (config[21] & 3) + 1, b"".join(out)


def vvc_parameter_sets(config: bytes) -> tuple[int, bytes] | None:
    """(length bytes, Annex B parameter sets) of a VVC configuration record.

    Its profile, tier and level part, if present, has a constraint field and
    sub-layer levels of variable length before the sub-profiles.
    """
    try:
        length, at = (config[0] >> 1 & 3) + 1, 1
        if config[0] & 1:
            sublayers, at = config[2] >> 4 & 7, 4
            at += 1 + 2 + (config[at] & 63)
            if sublayers > 1:
                at += 1 + bin(config[at] >> (9 - sublayers)).count("1")
            at += 1 + 4 * config[at] + 6
        out, arrays, at = [], config[at], at + 1
        for _ in range(arrays):
            kind, n, at = config[at] & 31, 1, at + 1
            if kind not in (12, 13):  # those two stand alone, without a count
                n, at = int.from_bytes(config[at : at + 2], "big"), at + 2
            for _ in range(n):
                size = config[at] << 8 | config[at + 1]
                if size:
                    out.append(START + config[at + 2 : at + 2 + size])
                at += 2 + size
    except IndexError:
        return None
    return (length, b"".join(out)) if out else None


def descriptor(tag: int, body: bytes) -> bytes:
    """An MPEG-4 descriptor; the size has four bytes of seven bits."""
    n = len(body)
    return bytes([tag, n >> 21 & 127 | 128, n >> 14 & 127 | 128, n >> 7 & 127 | 128, n & 127]) + body


def aac_cookie(config: bytes) -> bytes:
    """An ES descriptor around an AudioSpecificConfig."""
    decoder = descriptor(4, bytes([0x40, 0x15]) + bytes(11) + descriptor(5, config))
    return descriptor(3, bytes(3) + decoder + descriptor(6, b"\2"))


def opus_head(channels: int, pre_skip: int = 0, gain: int = 0) -> bytes:
    """The 19-byte identification header; its rate is always 48000."""
    return b"OpusHead" + bytes([1, channels]) + pre_skip.to_bytes(2, "little") + (48000).to_bytes(4, "little") + gain.to_bytes(2, "little", signed=True) + b"\0"


def _over(kernel, kind: pa.DataType, ddl: str):
    @F.arrow_udf(ddl)
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if v is None else kernel(v) for v in data.to_pylist()], kind)

    return run


def crc8_of():
    return _over(crc8, pa.int32(), "int")


def crc16_of():
    return _over(crc16, pa.int32(), "int")


def fnv1a64_of():
    """As text, since the number is unsigned."""
    return _over(lambda v: str(fnv1a64(v)), pa.string(), "string")


def annexb_of(length_bytes: int, parameter_sets: bytes = b""):
    """An Arrow function (sample, is_keyframe) -> sample with start codes."""

    @F.arrow_udf("binary")
    def run(data: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array([None if v is None else to_annexb(v, length_bytes, parameter_sets, bool(k)) for v, k in zip(data.to_pylist(), key.to_pylist(), strict=True)], pa.binary())

    return run
