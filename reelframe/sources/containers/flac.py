"""FLAC: metadata, frame headers, and a lossless decoder of sub-frames.

A frame's end is found by decoding it, and its two checksums decide whether it
is one; after a failure the scan goes on at the next sync code.
"""

from __future__ import annotations

import numpy as np

from reelframe.functions.bitstream import crc8, crc16, utf8_number
from reelframe.sources.containers import Malformed, base, big, packet, track

# Sample rates and sizes in bits that frame header codes stand for.
RATES = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
DEPTHS = [0, 8, 12, 0, 16, 20, 24, 32]
# Coefficients of the fixed predictors.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class Bits:
    """Reads a byte string most significant bit first."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.value, self.left = data, at, 0, 0

    def _load(self) -> None:
        part = self.data[self.at : self.at + 8]
        if not part:
            raise Malformed(3010)
        self.value = self.value << 8 * len(part) | int.from_bytes(part, "big")
        self.left += 8 * len(part)
        self.at += len(part)

    def read(self, n: int) -> int:
        while self.left < n:
            self._load()
        self.left -= n
        out = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return out

    def signed(self, n: int) -> int:
        v = self.read(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        zeros = 0
        while True:
            if self.value:
                run = self.left - self.value.bit_length()
                self.left -= run + 1
                self.value &= (1 << self.left) - 1
                return zeros + run
            zeros += self.left
            self.left = 0
            self._load()

    def byte_position(self) -> int:
        """Where the next whole byte begins."""
        return self.at - self.left // 8


def metadata(b: bytes) -> tuple[dict, int]:
    """Stream info, seek points, comments and cover, and where the frames begin."""
    if b[:4] != b"fLaC":
        raise Malformed(3003)
    info: dict = {"seek_points": [], "comments": {}, "cover": None}
    at, last = 4, False
    while not last:
        kind, size = big(b, at, 1), big(b, at + 1, 3)
        last, kind, at = bool(kind & 128), kind & 127, at + 4
        body = b[at : at + size]
        if kind == 0 and size >= 34:
            x = int.from_bytes(body[10:18], "big")
            info |= {"min_block": big(body, 0, 2), "max_block": big(body, 2, 2), "rate": x >> 44, "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "total": x & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            info["seek_points"] = [(big(body, k, 8), big(body, k + 8, 8), big(body, k + 16, 2)) for k in range(0, size // 18 * 18, 18) if body[k : k + 8] != b"\xff" * 8]
        elif kind == 4:
            info["comments"] = _comments(body)
        elif kind == 6 and size >= 4 and big(body, 0, 4) == 3:
            info["cover"] = body
        at += size
    if "rate" not in info:
        raise Malformed(3003)
    return info, at


def _comments(body: bytes) -> dict[str, str]:
    number = lambda at: int.from_bytes(body[at : at + 4], "little")
    at, out = 4 + number(0), {}
    n, at = number(at), at + 4
    for _ in range(n):
        size = number(at)
        name, _, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        out[name.lower()] = value
        at += 4 + size
    return out


def frame_header(b: bytes, at: int, info: dict) -> dict | None:
    """Block size, channel assignment, depth and body position of a frame header; None if it isn't one."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    size_code, rate_code, channels, depth_code = b[at + 2] >> 4, b[at + 2] & 15, b[at + 3] >> 4, b[at + 3] >> 1 & 7
    number = utf8_number(b, at + 4)
    if number is None or rate_code == 15 or channels > 10 or depth_code == 3 or b[at + 3] & 1:
        return None
    end = number[1]
    tail = {6: 1, 7: 2}.get(size_code, 0)
    if size_code == 0:
        size = info["min_block"]
    elif tail:
        size = int.from_bytes(b[end : end + tail], "big") + 1
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    end += tail + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if end >= len(b) or crc8(b[at:end]) != b[end]:
        return None
    return {"size": size, "channels": channels, "bits": DEPTHS[depth_code] or info["bits"], "number": number[0], "variable": b[at + 1] & 1, "body": end + 1}


def _residual(r: Bits, n: int, order: int) -> list[int]:
    method = r.read(2)
    if method > 1:
        raise Malformed(3010)
    width, escape = (4, 15) if method == 0 else (5, 31)
    parts = 1 << r.read(4)
    out: list[int] = []
    for k in range(parts):
        count = n // parts - (order if k == 0 else 0)
        rice = r.read(width)
        if rice == escape:
            raw = r.read(5)
            out += [r.signed(raw) for _ in range(count)]
        else:
            for _ in range(count):
                v = r.unary() << rice | r.read(rice)
                out.append(v >> 1 ^ -(v & 1))
    return out


def _predicted(warm: list[int], residual: list[int], weights: list[int], shift: int) -> list[int]:
    out = list(warm)
    order = len(weights)
    for e in residual:
        out.append(e + (sum(w * out[-1 - k] for k, w in enumerate(weights)) >> shift))
    return out if order else residual


def _subframe(r: Bits, n: int, bits: int) -> np.ndarray:
    if r.read(1):
        raise Malformed(3010)
    kind = r.read(6)
    wasted = r.unary() + 1 if r.read(1) else 0
    bits -= wasted
    if kind == 0:
        out = [r.signed(bits)] * n
    elif kind == 1:
        out = [r.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12:
        warm = [r.signed(bits) for _ in range(kind - 8)]
        out = _predicted(warm, _residual(r, n, kind - 8), FIXED[kind - 8], 0)
    elif kind >= 32:
        order = kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        precision, shift = r.read(4) + 1, r.signed(5)
        if precision == 16 or shift < 0:
            raise Malformed(3010)
        weights = [r.signed(precision) for _ in range(order)]
        out = _predicted(warm, _residual(r, n, order), weights, shift)
    else:
        raise Malformed(3010)
    return np.array(out, np.int64) << wasted


def frame(b: bytes, at: int, info: dict) -> tuple[dict, np.ndarray, int] | None:
    """(header, samples [channel, n], end) of a frame whose checksums hold, else None."""
    head = frame_header(b, at, info)
    if head is None:
        return None
    r, mode = Bits(b, head["body"]), head["channels"]
    try:
        side = {8: 1, 9: 0, 10: 1}.get(mode, -1)
        x = np.stack([_subframe(r, head["size"], head["bits"] + (k == side)) for k in range(mode + 1 if mode < 8 else 2)])
    except Malformed:
        return None
    end = r.byte_position()
    if end + 2 > len(b) or crc16(b[at:end]) != int.from_bytes(b[end : end + 2], "big"):
        return None
    if mode == 8:
        x[1] = x[0] - x[1]
    elif mode == 9:
        x[0] = x[0] + x[1]
    elif mode == 10:
        mid = x[0] << 1 | x[1] & 1
        x[0], x[1] = mid + x[1] >> 1, mid - x[1] >> 1
    return head, x, end + 2


def frames(b: bytes, at: int, info: dict):
    """(position, header, samples, end) of each frame."""
    while at + 6 <= len(b):
        found = frame(b, at, info)
        if found is None:
            at = b.find(b"\xff", at + 1)
            if at < 0:
                return
            continue
        yield at, *found
        at = found[2]


def flac(b: bytes):
    info, at = metadata(b)
    yield track(
        0, "audio", "flac", audio={"sample_rate": info["rate"], "channels": info["channels"], "bit_depth": info["bits"]}, extradata=b[:at],
        time_base=base(1, info["rate"] or 1), duration=info["total"], nb_frames=info["total"], metadata=info["comments"],
    )
    if info["cover"] is not None:
        yield track(1, "image", None, disposition=1 << 13, extradata=info["cover"])
    pts = 0
    for seq, (begin, head, _, end) in enumerate(frames(b, at, info)):
        yield packet(seq, begin, b[begin:end], pts=pts, dts=pts, duration=head["size"])
        pts += head["size"]


def write(samples: np.ndarray, rate: int, bits: int, block: int = 4096) -> bytes:
    """A FLAC file of samples [channel, time] of 8, 16 or 24 bits, in constant or verbatim sub-frames."""
    channels, total = samples.shape
    code = {8: 1, 16: 4, 24: 6}.get(bits)
    if code is None or not 1 <= channels <= 8 or not total:
        raise Malformed(1001)
    info = (block if total > block else max(16, total)).to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = [b"fLaC\x80" + len(info).to_bytes(3, "big") + info]
    for k, at in enumerate(range(0, total, block)):
        part = samples[:, at : at + block]
        head = b"\xff\xf8" + bytes([0x70, channels - 1 << 4 | code << 1]) + chr(k).encode("utf-8", "surrogatepass") + (part.shape[1] - 1).to_bytes(2, "big")
        body = head + bytes([crc8(head)])
        for x in part:
            raw = (x[:1] if (x == x[0]).all() else x).astype(">i4").view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :].tobytes()
            body += bytes([0 if (x == x[0]).all() else 2]) + raw
        out.append(body + crc16(body).to_bytes(2, "big"))
    return b"".join(out)
