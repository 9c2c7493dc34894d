"""Matroska and WebM: an EBML walker, tracks, blocks with all four lacings, cues; and a writer."""

from __future__ import annotations

import struct

from reelframe.catalog import MATROSKA_CODECS
from reelframe.sources.containers import Malformed, base, packet, track

CODECS = dict(MATROSKA_CODECS)
# Element ids.
EBML, SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE
NUMBER, UID, TYPE, CODEC, PRIVATE, VIDEO, WIDTH, HEIGHT, FRAME_RATE, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x63A2, 0xE0, 0xB0, 0xBA, 0x2383E3, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE, CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, ENTRY, VIDEO, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}


def vint(b: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next position) of a variable-length number; None for the unknown size."""
    if at >= len(b) or not b[at]:
        raise Malformed(3010)
    n = 9 - b[at].bit_length()
    value = int.from_bytes(b[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(b: bytes, at: int, end: int):
    """(id, begin, end) of the elements in a range; one of unknown size lasts to its end."""
    while at < end:
        name, at = vint(b, at, keep_marker=True)
        size, at = vint(b, at)
        stop = end if size is None else min(at + size, end)
        yield name, at, stop
        at = stop


def tree(b: bytes, at: int, end: int) -> dict[int, list]:
    """Children by id: nested for parents, byte ranges for the rest."""
    out: dict[int, list] = {}
    for name, x, y in elements(b, at, end):
        out.setdefault(name, []).append(tree(b, x, y) if name in PARENTS else (x, y))
    return out


def _uint(b: bytes, node: dict, name: int, default: int = 0) -> int:
    return int.from_bytes(b[slice(*node[name][0])], "big") if name in node else default


def _float(b: bytes, node: dict, name: int, default: float = 0.0) -> float:
    if name not in node:
        return default
    raw = b[slice(*node[name][0])]
    return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if len(raw) in (4, 8) else default


def laces(b: bytes, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """Ranges of the frames of a block: no lacing, Xiph, fixed or EBML."""
    if mode == 0:
        return [(at, end)]
    n, at = b[at] + 1, at + 1
    if mode == 2:
        size = (end - at) // n
        return [(at + k * size, at + (k + 1) * size) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if mode == 1:
            size = 0
            while True:
                size, at, more = size + b[at], at + 1, b[at] == 255
                if not more:
                    break
        else:
            width = 9 - b[at].bit_length()
            size, at = vint(b, at)
            if k:
                size = sizes[-1] + size - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    out = []
    for size in [*sizes, None]:
        stop = end if size is None else at + size
        out.append((at, stop))
        at = stop
    return out


def matroska(b: bytes):
    top = list(elements(b, 0, len(b)))
    if not top or top[0][0] != EBML:
        raise Malformed(3003)
    segment = next(((x, y) for name, x, y in top if name == SEGMENT), None)
    if segment is None:
        raise Malformed(3010)
    scale, duration, index, clusters = 1_000_000, -1, {}, []
    tracks: list[dict] = []
    for name, x, y in elements(b, *segment):
        if name == INFO:
            info = tree(b, x, y)
            scale = _uint(b, info, SCALE, scale) or scale
            duration = int(_float(b, info, DURATION, -1))
        elif name == TRACKS:
            tracks = tree(b, x, y).get(ENTRY, [])
        elif name == CLUSTER:
            clusters.append((x, y))
    if not tracks:
        raise Malformed(3006)
    for t in tracks:
        kind = {1: "video", 2: "audio"}.get(_uint(b, t, TYPE))
        if kind is None:
            continue
        number = _uint(b, t, NUMBER)
        index[number] = len(index)
        v, a = t.get(VIDEO, [{}])[0], t.get(AUDIO, [{}])[0]
        fps = _float(b, v, FRAME_RATE)
        shape = (
            {"video": {"width": _uint(b, v, WIDTH), "height": _uint(b, v, HEIGHT), "framerate": base(int(fps * 1000 + 0.5), 1000) if fps > 0 else base(0, 1)}}
            if kind == "video"
            else {"audio": {"sample_rate": int(_float(b, a, RATE, 8000.0)), "channels": _uint(b, a, CHANNELS, 1), "bit_depth": _uint(b, a, DEPTH)}}
        )
        codec = CODECS.get(b[slice(*t[CODEC][0])].decode("ascii", "replace").rstrip("\0") if CODEC in t else "")
        private = b[slice(*t[PRIVATE][0])] if PRIVATE in t else None
        yield track(index[number], kind, codec, id=number, extradata=private, time_base=base(scale, 1_000_000_000), duration=duration, **shape)
    seq = 0
    for x, y in clusters:
        time = 0
        for name, p, q in elements(b, x, y):
            if name == TIME:
                time = int.from_bytes(b[p:q], "big")
            elif name in (SIMPLE, GROUP):
                group = tree(b, p, q) if name == GROUP else {}
                if name == GROUP and BLOCK not in group:
                    continue
                at, end = group[BLOCK][0] if name == GROUP else (p, q)
                number, at = vint(b, at)
                if number not in index:
                    continue
                pts = time + int.from_bytes(b[at : at + 2], "big", signed=True)
                flags = b[at + 2]
                key = bool(flags & 128) if name == SIMPLE else REFERENCE not in group
                for u, w in laces(b, at + 3, end, flags >> 1 & 3):
                    yield packet(seq, u, b[u:w], stream_index=index[number], pts=pts, dts=pts, duration=_uint(b, group, BLOCK_DURATION), is_keyframe=key)
                    seq += 1


def cues(b: bytes) -> list[tuple[int, int, int]]:
    """(time, track, cluster position in the segment) of each cue point."""
    out = []
    for name, x, y in elements(b, 0, len(b)):
        if name == SEGMENT:
            for child, p, q in elements(b, x, y):
                if child == CUES:
                    for point in tree(b, p, q).get(POINT, []):
                        for at in point.get(POSITIONS, []):
                            out.append((_uint(b, point, CUE_TIME), _uint(b, at, CUE_TRACK), _uint(b, at, CUE_CLUSTER)))
    return out


def clusters(b: bytes) -> list[tuple[int, int]]:
    """(time, position in the segment) of each cluster."""
    out = []
    for name, x, y in elements(b, 0, len(b)):
        if name == SEGMENT:
            at = x
            for child, p, q in elements(b, x, y):
                if child == CLUSTER:
                    out.append((next((int.from_bytes(b[u:v], "big") for k, u, v in elements(b, p, q) if k == TIME), 0), at - x))
                at = q
    return out


def element(name: int, body: bytes) -> bytes:
    head = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return head + (1 << 56 | len(body)).to_bytes(8, "big") + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


# Codec ids that writing uses beside those that reading knows.
WRITTEN = {c: i for i, c in reversed(MATROSKA_CODECS)} | {"pcm_u8": "A_PCM/INT/LIT", "pcm_s24le": "A_PCM/INT/LIT", "pcm_s32le": "A_PCM/INT/LIT", "pcm_f64le": "A_PCM/FLOAT/IEEE", "pcm_s32be": "A_PCM/INT/BIG"}


def write(tracks: list[dict], packets: list[tuple[int, int, bool, bytes]], scale: int = 1_000_000, cluster_ticks: int = 5000) -> bytes:
    """A Matroska file of tracks and packets (track index, nanoseconds, keyframe, payload), in order of time, with cues.

    Tracks other than audio and video can't be written and raise Malformed(1001);
    a packet of an undeclared track raises Malformed(3007).
    """
    entries = []
    for k, t in enumerate(tracks):
        if t["type"] not in ("audio", "video") or t["codec"] not in WRITTEN:
            raise Malformed(1001)
        body = number(NUMBER, k + 1) + number(UID, k + 1) + number(TYPE, 1 if t["type"] == "video" else 2) + element(CODEC, WRITTEN[t["codec"]].encode())
        if t.get("extradata"):
            body += element(PRIVATE, bytes(t["extradata"]))
        if t["type"] == "video":
            body += element(VIDEO, number(WIDTH, t["video"]["width"]) + number(HEIGHT, t["video"]["height"]))
        else:
            a = t["audio"]
            body += element(AUDIO, element(RATE, struct.pack(">d", float(a["sample_rate"]))) + number(CHANNELS, a["channels"]) + (number(DEPTH, a["bit_depth"]) if a.get("bit_depth") else b""))
        entries.append(element(ENTRY, body))
    ticks = [max(0, ns) // scale for _, ns, _, _ in packets]
    info = element(INFO, number(SCALE, scale) + element(DURATION, struct.pack(">d", float(max(ticks, default=0)))))
    body, points, cluster, start = info + element(TRACKS, b"".join(entries)), [], b"", None

    def close(body: bytes, cluster: bytes) -> bytes:
        return body + element(CLUSTER, cluster) if cluster else body

    for (stream, _, key, payload), tick in zip(packets, ticks, strict=True):
        if not 0 <= stream < len(tracks):
            raise Malformed(3007)
        if start is None or not 0 <= tick - start < min(cluster_ticks, 32768):
            body = close(body, cluster)
            start, cluster = tick, number(TIME, tick)
            points.append(element(POINT, number(CUE_TIME, tick) + element(POSITIONS, number(CUE_TRACK, stream + 1) + number(CUE_CLUSTER, len(body)))))
        cluster += element(SIMPLE, (128 | stream + 1).to_bytes(1, "big") + (tick - start).to_bytes(2, "big") + bytes([128 if key else 0]) + payload)
    body = close(body, cluster) + element(CUES, b"".join(points))
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return head + element(SEGMENT, body)
