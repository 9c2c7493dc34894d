"""ISO base media files (MP4, MOV, M4A): boxes, sample tables, sample entries and codec configurations."""

from __future__ import annotations

import numpy as np

from reelframe.catalog import SAMPLE_ENTRIES
from reelframe.functions.bitstream import avc_parameter_sets, hevc_parameter_sets, opus_head, to_annexb, vvc_parameter_sets
from reelframe.sources.containers import Malformed, base, big, packet, track

CODECS = dict(SAMPLE_ENTRIES)
MAX_DEPTH = 64
# Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"ilst", b"meta"}
# Sampling rates and channel counts of AudioSpecificConfig, by index.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
AAC_CHANNELS = [0, 1, 2, 3, 4, 5, 6, 8]
# Colour codes to colour space and transfer.
SPACES = {1: "bt709", 5: "bt601", 6: "bt601", 9: "bt2020"}
TRANSFERS = {1: "bt709", 6: "bt601", 13: "iec61966_2_1", 16: "smpte2084", 18: "arib_std_b67"}


def boxes(b: bytes, at: int = 0, end: int | None = None, depth: int = 0):
    """(depth, type, begin of the body, end) of each box, containers before what they hold.

    Size 1 is followed by a 64-bit size, size 0 lasts to the end; a smaller size
    than the header's, and boxes nested deeper than MAX_DEPTH, are malformed.
    """
    rest = [(at, len(b) if end is None else end)]  # what is left of each box that is open
    while rest:
        at, end = rest.pop()
        if at + 8 > end:
            continue
        size, kind, head = big(b, at, 4), b[at + 4 : at + 8], 8
        if size == 1:
            size, head = big(b, at + 8, 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            raise Malformed(3004)
        stop = min(at + size, end)
        yield depth + len(rest), kind, at + head, stop
        rest.append((stop, end))
        if kind in CONTAINERS:
            if len(rest) > MAX_DEPTH:
                raise Malformed(3004)
            rest.append((at + head + (4 if kind == b"meta" else 0), stop))


def _table(b: bytes, at: int, columns: int, width: int = 4) -> np.ndarray:
    """Rows of a full box's table: entry count, then big-endian numbers."""
    n = big(b, at + 4, 4)
    raw = b[at + 8 : at + 8 + n * columns * width]
    if len(raw) < n * columns * width:
        raise Malformed(3004)
    return np.frombuffer(raw, f">u{width}").astype(np.int64).reshape(n, columns)


def sizes(b: bytes, kind: bytes, at: int) -> np.ndarray:
    """Sample sizes: one for all, one each, or packed in 4, 8 or 16 bits."""
    n = big(b, at + 8, 4)
    if kind == b"stsz":
        one = big(b, at + 4, 4)  # of more samples than that, none has bytes in the file
        return np.full(min(n, len(b) // one + 1), one, np.int64) if one else np.frombuffer(b[at + 12 : at + 12 + 4 * n], ">u4").astype(np.int64)
    bits = b[at + 7]
    raw = np.frombuffer(b[at + 12 : at + 12 + (n * bits + 7) // 8], np.uint8)
    if bits == 4:
        return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
    return raw.astype(np.int64) if bits == 8 else raw.view(">u2").astype(np.int64)


def expand(runs: np.ndarray, n: int) -> np.ndarray:
    """n values of (count, value) runs; empty runs are skipped and missing values are 0."""
    out = np.repeat(runs[:, 1], clipped(runs[:, 0], n))
    return np.concatenate([out, np.zeros(n - len(out), np.int64)])


def clipped(counts: np.ndarray, n: int) -> np.ndarray:
    """counts cut so that they add up to at most n, whatever a broken table says."""
    return np.diff(np.minimum(np.cumsum(np.minimum(counts, n)), n), prepend=0)


def samples(t: dict) -> dict[str, np.ndarray]:
    """size, pos, dts, pts, duration and key of the samples of a track's tables; none if a table is missing."""
    if any(not len(t.get(k, ())) for k in ("sizes", "chunks", "stsc", "stts")):
        return {k: np.zeros(0, np.int64) for k in ("size", "pos", "dts", "pts", "duration", "key")}
    first, per = np.maximum(t["stsc"][:, 0] - 1, 0), t["stsc"][:, 1]
    ends = np.append(first[1:], len(t["chunks"]))
    in_chunk = np.zeros(len(t["chunks"]), np.int64)
    for a, z, k in zip(first, ends, per, strict=True):
        in_chunk[a:z] = k
    chunk = np.repeat(np.arange(len(in_chunk)), clipped(in_chunk, len(t["sizes"])))
    size = t["sizes"][: len(chunk)]
    total = np.concatenate([[0], np.cumsum(size)])[:-1]
    new = np.concatenate([[True], chunk[1:] != chunk[:-1]])
    pos = t["chunks"][chunk] + total - total[np.maximum.accumulate(np.where(new, np.arange(len(chunk)), 0))]
    duration = expand(t["stts"], len(chunk))
    dts = np.concatenate([[0], np.cumsum(duration)])[:-1] - t.get("origin", 0)
    pts = dts + (expand(t["ctts"], len(chunk)) if "ctts" in t else 0)
    key = np.isin(np.arange(1, len(chunk) + 1), t["stss"]) if "stss" in t else np.ones(len(chunk), bool)
    return {"size": size, "pos": pos, "dts": dts, "pts": pts, "duration": duration, "key": key}


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            self.left = 0
            return 0
        self.left -= n
        return self.value >> self.left & (1 << n) - 1


def audio_config(config: bytes) -> dict:
    """profile, sample_rate and channels of an AudioSpecificConfig, with SBR and PS signalled either way."""
    r = _Bits(config)

    def kind() -> int:
        k = r.take(5)
        return 32 + r.take(6) if k == 31 else k

    def rate() -> int:
        k = r.take(4)
        return r.take(24) if k == 15 else AAC_RATES[k] if k < len(AAC_RATES) else 0

    profile, hz, layout = kind(), rate(), r.take(4)
    channels = AAC_CHANNELS[layout] if layout < len(AAC_CHANNELS) else 0
    extended, spread, parametric = 0, False, profile == 29
    if profile in (5, 29):
        spread, extended, profile = True, rate(), kind()
    if 1 <= profile <= 7:
        r.take(1)
        if r.take(1):
            r.take(14)
        r.take(1)
    if not spread and r.left >= 11 and r.take(11) == 0x2B7 and kind() == 5 and r.take(1):
        spread, extended = True, rate()
        sync = r.take(11) if r.left >= 12 else 0
        parametric = (sync == 0x548 or (sync == 0x2B7 and kind() == 29)) and bool(r.take(1))
    return {"profile": 29 if parametric else 5 if spread else profile, "sample_rate": extended or hz, "channels": 2 if parametric and channels == 1 else channels}


def _descriptors(b: bytes, at: int, end: int):
    """(tag, begin, end) of MPEG-4 descriptors, sizes in groups of seven bits."""
    while at + 2 <= end:
        tag, size, at = b[at], 0, at + 1
        while at < end:
            size, more, at = size << 7 | b[at] & 127, b[at] & 128, at + 1
            if not more:
                break
        yield tag, at, min(at + size, end)
        at += size


def decoder_config(b: bytes, at: int, end: int) -> bytes:
    """The AudioSpecificConfig within an elementary stream descriptor."""
    for tag, x, y in _descriptors(b, at, end):
        if tag == 3:
            return decoder_config(b, x + 3, y)
        if tag == 4:
            return decoder_config(b, x + 13, y)
        if tag == 5:
            return b[x:y]
    return b""


def opus_config(body: bytes) -> bytes:
    """An identification header made from the configuration box."""
    channels, skip, gain = body[1], int.from_bytes(body[2:4], "big"), int.from_bytes(body[8:10], "big", signed=True)
    return opus_head(channels, skip, gain)


def _entry(b: bytes, at: int, end: int, kind: str) -> dict:
    """codec, shape, extradata and length bytes of the first sample entry."""
    name = b[at + 4 : at + 8].decode("latin-1")
    out: dict = {"codec": CODECS.get(name), "profile": None, "level": None, "extradata": None, "length_bytes": 0}
    if kind == "video":
        out["video"] = {"width": big(b, at + 32, 2), "height": big(b, at + 34, 2), "framerate": base(0, 1), "color_space": None, "transfer": None}
        inner = at + 86
    elif kind == "audio":
        out["audio"] = {"sample_rate": big(b, at + 32, 4) >> 16, "channels": big(b, at + 24, 2), "bit_depth": big(b, at + 26, 2)}
        inner = at + 36 + {1: 16, 2: 36}.get(big(b, at + 16, 2), 0)
    else:
        return out
    for _, box, x, y in boxes(b, inner, end):
        body = b[x:y]
        if box in (b"avcC", b"hvcC"):
            sets = (avc_parameter_sets if box == b"avcC" else hevc_parameter_sets)(body)
            if sets is None:
                raise Malformed(3004)
            out["length_bytes"], out["extradata"] = sets
            out["profile"], out["level"] = (body[1], body[3]) if box == b"avcC" else (body[1] & 31, body[12])
        elif box == b"vvcC":
            sets = vvc_parameter_sets(body[4:])
            if sets is None:
                raise Malformed(3004)
            out["length_bytes"], out["extradata"] = sets
            out["profile"] = body[9] >> 1 if body[4] & 1 else None
        elif box == b"evcC" and len(body) >= 12:
            out["extradata"], out["profile"], out["level"] = body, body[1], body[2]
        elif box == b"av1C" and len(body) >= 2:
            out["extradata"], out["profile"], out["level"] = body, body[1] >> 5, body[1] & 31
        elif box == b"vpcC" and len(body) >= 6:
            out["extradata"], out["profile"], out["level"] = body, body[4], body[5]
        elif box == b"esds":
            config = decoder_config(b, x + 4, y)
            out["extradata"] = config
            if config and out["codec"] == "aac":
                found = audio_config(config)
                out["profile"] = found["profile"]
                out["audio"] |= {k: found[k] for k in ("sample_rate", "channels") if found[k]}
        elif box == b"dOps":
            out["extradata"] = opus_config(body)
        elif box == b"dfLa":
            out["extradata"] = b"fLaC" + body[4:]
        elif box == b"alac":
            out["extradata"] = body[4:]
        elif box == b"colr" and body[:4] in (b"nclx", b"nclc") and kind == "video":
            out["video"] |= {"color_space": SPACES.get(big(body, 4, 2)), "transfer": TRANSFERS.get(big(body, 6, 2))}
    return out


def _tracks(b: bytes) -> list[dict]:
    out: list[dict] = []
    for _, kind, x, y in boxes(b):
        if kind == b"trak":
            out.append({"id": 0, "type": "none", "scale": 1, "header_duration": 0, "entry": {}})
        if not out:
            continue
        t, wide = out[-1], b[x] == 1 if x < len(b) else False
        if kind == b"tkhd":
            t["id"] = big(b, x + (20 if wide else 12), 4)
        elif kind == b"mdhd":
            t["scale"], t["header_duration"] = (big(b, x + 20, 4), big(b, x + 24, 8)) if wide else (big(b, x + 12, 4), big(b, x + 16, 4))
        elif kind == b"hdlr":
            t["type"] = {b"vide": "video", b"soun": "audio", b"sbtl": "subtitle", b"text": "subtitle"}.get(b[x + 8 : x + 12], "none")
        elif kind == b"stsd" and big(b, x + 4, 4):
            t["entry"] = _entry(b, x + 8, min(y, x + 8 + big(b, x + 8, 4)), t["type"])
        elif kind in (b"stts", b"ctts"):
            t[kind.decode()] = _table(b, x, 2)
            if kind == b"ctts" and b[x] == 1:
                t["ctts"][:, 1] = t["ctts"][:, 1].astype(np.uint32).astype(np.int32)
        elif kind == b"stsc":
            t["stsc"] = _table(b, x, 3)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(b, x, 1, 4 if kind == b"stco" else 8)[:, 0]
        elif kind == b"stss":
            t["stss"] = _table(b, x, 1)[:, 0]
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = sizes(b, kind, x)
        elif kind == b"elst" and "origin" not in t:
            for k in range(big(b, x + 4, 4)):
                e = x + 8 + k * (20 if wide else 12)
                media = int.from_bytes(b[e + (8 if wide else 4) : e + (16 if wide else 8)], "big", signed=True)
                if media >= 0 and big(b, e + (16 if wide else 8), 2) == 1:
                    t["origin"] = media
                    break
    return out


def merged(offsets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(track, sample) in the order of a merge by head offset; ties go to the earlier track."""
    ready = np.concatenate([np.maximum.accumulate(o) if len(o) else o for o in offsets]) if offsets else np.zeros(0)
    stream = np.concatenate([np.full(len(o), k) for k, o in enumerate(offsets)]) if offsets else np.zeros(0)
    n = np.concatenate([np.arange(len(o)) for o in offsets]) if offsets else np.zeros(0)
    order = np.lexsort((n, stream, ready))
    return list(zip(stream[order].astype(int).tolist(), n[order].astype(int).tolist(), strict=True))


def bmff(b: bytes):
    """Tracks that have a type and samples, re-indexed, and their packets merged by offset.

    Length-prefixed video units become start-code units, with parameter sets
    before key frames.
    """
    if len(b) < 8 or not any(kind == b"moov" for _, kind, _, _ in boxes(b)):
        raise Malformed(3003)
    live = [(t, s) for t in _tracks(b) if t["type"] != "none" and len((s := samples(t))["size"])]
    for k, (t, s) in enumerate(live):
        e = dict(t["entry"])
        e.pop("length_bytes", None)
        made = int((s["pts"] + s["duration"]).max() - s["pts"].min())
        yield track(k, t["type"], e.pop("codec", None), id=t["id"], time_base=base(1, t["scale"]), start_time=int(s["pts"].min()), duration=made if made > 0 else t["header_duration"], nb_frames=len(s["size"]), **e)
    for seq, (k, i) in enumerate(merged([s["pos"] for _, s in live])):
        t, s = live[k]
        pos, key = int(s["pos"][i]), bool(s["key"][i])
        payload, width = b[pos : pos + int(s["size"][i])], t["entry"].get("length_bytes", 0)
        if width:
            payload = to_annexb(payload, width, t["entry"]["extradata"], key)
        yield packet(seq, pos, payload, stream_index=k, pts=int(s["pts"][i]), dts=int(s["dts"][i]), duration=int(s["duration"][i]), is_keyframe=key)


# Sample entries that writing uses where reading knows several.
ENTRIES = {codec: kind for kind, codec in reversed(SAMPLE_ENTRIES)}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, bytes([version, 0, 0, 0]), *parts)


def _rows(kind: bytes, rows, version: int = 0) -> bytes:
    x = np.array(rows, np.int64).reshape(len(rows), -1)
    return _full(kind, len(x).to_bytes(4, "big"), x.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 4:].tobytes(), version=version)


def _runs(values: np.ndarray) -> np.ndarray:
    """(count, value) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return np.stack([np.diff(np.append(first, len(values))), values[first]], 1)


def write(tracks: list[dict], packets: list[tuple[int, int, int, bool, bytes]]) -> bytes:
    """An ISO file of tracks (type, codec, scale, audio or video) and packets (track index, pts, duration, keyframe, payload) in decoding order.

    Packets lie in the order given; neighbours of one track are a chunk. Decoding
    times are the running sums of durations from 0, and what a pts differs from
    them is its composition offset. Tracks other than audio and video, without a
    packet or of a codec without a sample entry raise Malformed(1001), a packet
    of an undeclared track Malformed(3007), a file beyond 4 GB Malformed(1001).
    """
    head = _box(b"ftyp", b"isom", bytes(4), b"isom")
    stream = np.array([p[0] for p in packets], np.int64)
    if len(stream) and not 0 <= stream.min() <= stream.max() < len(tracks):
        raise Malformed(3007)
    size = np.array([len(p[4]) for p in packets], np.int64)
    pos = len(head) + 8 + np.concatenate([[0], np.cumsum(size)])[:-1]
    if pos[-1:].sum() + size[-1:].sum() >= 1 << 32:
        raise Malformed(1001)
    new = np.concatenate([[True], stream[1:] != stream[:-1]])
    moov = _full(b"mvhd", bytes(96))
    for k, t in enumerate(tracks):
        own = np.flatnonzero(stream == k)
        entry = ENTRIES.get(t["codec"])
        if t["type"] not in ("audio", "video") or entry is None or not len(own):
            raise Malformed(1001)
        duration = np.array([packets[i][2] for i in own], np.int64)
        offset = np.array([packets[i][1] for i in own], np.int64) - (np.cumsum(duration) - duration)
        keys = np.flatnonzero([packets[i][3] for i in own]) + 1
        starts = np.flatnonzero(new[own])
        per = np.diff(np.append(starts, len(own)))
        changed = np.flatnonzero(np.concatenate([[True], per[1:] != per[:-1]]))
        tables = [
            _rows(b"stts", _runs(duration)), _rows(b"stsc", np.stack([changed + 1, per[changed], np.ones(len(changed), np.int64)], 1)), _rows(b"stco", pos[own[starts]]),
            _full(b"stsz", bytes(4), len(own).to_bytes(4, "big"), size[own].astype(">u4").tobytes()),
        ]
        if offset.any():
            tables.append(_rows(b"ctts", _runs(offset), version=1))
        if len(keys) < len(own):
            tables.append(_rows(b"stss", keys))
        if t["type"] == "video":
            shape = bytes(16) + t["video"]["width"].to_bytes(2, "big") + t["video"]["height"].to_bytes(2, "big") + bytes(50)
        else:
            a = t["audio"]
            shape = bytes(8) + a["channels"].to_bytes(2, "big") + (a.get("bit_depth") or 16).to_bytes(2, "big") + bytes(4) + (a["sample_rate"] << 16).to_bytes(4, "big")
        stsd = _full(b"stsd", (1).to_bytes(4, "big"), _box(entry.encode("latin-1"), bytes(6), b"\0\1", shape))
        mdhd = _full(b"mdhd", bytes(8), t["scale"].to_bytes(4, "big"), int(duration.sum()).to_bytes(4, "big"), bytes(4))
        hdlr = _full(b"hdlr", bytes(4), b"vide" if t["type"] == "video" else b"soun", bytes(12))
        tkhd = _full(b"tkhd", bytes(8), (k + 1).to_bytes(4, "big"), bytes(68))
        moov += _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, _box(b"minf", _box(b"stbl", stsd, *tables))))
    return head + _box(b"mdat", *(p[4] for p in packets)) + _box(b"moov", moov)
