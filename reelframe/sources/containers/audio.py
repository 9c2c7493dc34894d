"""WAV, MP3 and Ogg files."""

from __future__ import annotations

from reelframe.sources.containers import Malformed, base, packet, track, u16, u32

WAV_PACKET, MP3_SCAN = 4096, 16384
# Fixed values: (format tag, bits) of WAV to codec.
WAV_CODECS = {(1, 8): "pcm_u8", (1, 16): "pcm_s16le", (1, 24): "pcm_s24le", (1, 32): "pcm_s32le", (3, 32): "pcm_f32le", (3, 64): "pcm_f64le"}


def riff_chunks(b: bytes):
    """(id, begin, size) of each chunk; a chunk of odd size is padded."""
    at = 12
    while at + 8 <= len(b):
        size = u32(b, at + 4)
        yield b[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def wav(b: bytes):
    if len(b) < 12 or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        raise Malformed(3003)
    fmt = data = None
    for name, begin, size in riff_chunks(b):
        if name == b"fmt " and size >= 16:
            fmt = u16(b, begin), u16(b, begin + 2), u32(b, begin + 4), u16(b, begin + 14)
        elif name == b"data":
            if fmt is None:
                raise Malformed(3003)
            data = begin, min(size, len(b) - begin)
            break
    if not data or not data[1]:
        raise Malformed(3003)
    tag, channels, rate, bits = fmt
    codec = WAV_CODECS.get((tag, bits))
    if codec is None or not channels or not rate:
        raise Malformed(3002)
    block = channels * (bits // 8)
    yield track(0, "audio", codec, audio={"sample_rate": rate, "channels": channels, "bit_depth": bits}, bitrate=rate * block * 8, time_base=base(1, rate), duration=data[1] // block, nb_frames=data[1] // block)
    for k, at in enumerate(range(0, data[1], WAV_PACKET)):
        part = b[data[0] + at : data[0] + min(at + WAV_PACKET, data[1])]
        yield packet(k, data[0] + at, part, pts=at // block, dts=at // block, duration=len(part) // block)


# Bit rates in kbit/s by version group and layer, and sample rates of MPEG-1.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]


def mpeg_header(b: bytes, at: int) -> dict | None:
    """The MPEG audio frame header at a position: size, samples, rate, channels, kbps, layer; None if there is none."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, rate_code, bit_code = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 2 & 3, b[at + 2] >> 4
    if version == 1 or layer == 4 or rate_code == 3 or bit_code in (0, 15):
        return None
    group = 1 if version == 3 else 2
    rate = RATES[rate_code] >> {3: 0, 2: 1, 0: 2}[version]
    kbps, pad = BITRATES[group, layer][bit_code], b[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and group == 2 else 1152
    size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    return {"size": size, "samples": samples, "rate": rate, "channels": 1 if b[at + 3] >> 6 == 3 else 2, "kbps": kbps, "layer": layer, "group": group}


def id3_size(b: bytes) -> int:
    if len(b) < 10 or b[:3] != b"ID3" or 255 in b[3:5] or any(x & 128 for x in b[6:10]):
        return 0
    return (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9]) + 10 + (10 if b[5] & 16 else 0)


def vbr_samples(frame: bytes, head: dict) -> int:
    """Samples of the whole file by a Xing, Info or VBRI header in its first frame; 0 without one."""
    side = (32 if head["channels"] > 1 else 17) if head["group"] == 1 else (17 if head["channels"] > 1 else 9)
    x = 4 + side
    if frame[x : x + 4] in (b"Xing", b"Info") and len(frame) >= x + 12 and frame[x + 7] & 1:
        return int.from_bytes(frame[x + 8 : x + 12], "big") * head["samples"]
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        return int.from_bytes(frame[50:54], "big") * head["samples"]
    return 0


#: Size and samples of a frame by the second and third byte of its header, which tell both.
FRAMES = {k: (head["size"], head["samples"]) for k in range(0xE000, 0x10000) if (head := mpeg_header(bytes([0xFF, k >> 8, k & 255, 0]), 0))}
#: Most frames of a block.
MP3_BLOCK = 4096


def mp3_blocks(b: bytes):
    """The track, then ("block", {...}) items of up to MP3_BLOCK frames: seq of the first, and lists of pos, size, pts and duration."""
    skip = id3_size(b)
    at = skip
    while at < min(len(b), skip + MP3_SCAN):
        head = mpeg_header(b, at)
        if head and (at + head["size"] >= len(b) or mpeg_header(b, at + head["size"])):
            break
        at += 1
    else:
        raise Malformed(3003)
    total = vbr_samples(b[at : at + head["size"]], head) or int(len(b) / (head["kbps"] * 125.0) * head["rate"])
    yield track(0, "audio", "mp3", audio={"sample_rate": head["rate"], "channels": head["channels"], "bit_depth": 16}, bitrate=head["kbps"] * 1000, time_base=base(1, head["rate"]), duration=total)
    end, seq, time = len(b), 0, 0
    pos, size, pts, duration = [], [], [], []
    while 0 <= at <= end - 4:
        kind = FRAMES.get(b[at + 1] << 8 | b[at + 2]) if b[at] == 0xFF else None
        if kind is None:  # resynchronise
            at = b.find(b"\xff", at + 1)
            continue
        n, samples = kind
        if at + n > end:
            break
        pos.append(at)
        size.append(n)
        pts.append(time)
        duration.append(samples)
        at, time = at + n, time + samples
        if len(pos) == MP3_BLOCK:
            yield "block", {"seq": seq, "pos": pos, "size": size, "pts": pts, "duration": duration}
            seq += MP3_BLOCK
            pos, size, pts, duration = [], [], [], []
    if pos:
        yield "block", {"seq": seq, "pos": pos, "size": size, "pts": pts, "duration": duration}


def mp3(b: bytes):
    for name, item in mp3_blocks(b):
        if name == "track":
            yield name, item
        else:
            for k, (at, n, pts, samples) in enumerate(zip(item["pos"], item["size"], item["pts"], item["duration"], strict=True), item["seq"]):
                yield packet(k, at, b[at : at + n], pts=pts, dts=pts, duration=samples)


def ogg_pages(b: bytes):
    """(serial, granule or None, flags, begin of the body, segment sizes) of each page."""
    at = 0
    while (at := b.find(b"OggS", at)) >= 0 and at + 27 <= len(b):
        n = b[at + 26]
        sizes = b[at + 27 : at + 27 + n]
        body = at + 27 + n
        if body + sum(sizes) > len(b):
            raise Malformed(3004)
        granule = int.from_bytes(b[at + 6 : at + 14], "little", signed=True)
        yield int.from_bytes(b[at + 14 : at + 18], "little", signed=True), None if granule < 0 else granule, b[at + 5], body, sizes
        at = body + sum(sizes)


def ogg(b: bytes):
    """Logical streams by serial number. A page's granule position is the time of the last packet that ends in it."""
    index: dict[int, int] = {}
    parts: dict[int, bytes] = {}
    seq = 0
    for serial, granule, flags, at, sizes in ogg_pages(b):
        if serial not in index:
            index[serial] = len(index)
            first = b[at : at + sum(sizes)]
            yield _ogg_track(index[serial], serial, first)
        if not flags & 1:
            parts[serial] = b""
        ends = [k for k, n in enumerate(sizes) if n < 255]
        for k, n in enumerate(sizes):
            parts[serial] = parts.get(serial, b"") + b[at : at + n]
            at += n
            if n < 255:
                last = granule is not None and k == ends[-1]
                yield packet(seq, at - len(parts[serial]), parts[serial], stream_index=index[serial], pts=granule if last else -1, dts=granule if last else -1)
                parts[serial], seq = b"", seq + 1
    if not index:
        raise Malformed(3003)


def _ogg_track(index: int, serial: int, head: bytes):
    if head[1:7] == b"vorbis" and len(head) >= 30:
        rate = u32(head, 12)
        return track(index, "audio", "vorbis", id=serial, audio={"sample_rate": rate, "channels": head[11], "bit_depth": 0}, bitrate=u32(head, 20), time_base=base(1, rate))
    if head[:8] == b"OpusHead" and len(head) >= 19:
        return track(index, "audio", "opus", id=serial, audio={"sample_rate": u32(head, 12), "channels": head[9], "bit_depth": 0}, time_base=base(1, 48000))
    return track(index, "none", None, id=serial)
