"""Still and animated images: one packet for a file, or for each frame of WebP."""

from __future__ import annotations

from reelframe.sources.containers import Malformed, base, big, packet, track, u16, u32


def _image(codec: str, width: int, height: int, b: bytes, **more):
    if not width or not height:
        raise Malformed(3003)
    yield track(0, "image", codec, image={"width": width, "height": height}, time_base=more.pop("time_base", base(1, 1)), **more)
    yield packet(0, 0, b)


def png(b: bytes):
    if b[:16] != b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR":
        raise Malformed(3003)
    yield from _image("png", big(b, 16, 4), big(b, 20, 4), b)


def jpeg(b: bytes):
    """Markers up to a start of frame (C0 to CF but the tables C4, C8, CC)."""
    if b[:2] != b"\xff\xd8":
        raise Malformed(3003)
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise Malformed(3004)
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            yield from _image("jpeg", big(b, at + 7, 2), big(b, at + 5, 2), b)
            return
        else:
            at += 2 + big(b, at + 2, 2)
    raise Malformed(3004)


def gif_blocks(b: bytes):
    """(kind, position) of each block after the global colour table; kind is 0x21 or 0x2C."""
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)
    while at < len(b) and b[at] != 0x3B:
        kind, begin = b[at], at
        if kind == 0x21:
            at += 2
        elif kind == 0x2C:
            at += 10 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0) + 1
        else:
            raise Malformed(3004)
        yield kind, begin
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1


def gif(b: bytes):
    if b[:4] != b"GIF8" or len(b) < 13:
        raise Malformed(3003)
    n = sum(kind == 0x2C for kind, _ in gif_blocks(b))
    yield from _image("gif", u16(b, 6), u16(b, 8), b, time_base=base(1, 100), duration=n, nb_frames=n)


def bmp(b: bytes):
    if b[:2] != b"BM" or len(b) < 54 or u16(b, 26) != 1 or u16(b, 28) not in (1, 4, 8, 16, 24, 32) or u32(b, 30) > 2 or u32(b, 10) < 54:
        raise Malformed(3003)
    yield from _image("bmp", u32(b, 18), abs(int.from_bytes(b[22:26], "little", signed=True)), b)


def tga(b: bytes):
    if len(b) < 18 or not b[2] or b[16] not in (8, 15, 16, 24, 32):
        raise Malformed(3003)
    yield from _image("tga", u16(b, 12), u16(b, 14), b)


# Bytes of each TIFF field type.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def tiff_fields(b: bytes) -> tuple[str, dict[int, list[int]]]:
    """(byte order, tag -> whole numbers) of the first directory."""
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(b[:4])
    if order is None:
        raise Malformed(3003)
    num = lambda at, n: int.from_bytes(b[at : at + n], order)
    at, out = num(4, 4), {}
    if at + 2 > len(b):
        raise Malformed(3004)
    for k in range(num(at, 2)):
        e = at + 2 + 12 * k
        tag, kind, count = num(e, 2), num(e + 2, 2), num(e + 4, 4)
        size = TIFF_SIZES.get(kind, 0)
        begin = e + 8 if size * count <= 4 else num(e + 8, 4)
        if kind in (1, 3, 4) and begin + size * count <= len(b):
            out[tag] = [num(begin + size * i, size) for i in range(count)]
    return order, out


def tiff(b: bytes):
    fields = tiff_fields(b)[1]
    yield from _image("tiff", fields.get(256, [0])[0], fields.get(257, [0])[0], b)


def webp(b: bytes):
    """Canvas size and, of an animation, one packet for each frame with its running start in milliseconds."""
    if len(b) < 20 or b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        raise Malformed(3003)
    size, frames, at = None, [], 12
    while at + 8 <= len(b):
        name, n, body = b[at : at + 4], u32(b, at + 4), at + 8
        if name == b"VP8X":
            size = int.from_bytes(b[body + 4 : body + 7], "little") + 1, int.from_bytes(b[body + 7 : body + 10], "little") + 1
        elif name == b"VP8 " and size is None:
            size = u16(b, body + 6) & 0x3FFF, u16(b, body + 8) & 0x3FFF
        elif name == b"VP8L" and size is None:
            x = u32(b, body + 1)
            size = (x & 0x3FFF) + 1, (x >> 14 & 0x3FFF) + 1
        elif name == b"ANMF":
            frames.append((body, n, int.from_bytes(b[body + 12 : body + 15], "little")))
        at = body + n + (n & 1)
    if size is None:
        raise Malformed(3003)
    total = sum(d for _, _, d in frames)
    yield track(0, "image", "webp", image={"width": size[0], "height": size[1]}, time_base=base(1, 1000), duration=total, nb_frames=len(frames) or 1)
    pts = 0
    for k, (body, n, delay) in enumerate(frames or [(0, len(b), 0)]):
        yield packet(k, body, b[body : body + n], pts=pts, dts=pts, duration=delay)
        pts += delay
