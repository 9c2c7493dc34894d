"""Lossless picture decoders in NumPy: file bytes to RGBA (or gray) arrays [height, width, channel]."""

from __future__ import annotations

import zlib

import numpy as np

from reelframe.sources.containers import Malformed, big, u16, u32
from reelframe.sources.containers.images import gif_blocks, tiff_fields

Picture = tuple[str, np.ndarray]
#: Larger pictures aren't decoded: a few bytes may claim any size.
MAX_PIXELS = 1 << 26


def _need(ok: bool, code: int = 4005) -> None:
    if not ok:
        raise Malformed(code)


def _bounded(width: int, height: int) -> None:
    """A picture that has pixels, and not too many for a task's memory."""
    _need(width > 0 and height > 0)
    _need(width * height <= MAX_PIXELS, 4002)


def opaque(rgb: np.ndarray) -> np.ndarray:
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, rgb.dtype)], 2)


def unpacked(rows: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, the first in the top bits."""
    if bits == 8:
        return rows[:, :width]
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits
    return ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(len(rows), -1)[:, :width]


def coloured(index: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Colours of indices; black and clear outside the palette."""
    table = np.zeros((256, 4), np.uint8)
    table[: len(palette)] = palette[:256]
    return table[index]


def bmp(b: bytes, compat: bool = False) -> Picture:
    """1, 4, 8 (palette), 16 (5-5-5), 24, 32 bits and RLE8, RLE4. Rows run upward unless the height is negative.

    compat keeps uncompressed rows in file order.
    """
    _need(len(b) >= 54 and b[:2] == b"BM", 3003)
    offset, head, width = u32(b, 10), u32(b, 14), u32(b, 18)
    tall = int.from_bytes(b[22:26], "little", signed=True)
    bits, compression, used = u16(b, 28), u32(b, 30), u32(b, 46)
    height = abs(tall)
    _bounded(width, height)
    _need(bits in (1, 4, 8, 16, 24, 32), 4002)
    palette = np.zeros((0, 4), np.uint8)
    if bits <= 8:
        raw = b[14 + head : 14 + head + 4 * (used or 1 << bits)]
        palette = np.frombuffer(raw[: len(raw) // 4 * 4], np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].copy()
        palette[:, 3] = 255
    if compression in (1, 2):
        return "rgba", coloured(_rle(b, offset, width, height, compression == 2), palette)[::-1]
    stride = (width * bits + 31) // 32 * 4
    _need(offset + stride * height <= len(b))
    rows = np.frombuffer(b, np.uint8, stride * height, offset).reshape(height, stride)
    if bits <= 8:
        out = coloured(unpacked(rows, bits, width), palette)
    elif bits == 16:
        v = rows[:, : 2 * width].copy().view("<u2")
        out = opaque(np.stack([(v >> k & 31) << 3 for k in (10, 5, 0)], 2).astype(np.uint8))
    elif bits == 24:
        out = opaque(rows[:, : 3 * width].reshape(height, width, 3)[:, :, ::-1])
    else:
        out = rows[:, : 4 * width].reshape(height, width, 4)[:, :, [2, 1, 0, 3]]
    return "rgba", out if tall < 0 or compat else out[::-1]


def _rle(b: bytes, at: int, width: int, height: int, half: bool) -> np.ndarray:
    """Indices [row from the bottom, x] of run-length data; runs past an edge are cut."""
    out = np.zeros((height, width), np.uint8)
    x = y = 0

    def put(values) -> None:
        nonlocal x
        part = np.asarray(values, np.uint8)[: max(0, width - x)]
        if y < height:
            out[y, x : x + len(part)] = part
        x += len(values)

    def nibbles(raw: bytes, n: int) -> list[int]:
        return [raw[k // 2] >> 4 if k % 2 == 0 else raw[k // 2] & 15 for k in range(n)]

    while at + 2 <= len(b) and y < height:
        n, v, at = b[at], b[at + 1], at + 2
        if n:
            put(nibbles(bytes([v]) * ((n + 1) // 2), n) if half else [v] * n)
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + b[at], y + b[at + 1], at + 2
        else:
            size = (v + 1) // 2 if half else v
            raw = b[at : at + size]
            _need(len(raw) == size)
            put(nibbles(raw, v) if half else list(raw))
            at += size + (size & 1)
    return out


def tga(b: bytes) -> Picture:
    """Types 2, 3, 10, 11; the descriptor's bit 5 says that rows run downward."""
    _need(len(b) >= 18, 3003)
    kind, width, height, depth = b[2], u16(b, 12), u16(b, 14), b[16]
    _need(kind in (2, 3, 10, 11) and depth in (8, 15, 16, 24, 32), 4002)
    _bounded(width, height)
    at, size = 18 + b[0] + (u16(b, 5) * ((b[7] + 7) // 8) if b[1] else 0), (depth + 7) // 8
    n = width * height
    if kind < 8:
        raw = b[at : at + n * size]
    else:
        parts, have = [], 0
        while have < n and at < len(b):
            count, run, at = (b[at] & 127) + 1, b[at] & 128, at + 1
            take = size if run else size * count
            parts.append(b[at : at + take] * (count if run else 1))
            at, have = at + take, have + count
        raw = b"".join(parts)[: n * size]
    _need(len(raw) == n * size)
    x = np.frombuffer(raw, np.uint8).reshape(height, width, size)
    if size == 1:
        name, out = "gray8", x
    elif size == 2:
        v = x.reshape(height, width * 2).copy().view("<u2").reshape(height, width)
        name, out = "rgba", opaque(np.stack([(v >> k & 31) << 3 for k in (10, 5, 0)], 2).astype(np.uint8))
    else:
        name, out = "rgba", opaque(x[:, :, ::-1]) if size == 3 else x[:, :, [2, 1, 0, 3]]
    return name, out if b[17] & 32 else out[::-1]


def _unfiltered(data: bytes, height: int, row: int, step: int) -> np.ndarray:
    """Rows of filtered PNG data."""
    _need(len(data) >= height * (row + 1))
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.int64)
    for y in range(height):
        kind = data[y * (row + 1)]
        line = np.frombuffer(data, np.uint8, row, y * (row + 1) + 1).astype(np.int64)
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step])
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            values, up = line.tolist(), above.tolist()
            for x in range(row):
                left, corner = (values[x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    guess = left + up[x] >> 1
                else:
                    p = left + up[x] - corner
                    da, db, dc = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = left if da <= db and da <= dc else up[x] if db <= dc else corner
                values[x] = values[x] + guess & 255
            line = np.array(values)
        else:
            _need(kind == 0)
        above = line & 255
        out[y] = above
    return out


# First column, first row and steps of the seven passes of an interlaced PNG.
ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def png(b: bytes) -> Picture:
    """All colour types, interlaced or not: 16 bits to 8, palette and RGB to RGBA, gray below 8 bits to 8; gray's alpha is dropped."""
    _need(b[:8] == b"\x89PNG\r\n\x1a\n", 3003)
    at, data, palette, clear = 8, [], np.zeros((0, 4), np.uint8), b""
    width = height = depth = colour = laced = 0
    while at + 8 <= len(b):
        n, kind, body = big(b, at, 4), b[at + 4 : at + 8], b[at + 8 : at + 8 + big(b, at, 4)]
        if kind == b"IHDR":
            width, height, depth, colour, laced = big(body, 0, 4), big(body, 4, 4), body[8], body[9], body[12]
        elif kind == b"PLTE":
            palette = opaque(np.frombuffer(body, np.uint8).reshape(1, -1, 3))[0].copy()
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    _need(channels is not None and depth in (1, 2, 4, 8, 16) and laced in (0, 1), 4002)
    _bounded(width, height)
    x = np.zeros((height, width, channels), np.uint8)
    passes = [x[y0::dy, x0::dx] for x0, y0, dx, dy in (ADAM7 if laced else [(0, 0, 1, 1)])]
    rows = [(part.shape[1] * channels * depth + 7) // 8 for part in passes]
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), sum(len(part) * (row + 1) for part, row in zip(passes, rows, strict=True)))
    except zlib.error:
        raise Malformed(4005) from None
    begin = 0
    for part, row in zip(passes, rows, strict=True):
        if part.size:  # a pass without pixels has no bytes
            lines = _unfiltered(raw[begin:], len(part), row, max(1, channels * depth // 8))
            begin += len(part) * (row + 1)
            part[:] = unpacked(lines, depth, part.shape[1])[:, :, None] if depth < 8 else lines[:, :: depth // 8].reshape(part.shape)
    if colour == 3:
        if clear:
            palette[: len(clear), 3] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return "rgba", coloured(x[:, :, 0], palette)
    if colour in (0, 4):
        return "gray8", (x[:, :, :1] * (255 // ((1 << min(depth, 8)) - 1))).astype(np.uint8)
    return "rgba", opaque(x) if colour == 2 else x


def lzw(data: bytes, bits: int, most: int) -> bytes:
    """GIF's LZW: codes of growing width, the least significant bit first; what follows `most` bytes isn't read."""
    _need(1 <= bits <= 11)
    clear, end = 1 << bits, (1 << bits) + 1
    first = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, width, last, out = list(first), bits + 1, None, []
    value = have = made = 0
    for byte in data:
        if made >= most:
            break
        value |= byte << have
        have += 8
        while have >= width:
            code, value, have = value & (1 << width) - 1, value >> width, have - width
            if code == clear:
                table, width, last = list(first), bits + 1, None
                continue
            if code == end:
                return b"".join(out)
            if last is None:
                entry = table[code]
            else:
                _need(code <= len(table))
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    table.append(last + entry[:1])
            out.append(entry)
            made += len(entry)
            last = entry
            if len(table) == 1 << width and width < 12:
                width += 1
    return b"".join(out)


def gif(b: bytes):
    """The canvas of each frame in turn, cleared before it; clear pixels keep the background's zeros."""
    _need(b[:4] == b"GIF8", 3003)
    width, height = u16(b, 6), u16(b, 8)
    _bounded(width, height)
    colours = lambda at, flags: opaque(np.frombuffer(b, np.uint8, 3 << (flags & 7) + 1, at).reshape(1, -1, 3))[0]
    shared = colours(13, b[10]) if b[10] & 128 else np.zeros((0, 4), np.uint8)
    clear = None
    for kind, at in gif_blocks(b):
        if kind == 0x21:
            if b[at + 1] == 0xF9:
                clear = b[at + 6] if b[at + 3] & 1 else None
            continue
        x, y, w, h, flags = u16(b, at + 1), u16(b, at + 3), u16(b, at + 5), u16(b, at + 7), b[at + 9]
        _bounded(w, h)
        own, data = at + 10, b""
        palette = colours(own, flags) if flags & 128 else shared
        own += len(palette) * 3 if flags & 128 else 0
        bits, own = b[own], own + 1
        while own < len(b) and b[own]:
            data += b[own + 1 : own + 1 + b[own]]
            own += b[own] + 1
        index = np.frombuffer(lzw(data, bits, w * h).ljust(w * h, b"\0")[: w * h], np.uint8).reshape(h, w)
        if flags & 64:  # four passes of rows
            order = [r for begin, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(begin, h, step)]
            index = index[np.argsort(order)]
        pixels = coloured(index, palette)
        if clear is not None:
            pixels[index == clear] = 0
        canvas = np.zeros((height, width, 4), np.uint8)
        part = pixels[: max(0, height - y), : max(0, width - x)]
        canvas[y : y + part.shape[0], x : x + part.shape[1]] = part
        yield canvas
        clear = None


def packbits(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while at < len(data) and have < size:
        n = data[at]
        part = data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
        out.append(part)
        at, have = at + (2 + n if n < 128 else 2 if n > 128 else 1), have + len(part)
    return b"".join(out)


def tiff_lzw(data: bytes, most: int) -> bytes:
    """TIFF's LZW: the most significant bit first, codes a bit wider one entry before they must be; what follows `most` bytes isn't read."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last, out = list(single), 9, b"", []
    value = have = made = 0
    for byte in data:
        value, have = (value << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = value >> have & (1 << width) - 1
        if code == 257 or made >= most:
            break
        if code == 256:
            table, width, last = list(single), 9, b""
            continue
        _need(code < len(table) or (code == len(table) and bool(last)))
        entry = table[code] if code < len(table) else last + last[:1]
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        out.append(entry)
        made, last = made + len(entry), entry
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)[:most]


def _strip(data: bytes, kind: int, size: int) -> bytes:
    """The bytes, at most `size`, of a strip compressed in a way that TIFF names by number."""
    if kind == 32773:
        return packbits(data, size)[:size]
    if kind == 5:
        return tiff_lzw(data, size)
    if kind in (8, 32946):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error:
            raise Malformed(4005) from None
    return data[:size]


def tiff(b: bytes) -> Picture:
    """Strips, plain or in PackBits, LZW or Deflate (with or without differences), of gray, RGB(A) and CMYK of 8 or 16 bits; white-is-zero gray is inverted."""
    order, f = tiff_fields(b)
    one = lambda tag, default: f.get(tag, [default])[0]
    width, height, bits, channels, kind, photo = one(256, 0), one(257, 0), one(258, 1), one(277, 1), one(259, 1), one(262, 0)
    _need(bits in (8, 16) and kind in (1, 5, 8, 32773, 32946) and photo in (0, 1, 2, 5) and one(284, 1) == 1 and one(317, 1) in (1, 2) and 273 in f, 4002)
    _bounded(width, height)
    rows, row = one(278, height), width * channels * bits // 8
    _need(rows > 0 and channels > 0)
    places = zip(f[273], f.get(279, []), strict=True)
    raw = b"".join(_strip(b[at : at + n], kind, row * max(0, min(rows, height - k * rows))) for k, (at, n) in enumerate(places))
    _need(len(raw) >= row * height)
    kinds = np.uint8 if bits == 8 else np.dtype(">u2" if order == "big" else "<u2")
    x = np.frombuffer(raw, kinds, width * height * channels).reshape(height, width, channels)
    x = x if bits == 8 else x.astype(np.uint16)
    if one(317, 1) == 2:  # samples are differences along a row
        x = np.cumsum(x, axis=1, dtype=x.dtype)
    if photo in (0, 1):
        x = x[:, :, :1]
        return f"gray{bits}", x if photo == 1 else (1 << bits) - 1 - x
    if photo == 5:
        _need(channels >= 4 and bits == 8, 4002)
        part = np.float32(1) - x[:, :, :4].astype(np.float32) / np.float32(255)
        return "rgba", opaque((part[:, :, :3] * part[:, :, 3:] * np.float32(255)).astype(np.uint8))
    _need(channels >= 3)
    full = x[:, :, :4] if channels >= 4 else np.concatenate([x, np.full((height, width, 1), (1 << bits) - 1, x.dtype)], 2)
    return "rgba" if bits == 8 else "rgba64", full
