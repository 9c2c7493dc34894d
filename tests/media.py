"""Tiny media files, built from the published formats."""

import struct
import zlib

from reelframe.functions.bitstream import crc8, crc16


def wav(samples: bytes, tag=1, bits=16, channels=2, rate=8000, extra=b""):
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * block, block, bits)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(width, height, bits, rows: list[bytes], palette=b"", compression=0, data=None):
    pixels = data if data is not None else b"".join(r.ljust((width * bits + 31) // 32 * 4, b"\0") for r in rows)
    offset = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", offset + len(pixels), 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, compression, len(pixels), 0, 0, len(palette) // 4, 0) + palette + pixels


def tga(kind, width, height, depth, data, descriptor=0):
    return bytes([0, 0, kind]) + bytes(9) + struct.pack("<HHBB", width, height, depth, descriptor) + data


def png(width, height, depth, colour, rows: list[bytes], filters=None, palette=b"", clear=b""):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    out, above = b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        f = (filters or [0])[y % len(filters or [0])]
        line = bytearray()
        for x, v in enumerate(row):
            left, corner = (row[x - step], above[x - step]) if x >= step else (0, 0)
            p = left + above[x] - corner
            paeth = min((left, above[x], corner), key=lambda q, p=p: abs(p - q))
            line.append((v - [0, left, above[x], (left + above[x]) // 2, paeth][f]) & 255)
        out, above = out + bytes([f]) + bytes(line), row
    extra = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def lzw(index: bytes, bits: int) -> bytes:
    """Codes that are never shorter than they need be: a clear code before each 2^bits - 2 of them."""
    width, value, have, out = bits + 1, 0, 0, bytearray()

    def put(code):
        nonlocal value, have
        value |= code << have
        have += width
        while have >= 8:
            out.append(value & 255)
            value >>= 8
            have -= 8

    for k, v in enumerate(index):
        if k % ((1 << bits) - 2) == 0:
            put(1 << bits)
        put(v)
    put((1 << bits) + 1)
    if have:
        out.append(value & 255)
    return bytes(out)


def gif(width, height, palette: bytes, frames):
    """frames: (x, y, w, h, indices, interlaced, clear index or None)."""
    bits = (len(palette) // 3 - 1).bit_length()
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | bits - 1, 0, 0) + palette
    for x, y, w, h, index, laced, clear in frames:
        if clear is not None:
            out += bytes([0x21, 0xF9, 4, 1, 5, 0, clear, 0])
        if laced:
            order = [r for b, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(b, h, s)]
            index = b"".join(index[r * w : (r + 1) * w] for r in order)
        data = lzw(index, max(2, bits))
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if laced else 0) + bytes([max(2, bits)])
        for k in range(0, len(data), 255):
            out += bytes([len(data[k : k + 255])]) + data[k : k + 255]
        out += b"\0"
    return out + b";"


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v, n):
        self.value, self.n = self.value << n | v & (1 << n) - 1, self.n + n

    def bytes(self):
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def flac_frame(number, channels: list[list[int]], bits=16, mode=None, kinds=None):
    """A frame of sub-frames: constant, verbatim, fixed (order 2, Rice) or lpc (order 1)."""
    n = len(channels[0])
    assignment = mode if mode is not None else len(channels) - 1
    head = bytes([0xFF, 0xF8, 0x70 | 9, assignment << 4 | {8: 1, 16: 4, 24: 6}[bits] << 1, number]) + struct.pack(">H", n - 1)
    head += bytes([crc8(head)])
    w = BitWriter()
    for k, x in enumerate(channels):
        own = bits + (assignment in (8, 10) and k == 1 or assignment == 9 and k == 0)
        kind = (kinds or ["verbatim"])[k % len(kinds or [1])]
        if kind == "constant":
            w.put(0, 8)
            w.put(x[0], own)
        elif kind == "verbatim":
            w.put(1 << 1, 8)
            for v in x:
                w.put(v, own)
        else:
            order = 2 if kind == "fixed" else 1
            w.put((8 + order if kind == "fixed" else 32) << 1, 8)
            for v in x[:order]:
                w.put(v, own)
            if kind == "fixed":
                rest = [x[i] - 2 * x[i - 1] + x[i - 2] for i in range(2, n)]
            else:
                w.put(5, 4)
                w.put(2, 5)
                w.put(3, 6)
                rest = [x[i] - (3 * x[i - 1] >> 2) for i in range(1, n)]
            w.put(0, 2)
            w.put(0, 4)
            w.put(3, 4)
            for r in rest:
                u = r << 1 if r >= 0 else (-r << 1) - 1
                w.put(1, (u >> 3) + 1)
                w.put(u & 7, 3)
    body = head + w.bytes()
    return body + struct.pack(">H", crc16(body))


def flac(frames: list[bytes], rate=44100, channels=2, bits=16, total=0, seek=()):
    info = struct.pack(">HH", 16, 65535) + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | total).to_bytes(8, "big") + bytes(16)
    points = b"".join(struct.pack(">QQH", *p) for p in seek)
    comment = struct.pack("<I", 1) + b"v" + struct.pack("<I", 1) + struct.pack("<I", 7) + b"TITLE=x"
    out = b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\3" + len(points).to_bytes(3, "big") + points + b"\x84" + len(comment).to_bytes(3, "big") + comment
    return out + b"".join(frames)


def box(kind: bytes, body: bytes, wide=False):
    return (struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) if wide else struct.pack(">I", len(body) + 8) + kind) + body


def full(kind, body, version=0):
    return box(kind, bytes([version, 0, 0, 0]) + body)


def table(kind, rows, width=4, version=0):
    return full(kind, struct.pack(">I", len(rows)) + b"".join(int(v).to_bytes(width, "big", signed=v < 0) for r in rows for v in (r if isinstance(r, tuple) else (r,))), version)


def mp4_track(number, handler, entry, scale, tables):
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1) + entry) + b"".join(tables))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, scale, 0) + bytes(4))
    mdia = box(b"mdia", mdhd + full(b"hdlr", bytes(4) + handler + bytes(12)) + box(b"minf", stbl))
    return box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, number) + bytes(68)) + mdia)


def visual(kind, width, height, inner=b""):
    return box(kind, bytes(6) + b"\0\1" + bytes(16) + struct.pack(">HH", width, height) + bytes(50) + inner)


def sound(kind, channels, bits, rate, inner=b""):
    return box(kind, bytes(6) + b"\0\1" + bytes(8) + struct.pack(">HHHHI", channels, bits, 0, 0, rate << 16) + inner)


def ogg_page(serial, granule, flags, packets: list[bytes], seq=0):
    sizes = b"".join(bytes([255] * (len(p) // 255) + [len(p) % 255]) for p in packets)
    return b"OggS\0" + bytes([flags]) + struct.pack("<qiII", granule, serial, seq, 0) + bytes([len(sizes)]) + sizes + b"".join(packets)


def mp3_frame(body=b"", second=0xFB, third=0x90, fourth=0x00):
    return (bytes([0xFF, second, third, fourth]) + body).ljust(417, b"\0")


def tiff(order, width, height, photo, channels, data, compression=1):
    e = "<" if order == "II" else ">"
    fields = [(256, 3, width), (257, 3, height), (258, 3, 8), (259, 3, compression), (262, 3, photo), (273, 4, 8), (277, 3, channels), (278, 3, height), (279, 4, len(data))]
    body = struct.pack(e + "H", len(fields))
    for tag, kind, v in fields:
        body += struct.pack(e + "HHI", tag, kind, 1) + (struct.pack(e + "H", v) + b"\0\0" if kind == 3 else struct.pack(e + "I", v))
    return order.encode() + struct.pack(e + "HI", 42, 8 + len(data)) + data + body + bytes(4)


def webp(frames: list[int]):
    body = b"WEBPVP8X" + struct.pack("<I", 10) + bytes([2, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    for d in frames:
        body += b"ANMF" + struct.pack("<I", 16) + bytes(12) + d.to_bytes(3, "little") + b"\0"
    return b"RIFF" + struct.pack("<I", len(body)) + body


def jpeg(width, height, sof=0xC0):
    return b"\xff\xd8\xff\xe0\0\4ab\xff" + bytes([sof]) + struct.pack(">HBHH", 11, 8, height, width) + bytes(6)
