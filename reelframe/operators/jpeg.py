"""JPEG pictures in NumPy: baseline and progressive Huffman files to RGBA.

Entropy-coded bits are read in sequence into coefficients; everything after
(dequantisation, inverse DCT, upsampling, colours) works on whole planes.
"""

from __future__ import annotations

import numpy as np

from reelframe.sources.containers import Malformed, big

#: Place in a row-major block of each coefficient in file order: diagonals, in turn up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_WAVE = np.arange(8)
DCT = (np.cos((2 * _WAVE[None, :] + 1) * _WAVE[:, None] * np.pi / 16) / 2 * np.where(_WAVE == 0, np.sqrt(0.5), 1)[:, None]).astype(np.float32)
#: Block rows that are transformed at once.
ROWS = 32


def _need(ok: bool, code: int = 4005) -> None:
    if not ok:
        raise Malformed(code)


def code_table(counts: bytes, symbols: bytes) -> memoryview:
    """For each 16 bits ahead: 256 x the code's length plus its symbol; 0 if no code begins so."""
    table, code, at = np.zeros(1 << 16, np.uint16), 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            span = 1 << 16 - length
            _need(code + span <= 1 << 16 and at < len(symbols))
            table[code : code + span] = length << 8 | symbols[at]
            code, at = code + span, at + 1
    return memoryview(table)


def segments(b: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded parts between restart markers, unstuffed, and where the next other marker is."""
    parts, begin, i = [], at, at
    while True:
        j = b.find(b"\xff", i)
        if j < 0 or j + 1 >= len(b):
            end = len(b)
            break
        if b[j + 1] == 0:
            i = j + 2
        elif 0xD0 <= b[j + 1] <= 0xD7:
            parts.append(b[begin:j])
            begin = i = j + 2
        elif b[j + 1] == 0xFF:
            i = j + 1
        else:
            end = j
            break
    return [p.replace(b"\xff\0", b"\xff") for p in [*parts, b[begin:end]]], end


class Bits:
    """A reader of one part; zeros follow its end."""

    def __init__(self, part: bytes) -> None:
        raw = np.frombuffer(part + bytes(600), np.uint8).astype(np.int32)
        self.ahead = memoryview(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])
        self.at, self.end = 0, 8 * len(part)

    def bits(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return self.ahead[at >> 3] >> 24 - (at & 7) - n & (1 << n) - 1

    def symbol(self, table: memoryview) -> int:
        at = self.at
        found = table[self.ahead[at >> 3] >> 8 - (at & 7) & 0xFFFF]
        _need(found > 0)
        self.at = at + (found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v if v >> n - 1 else v - (1 << n) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int) -> None:
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.table: np.ndarray | None = None

    def lay_out(self, width: int, height: int, h_most: int, v_most: int) -> None:
        self.width, self.height = -(-width * self.h // h_most), -(-height * self.v // v_most)
        self.across, self.down = -(-width // (8 * h_most)) * self.h, -(-height // (8 * v_most)) * self.v
        self.coefficients = np.zeros(self.across * self.down * 64, np.int16)

    def plane(self) -> np.ndarray:
        """Samples of the component's own size."""
        _need(self.table is not None)
        blocks, out = self.coefficients.reshape(self.down, self.across, 64), []
        for k in range(0, self.down, ROWS):
            part = blocks[k : k + ROWS]
            x = np.empty(part.shape, np.float32)
            x[:, :, ZIGZAG] = part * self.table.astype(np.float32)
            y = DCT.T @ x.reshape(*part.shape[:2], 8, 8) @ DCT
            out.append(np.clip(np.rint(y + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(len(part) * 8, -1))
        return np.concatenate(out)[: self.height, : self.width]


def ac_first(r: Bits, table: memoryview, out: memoryview, base: int, first: int, last: int, low: int, run: int, progressive: bool) -> int:
    """Coefficients first to last of a block; returns how many more blocks end here."""
    if run:
        return run - 1
    k = first
    while k <= last:
        zeros, size = divmod(r.symbol(table), 16)
        if size:
            k += zeros
            _need(k <= 63)
            out[base + k] = r.signed(size) << low
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + r.bits(zeros) - 1 if progressive else 0
    return 0


def ac_more(r: Bits, table: memoryview, out: memoryview, base: int, first: int, last: int, low: int, run: int) -> int:
    """One more bit of coefficients first to last; returns as ac_first()."""
    one, k = 1 << low, first

    def past(zeros: int) -> None:
        """Moves k to the zero after so many zeros, and gives what it passes its next bit."""
        nonlocal k
        while k <= last:
            v = out[base + k]
            if v:
                if r.bits(1) and not abs(v) & one:
                    out[base + k] = v + one if v > 0 else v - one
            elif zeros == 0:
                return
            else:
                zeros -= 1
            k += 1

    if not run:
        while k <= last:
            zeros, size = divmod(r.symbol(table), 16)
            if not size and zeros < 15:
                run = (1 << zeros) + r.bits(zeros)
                break
            value = (one if r.bits(1) else -one) if size else 0
            past(zeros)
            if value and k <= last:
                out[base + k] = value
            k += 1
    if run:
        past(64)
        run -= 1
    return run


def scan(b: bytes, at: int, parts: list[bytes], components: list[Component], tables: dict, interval: int, progressive: bool) -> None:
    """One scan, whose header is at `at`, into the coefficients. What a file that is cut short lacks stays as it was."""
    n = b[at]
    mine = [(next((c for c in components if c.ident == b[at + 1 + 2 * k]), None), b[at + 2 + 2 * k]) for k in range(n)]
    _need(1 <= n <= 4 and all(c for c, _ in mine))
    first, last, high, low = b[at + 1 + 2 * n], b[at + 2 + 2 * n], b[at + 3 + 2 * n] >> 4, b[at + 3 + 2 * n] & 15
    if not progressive:
        first, last, high, low = 0, 63, 0, 0
    _need(first <= last <= 63 and (not progressive or (last == 0 if first == 0 else n == 1)))
    spaces = []
    for c, t in mine:
        out = memoryview(c.coefficients)
        spaces.append((c, out, tables.get((0, t >> 4)), tables.get((1, t & 15))))
        _need((first > 0 or high > 0 or spaces[-1][2] is not None) and (last == 0 or spaces[-1][3] is not None))
    if n == 1:  # the component's own blocks, without those that only fill up an MCU
        across, down = -(-mine[0][0].width // 8), -(-mine[0][0].height // 8)
        shape = [[(0, 0)]]
    else:
        across, down = mine[0][0].across // mine[0][0].h, mine[0][0].down // mine[0][0].v
        shape = [[(y, x) for y in range(c.v) for x in range(c.h)] for c, _ in mine]
    total = across * down
    for number, part in enumerate(parts):
        r, dc, run = Bits(part), [0] * n, 0
        begin = number * interval
        for unit in range(begin, min(total, begin + interval) if interval else total):
            row, column = divmod(unit, across)
            for k, (c, out, t_dc, t_ac) in enumerate(spaces):
                h, v = (c.h, c.v) if n > 1 else (1, 1)
                for y, x in shape[k]:
                    base = 64 * ((row * v + y) * c.across + column * h + x)
                    if first == 0 and high:
                        out[base] |= r.bits(1) << low
                    elif first == 0:
                        size = r.symbol(t_dc)
                        _need(size <= 15)
                        dc[k] += r.signed(size) if size else 0
                        out[base] = dc[k] << low
                    if last and high:
                        run = ac_more(r, t_ac, out, base, first, last, low, run)
                    elif last:
                        run = ac_first(r, t_ac, out, base, max(first, 1), last, low, run, progressive)
            if r.at > r.end:
                break
        if not interval:
            break


def doubled(x: np.ndarray, axis: int, biases: tuple[int, int], shift: int) -> np.ndarray:
    """Twice the samples along an axis: three parts of the nearer and one of the further; edges repeat."""
    x = np.moveaxis(x, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.stack([3 * x + before + biases[0] >> shift, 3 * x + after + biases[1] >> shift], 1)
    return np.moveaxis(out.reshape(2 * len(x), *x.shape[1:]), 0, axis)


def upsampled(x: np.ndarray, across: int, down: int) -> np.ndarray:
    """Samples at the picture's size, by triangles where a side doubles and by repeating elsewhere."""
    wide = x.shape[1] > 2
    x = x.astype(np.int32)
    if across == 2 and down == 2 and wide:
        return doubled(doubled(x, 0, (0, 0), 0), 1, (8, 7), 4)
    if across == 2 and down == 1 and wide:
        return doubled(x, 1, (1, 2), 2)
    if across == 1 and down == 2:
        return doubled(x, 0, (1, 2), 2)
    return x.repeat(down, 0).repeat(across, 1)


def rgb_of(planes: list[np.ndarray], plain: bool) -> np.ndarray:
    """RGB of gray, RGB (plain) or YCbCr planes, in 16-bit fixed point."""
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    if plain:
        return np.stack(planes, 2).astype(np.uint8)
    y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    fixed = lambda v: round(v * 65536)
    r = y + (fixed(1.402) * red + 32768 >> 16)
    g = y + (-fixed(0.344136286) * blue - fixed(0.714136286) * red + 32768 >> 16)
    return np.clip(np.stack([r, g, y + (fixed(1.772) * blue + 32768 >> 16)], 2), 0, 255).astype(np.uint8)


def jpeg(b: bytes, most: int = 1 << 26) -> tuple[str, np.ndarray]:
    """RGBA of 8-bit baseline, extended and progressive Huffman files of 1 or 3 components; other kinds are error 4002, four components 4005.

    The inverse DCT is computed in floating point, so samples may differ by one
    from an integer one. A file that is cut short keeps what it has; one that
    claims more blocks than it has bits is an error.
    """
    _need(b[:2] == b"\xff\xd8", 3003)
    quants, tables, components, interval, adobe, jfif, progressive, at, size = {}, {}, [], 0, None, False, False, 2, None
    seen = False
    while at + 4 <= len(b):
        marker = b[at + 1]
        if b[at] != 0xFF or marker == 0xFF or marker in (0, 1, *range(0xD0, 0xD9)):
            at += 1 if b[at] != 0xFF or marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        begin, end = at + 4, at + 2 + big(b, at + 2, 2)
        at = max(end, begin)
        if marker == 0xDB:
            while begin < end:
                wide, k = b[begin] >> 4, b[begin] & 15
                kind = ">u2" if wide else "u1"
                quants[k] = np.frombuffer(b, kind, 64, begin + 1).astype(np.int32)
                begin += 129 if wide else 65
        elif marker == 0xC4:
            while begin < end:
                counts = b[begin + 1 : begin + 17]
                tables[b[begin] >> 4, b[begin] & 15] = code_table(counts, b[begin + 17 : begin + 17 + sum(counts)])
                begin += 17 + sum(counts)
        elif marker == 0xDD:
            interval = big(b, begin, 2)
        elif marker == 0xE0 and b[begin : begin + 5] == b"JFIF\0":
            jfif = True
        elif marker == 0xEE and b[begin : begin + 5] == b"Adobe" and end - begin >= 12:
            adobe = b[begin + 11]
        elif marker in (0xC0, 0xC1, 0xC2):
            _need(size is None)
            _need(b[begin] == 8, 4002)
            progressive, size = marker == 0xC2, (big(b, begin + 3, 2), big(b, begin + 1, 2))
            width, height = size
            _need(width > 0 and height > 0)
            _need(width * height <= most, 4002)
            components = [Component(b[k], b[k + 1] >> 4, b[k + 1] & 15, b[k + 2]) for k in range(begin + 6, begin + 6 + 3 * b[begin + 5], 3)]
            _need(len(components) in (1, 3) and all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in components))
            h_most, v_most = max(c.h for c in components), max(c.v for c in components)
            _need(all(h_most % c.h == 0 and v_most % c.v == 0 for c in components), 4002)
            _need(sum(-(-width // (8 * h_most)) * c.h * -(-height // (8 * v_most)) * c.v for c in components) <= 8 * len(b))
            for c in components:
                c.lay_out(width, height, h_most, v_most)
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            _need(False, 4002)
        elif marker == 0xDA:
            _need(size is not None)
            parts, at = segments(b, end)
            for c in components:  # a component keeps the table of its first scan
                if c.table is None and c.quant in quants:
                    c.table = quants[c.quant]
            scan(b, begin, parts, components, tables, interval, progressive)
            seen = True
    _need(seen)
    planes = [upsampled(c.plane(), h_most // c.h, v_most // c.v)[:height, :width] for c in components]
    plain = len(planes) == 3 and not jfif and (adobe == 0 if adobe is not None else bytes(c.ident for c in components) == b"RGB")
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = rgb_of(planes, plain)
    return "rgba", out
