"""Picture decoders against files that the JVM's ImageIO writes, and its own reading of them."""

import struct
import zlib

import numpy as np
import pytest

from reelframe.operators import decode, pictures
from reelframe.operators.jpeg import jpeg, rgb_of, upsampled
from reelframe.sources import demux, sinks
from reelframe.sources.containers import Malformed
from reelframe.sources.sinks import png_bytes


def pixels(height, width, channels=4):
    """Smooth colours with an edge and some noise."""
    y, x = np.mgrid[:height, :width]
    out = np.stack([120 + 100 * np.sin(x / 7), 250.0 * y / height, 128 + 60 * np.cos((x + y) / 9)], 2) + np.random.default_rng(height * width).normal(0, 4, (height, width, 3))
    out[height // 3 : height // 2, width // 4 : width // 2] = (250, 20, 30)
    rgb = np.clip(out, 0, 255).astype(np.uint8)
    return np.concatenate([rgb, np.full((height, width, 1), 255, np.uint8)], 2) if channels == 4 else rgb[:, :, :1]


class Java:
    def __init__(self, spark):
        self.j = spark.sparkContext._jvm
        self.io = self.j.javax.imageio.ImageIO

    def read(self, content):
        return self.io.read(self.j.java.io.ByteArrayInputStream(content))

    def image(self, x, kind=5):
        """A BufferedImage, of kind 5 (colours) or 10 (gray)."""
        height, width, channels = x.shape
        own = self.read(png_bytes(np.ascontiguousarray(x).tobytes(), width, height, channels))
        out = self.j.java.awt.image.BufferedImage(width, height, kind)
        out.getRaster().setRect(own.getRaster().createChild(0, 0, width, height, 0, 0, self.bands(channels)))
        return out

    def bands(self, channels):
        n = 3 if channels == 4 else 1
        array = self.gateway.new_array(self.j.int, n)
        for k in range(n):
            array[k] = k
        return array

    def write(self, image, form, progressive=False, compression=None):
        writer = self.io.getImageWritersByFormatName(form).next()
        param = writer.getDefaultWriteParam()
        if progressive:
            param.setProgressiveMode(1)
        if compression:
            param.setCompressionMode(2)
            param.setCompressionType(compression)
        out = self.j.java.io.ByteArrayOutputStream()
        stream = self.io.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, self.j.javax.imageio.IIOImage(image, None, None), param)
        stream.flush()
        return bytes(out.toByteArray())

    def rgba(self, content):
        x = pictures.png(self.write(self.read(content), "png"))[1]
        return np.concatenate([np.repeat(x, 3, 2), np.full((*x.shape[:2], 1), 255, np.uint8)], 2) if x.shape[2] == 1 else x


@pytest.fixture(scope="module")
def java(spark):
    out = Java(spark)
    out.gateway = spark.sparkContext._gateway
    return out


@pytest.mark.parametrize("size", [(48, 64), (37, 51), (8, 8), (1, 1), (17, 3)])
@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("channels", [4, 1])
def test_jpeg_equals_another_reader(java, size, progressive, channels):
    content = java.write(java.image(pixels(*size, channels), 5 if channels == 4 else 10), "jpeg", progressive)
    assert (b"\xff\xc2" in content) == progressive
    name, x = jpeg(content)
    want = java.rgba(content)
    assert name == "rgba" and x.shape == want.shape
    off = np.abs(x.astype(int) - want)
    assert off.max() <= 3 and off.mean() < 0.2


def test_jpeg_cut_short_or_broken(java):
    content = java.write(java.image(pixels(64, 64)), "jpeg")
    whole = jpeg(content)[1]
    half = jpeg(content[:-60])[1]
    assert half.shape == whole.shape and (half[:30] == whole[:30]).all() and (half != whole).any()
    at = content.index(b"\xff\xc0")
    for wrong, code in [(b"", 3003), (content[:at], 4005), (content[:at] + content[at:].replace(b"\xff\xc0", b"\xff\xc9", 1), 4002), (content[: at + 5] + b"\x1f\xff\x1f\xff" + content[at + 9 :], 4005), (content[: at + 5] + b"\xff\xff\xff\xff" + content[at + 9 :], 4002)]:
        with pytest.raises(Malformed) as e:
            jpeg(wrong)
        assert e.value.code == code


def test_jpeg_restarts():
    """Gray blocks of one DC difference each, with a restart after every block."""
    table = lambda kind, counts, symbols: struct.pack(">HB", 19 + len(symbols), kind) + bytes(counts) + bytes(symbols)
    dc, ac = table(0, [0, 1] + [0] * 14, [4]), table(0x10, [1] + [0] * 15, [0])
    bits = [f"00{v:04b}0" for v in (8, 15, 12)]  # DC category 4, its bits, end of block
    parts = [int((x + "1" * 8)[:8], 2).to_bytes(1, "big").replace(b"\xff", b"\xff\0") for x in bits]
    head = b"\xff\xd8\xff\xdb\0\x43\0" + bytes([8] * 64) + b"\xff\xc0\0\x0b\x08" + struct.pack(">HHB", 8, 24, 1) + b"\1\x11\0" + b"\xff\xc4" + dc + b"\xff\xc4" + ac + b"\xff\xdd\0\4\0\1"
    body = b"\xff\xda\0\x08\1\1\0\0\x3f\0" + parts[0] + b"\xff\xd0" + parts[1] + b"\xff\xd1" + parts[2] + b"\xff\xd9"
    x = jpeg(head + body)[1]
    assert [x[0, 8 * k, 0] for k in range(3)] == [136, 143, 140] and (x[:, :8, :3] == 136).all() and (x[:, :, 3] == 255).all()


def test_upsampling_and_plain_colours():
    x = np.array([[0, 40, 80, 120]], np.uint8)
    assert upsampled(x, 2, 1).tolist() == [[0, 10, 30, 50, 70, 90, 110, 120]]
    assert upsampled(x, 2, 2).shape == (2, 8) and upsampled(x[:, :2], 2, 1).tolist() == [[0, 0, 40, 40]] and upsampled(x, 4, 1).shape == (1, 16)
    planes = [np.full((1, 1), v) for v in (10, 20, 30)]
    assert rgb_of(planes, True).tolist() == [[[10, 20, 30]]] and rgb_of([planes[0]], False).tolist() == [[[10, 10, 10]]]


@pytest.mark.parametrize("size", [(20, 33), (9, 8), (1, 1), (3, 2)])
@pytest.mark.parametrize("channels", [4, 1])
def test_interlaced_png(java, size, channels):
    x = pixels(*size, channels)
    content = java.write(java.image(x, 5 if channels == 4 else 10), "png", True)
    assert content[28] == 1 and (pictures.png(content)[1] == x).all()


@pytest.mark.parametrize("compression", ["LZW", "Deflate", "ZLib", "PackBits"])
@pytest.mark.parametrize("channels", [4, 1])
def test_compressed_tiff(java, compression, channels):
    x = pixels(120, 90, channels)
    content = java.write(java.image(x, 5 if channels == 4 else 10), "tiff", compression=compression)
    assert (pictures.tiff(content)[1] == x).all()


def test_broken_pictures_end(java):
    """Whatever a changed byte does, a decoder ends, in a picture or an error."""
    image, rng = java.image(pixels(33, 20)), np.random.default_rng(1)
    kinds = [(jpeg, java.write(image, "jpeg")), (jpeg, java.write(image, "jpeg", True)), (pictures.png, java.write(image, "png", True)), (pictures.tiff, java.write(image, "tiff", compression="LZW"))]
    for decoder, content in kinds:
        for _ in range(60):
            b = bytearray(content)
            for at in rng.integers(0, len(b), 3):
                b[at] = rng.integers(0, 256)
            try:
                assert decoder(bytes(b))[1].ndim == 3
            except (Malformed, IndexError, ValueError, OverflowError, KeyError, TypeError, zlib.error):  # decode() makes each a row
                pass


def test_sink_stays_in_its_folder(spark, tmp_path):
    assert sinks.place_of("/a/b", "file:///x/y.wav") == "/a/b/x/y.wav" and sinks.place_of("/a/b/", "x//y") == "/a/b/x/y" and sinks.place_of("/a", "s3://k/z") == "/a/k/z"
    for path in ("../c", "x/../../c", "..", ""):
        with pytest.raises(ValueError):
            sinks.place_of("/a/b", path)
    files = spark.createDataFrame([("d/a.bin", b"12", 0), ("b.bin", None, 3002)], sinks.FILES)
    for _ in range(2):
        sinks.write_files(files, str(tmp_path))
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["d/a.bin"]


def test_jpeg_files_end_to_end(spark, java):
    content = java.write(java.image(pixels(24, 40)), "jpeg")
    src = demux.sources(spark.createDataFrame([("a.jpg", content), ("b.jpg", content[:200])], "path string, content binary"))
    rows = {r.path: r for r in decode.decode(demux.packets(src), demux.tracks(src)).collect()}
    pic = rows["a.jpg"].picture
    assert (pic.width, pic.height, pic.pixel_format, rows["a.jpg"].error_code) == (40, 24, "rgba", 0) and len(pic.planes[0].data) == 3840
    assert "b.jpg" not in rows or rows["b.jpg"].error_code
