import struct

import numpy as np
import pytest

from reelframe.operators import decode, pictures
from reelframe.sources import demux, sinks
from reelframe.sources.containers import Malformed, audio, bmff, flac, images, matroska
from tests import media


def items(parser, data):
    out = list(parser(data))
    return [x for k, x in out if k == "track"], [x for k, x in out if k == "packet"]


def test_wav():
    data = bytes(range(256)) * 40
    t, p = items(audio.wav, media.wav(data, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    assert t[0]["codec"] == "pcm_s16le" and t[0]["duration"] == len(data) // 4
    assert [(x["pts"], len(x["payload"])) for x in p] == [(0, 4096), (1024, 4096), (2048, 2048)]
    assert b"".join(x["payload"] for x in p) == data
    t, p = items(audio.wav, media.wav(bytes(12), bits=24, channels=1))
    assert t[0]["codec"] == "pcm_s24le" and t[0]["duration"] == 4
    for bad, code in ((b"RIFF", 3003), (media.wav(b""), 3003), (media.wav(b"abcd", tag=2), 3002), (media.wav(b"ab").replace(b"fmt ", b"fmx "), 3003)):
        with pytest.raises(Malformed) as e:
            list(audio.wav(bad))
        assert e.value.code == code


def test_mp3_and_ogg():
    t, p = items(audio.mp3, b"ID3\4\0\0\0\0\0\5abcde" + media.mp3_frame() * 3)
    assert t[0]["audio"]["sample_rate"] == 44100 and [x["pts"] for x in p] == [0, 1152, 2304]
    xing = media.mp3_frame(bytes(32) + b"Xing" + struct.pack(">II", 1, 77))
    assert items(audio.mp3, xing + media.mp3_frame())[0][0]["duration"] == 77 * 1152
    vbri = media.mp3_frame(bytes(32) + b"VBRI" + bytes(10) + struct.pack(">I", 55))
    assert items(audio.mp3, vbri + media.mp3_frame())[0][0]["duration"] == 55 * 1152
    head = b"OpusHead" + bytes([1, 2, 0, 0]) + struct.pack("<I", 44100) + bytes(3)
    vorbis = b"\1vorbis" + bytes(4) + bytes([2]) + struct.pack("<III", 22050, 0, 64000) + bytes(8)
    data = media.ogg_page(5, 0, 2, [head]) + media.ogg_page(9, 0, 2, [vorbis]) + media.ogg_page(5, 960, 0, [b"x" * 255, b"y" * 600])
    t, p = items(audio.ogg, data)
    assert [(x["codec"], x["id"]) for x in t] == [("opus", 5), ("vorbis", 9)]
    assert [(x["stream_index"], len(x["payload"]), x["pts"]) for x in p] == [(0, 19, 0), (1, len(vorbis), 0), (0, 255, -1), (0, 600, 960)]


def blocks():
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.integers(-9, 10, 64)).tolist()
    other = np.cumsum(rng.integers(-9, 10, 64)).tolist()
    return walk, other


def test_flac_decodes_every_kind_of_subframe():
    a, b = blocks()
    side = [x - y for x, y in zip(a, b, strict=True)]
    mid = [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    frames = [
        media.flac_frame(0, [a, b], kinds=["verbatim", "fixed"]), media.flac_frame(1, [a, b], kinds=["lpc", "fixed"]), media.flac_frame(2, [[7] * 64, [-3] * 64], kinds=["constant"]),
        media.flac_frame(3, [a, side], mode=8, kinds=["fixed"]), media.flac_frame(4, [side, b], mode=9, kinds=["fixed"]), media.flac_frame(5, [mid, side], mode=10, kinds=["fixed"]),
    ]
    bad = bytearray(media.flac_frame(6, [a, b]))
    bad[20] ^= 1
    data = media.flac([*frames[:3], bytes(bad), *frames[3:]], total=384, seek=[(0, 0, 64), (64, 99, 64)])
    t, p = items(flac.flac, data)
    assert t[0]["metadata"] == {"title": "x"} and len(p) == 6 and [x["pts"] for x in p] == [0, 64, 128, 192, 256, 320]
    want = [(a, b), (a, b), ([7] * 64, [-3] * 64), (a, b), (a, b), (a, b)]
    for x, (l, r) in zip(p, want, strict=True):
        (pts, frame), = decode.flac_frames(x["payload"], t[0]["extradata"], x["pts"])
        assert pts == x["pts"] and frame["planar"] and [np.frombuffer(c, "<i4").tolist() for c in frame["planes"]] == [l, r]
    assert flac.metadata(data)[0]["seek_points"] == [(0, 0, 64), (64, 99, 64)]


def mp4(wide=False):
    avcc = bytes([1, 100, 0, 31, 0xFF, 0xE1, 0, 3]) + b"SPS" + bytes([1, 0, 2]) + b"PP"
    unit = lambda s: struct.pack(">I", len(s)) + s
    video = [unit(b"key"), unit(b"p1") + unit(b""), unit(b"p22")]
    sounds = [b"aaaa", b"bb", b"c", b"dd"]
    head = media.box(b"ftyp", b"isom" + bytes(4))

    def build(base):
        offsets, at = [], base
        for part in (video[0], sounds[0] + sounds[1], video[1] + video[2], sounds[2] + sounds[3]):
            offsets.append(at)
            at += len(part)
        colour = media.box(b"colr", b"nclx" + struct.pack(">HHHB", 9, 16, 9, 0))
        v = media.mp4_track(
            1, b"vide", media.visual(b"avc1", 64, 48, media.box(b"avcC", avcc) + colour), 1000,
            [media.table(b"stts", [(0, 99), (3, 40)]), media.table(b"ctts", [(1, 0), (2, 80)]), media.table(b"stsc", [(1, 1, 1), (2, 2, 1)]), media.full(b"stsz", struct.pack(">II", 0, 3) + b"".join(struct.pack(">I", len(x)) for x in video)), media.table(b"stco", [offsets[0], offsets[2]]), media.table(b"stss", [1])],
        )
        esds = media.full(b"esds", bytes([3, 25, 0, 1, 0, 4, 17]) + bytes(13) + bytes([5, 2, 0x12, 0x10, 6, 1, 2]))
        a = media.mp4_track(
            2, b"soun", media.sound(b"mp4a", 2, 16, 22050, esds), 44100,
            [media.table(b"stts", [(4, 1024)]), media.table(b"stsc", [(1, 2, 1)]), media.full(b"stz2", bytes([0, 0, 0, 4]) + struct.pack(">I", 4) + bytes([0x42, 0x12])), media.table(b"co64", [offsets[1], offsets[3]], 8)],
        )
        return media.box(b"moov", v + a, wide)

    moov = build(0)
    start = len(head) + len(moov) + 8
    return head + build(start) + media.box(b"mdat", b"".join([video[0], *sounds[:2], *video[1:], *sounds[2:]]))


@pytest.mark.parametrize("wide", [False, True])
def test_mp4(wide):
    t, p = items(bmff.bmff, mp4(wide))
    assert [(x["type"], x["codec"], x["nb_frames"]) for x in t] == [("video", "h264", 3), ("audio", "aac", 4)]
    assert t[0]["video"]["color_space"] == "bt2020" and t[0]["video"]["transfer"] == "smpte2084" and t[0]["profile"] == 100
    assert t[1]["audio"]["sample_rate"] == 44100 and t[1]["profile"] == 2
    start = b"\0\0\0\1"
    assert [x["payload"] for x in p] == [start + b"SPS" + start + b"PP" + start + b"key", b"aaaa", b"bb", start + b"p1", start + b"p22", b"c", b"dd"]
    assert [(x["stream_index"], x["dts"], x["pts"], x["is_keyframe"]) for x in p][:5] == [(0, 0, 0, True), (1, 0, 0, True), (1, 1024, 1024, True), (0, 40, 120, False), (0, 80, 160, False)]
    assert t[0]["duration"] == 200 and t[1]["duration"] == 4096
    with pytest.raises(Malformed):
        list(bmff.bmff(b"\0\0\0\4ftyp"))


def test_audio_configs():
    assert bmff.audio_config(bytes([0x12, 0x10])) == {"profile": 2, "sample_rate": 44100, "channels": 2}
    w = media.BitWriter()
    for v, n in ((29, 5), (6, 4), (1, 4), (3, 4), (2, 5), (0, 3)):
        w.put(v, n)
    assert bmff.audio_config(w.bytes()) == {"profile": 29, "sample_rate": 48000, "channels": 2}
    w = media.BitWriter()
    for v, n in ((2, 5), (6, 4), (2, 4), (0, 3), (0x2B7, 11), (5, 5), (1, 1), (3, 4)):
        w.put(v, n)
    assert bmff.audio_config(w.bytes()) == {"profile": 5, "sample_rate": 48000, "channels": 2}


def test_merge_is_the_k_way_one():
    rng = np.random.default_rng(7)
    for _ in range(300):
        runs = [rng.integers(0, 12, rng.integers(0, 6)) for _ in range(rng.integers(1, 4))]
        heads, want = [0] * len(runs), []
        while any(h < len(r) for h, r in zip(heads, runs, strict=True)):
            k = min((k for k, r in enumerate(runs) if heads[k] < len(r)), key=lambda k: (runs[k][heads[k]], k))
            want.append((k, heads[k]))
            heads[k] += 1
        assert bmff.merged(runs) == want


def test_matroska_round_trip_and_lacing():
    tracks = [{"type": "video", "codec": "h264", "extradata": b"x", "video": {"width": 64, "height": 48}}, {"type": "audio", "codec": "opus", "audio": {"sample_rate": 48000, "channels": 2, "bit_depth": 0}}]
    data = matroska.write(tracks, [(0, 0, True, b"a"), (1, 5_000_000, True, b"bb"), (0, 40_000_000, False, b"ccc"), (1, 70_000_000_000, True, b"d")])
    t, p = items(matroska.matroska, data)
    assert [(x["codec"], x["id"]) for x in t] == [("h264", 1), ("opus", 2)] and t[0]["video"]["width"] == 64 and t[1]["audio"]["sample_rate"] == 48000
    assert [(x["stream_index"], x["pts"], x["is_keyframe"], x["payload"]) for x in p] == [(0, 0, True, b"a"), (1, 5, True, b"bb"), (0, 40, False, b"ccc"), (1, 70000, True, b"d")]
    assert [c[0] for c in matroska.cues(data)] == [0, 70000]
    for mode, head in ((2, b"\1"), (1, b"\1\2"), (3, b"\1\x82")):
        block = b"\x81\0\0" + bytes([mode << 1]) + head + (b"xxyy" if mode == 2 else b"xxyyy")
        segment = matroska.element(matroska.TRACKS, matroska.element(matroska.ENTRY, matroska.number(matroska.NUMBER, 1) + matroska.number(matroska.TYPE, 2) + matroska.element(matroska.CODEC, b"A_OPUS")))
        segment += matroska.element(matroska.CLUSTER, matroska.number(matroska.TIME, 9) + matroska.element(matroska.SIMPLE, block))
        got = items(matroska.matroska, matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, segment))[1]
        assert [(x["payload"], x["pts"]) for x in got] == [(b"xx", 9), (b"yy" if mode == 2 else b"yyy", 9)]
    with pytest.raises(Malformed):
        matroska.write([{"type": "image", "codec": "png"}], [])


RGB = bytes(range(3 * 5 * 4))


def test_image_headers_and_decoders():
    rows = [RGB[y * 15 : y * 15 + 15] for y in range(4)]
    want = pictures.opaque(np.frombuffer(RGB, np.uint8).reshape(4, 5, 3))
    for filters in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4]):
        assert (pictures.png(media.png(5, 4, 8, 2, rows, filters))[1] == want).all()
    wide = [b"".join(bytes([v, 9]) for v in r) for r in rows]
    assert (pictures.png(media.png(5, 4, 16, 2, wide, [4]))[1] == want).all()
    name, x = pictures.png(media.png(5, 2, 1, 0, [b"\xa8", b"\x50"]))
    assert name == "gray8" and x[:, :, 0].tolist() == [[255, 0, 255, 0, 255], [0, 255, 0, 255, 0]]
    x = pictures.png(media.png(2, 1, 8, 3, [b"\1\0"], palette=b"\1\2\3\4\5\6", clear=b"\x80"))[1]
    assert x.tolist() == [[[4, 5, 6, 255], [1, 2, 3, 128]]]
    assert pictures.png(media.png(1, 1, 8, 4, [b"\7\1"]))[1].tolist() == [[[7]]]
    swap = lambda r: np.frombuffer(r, np.uint8).reshape(-1, 3)[:, ::-1].tobytes()
    up = media.bmp(5, 4, 24, [swap(r) for r in rows[::-1]])
    assert (pictures.bmp(up)[1] == want).all() and (pictures.bmp(media.bmp(5, -4, 24, [swap(r) for r in rows]))[1] == want).all()
    palette = b"".join(bytes([3 * k, 2 * k, k, 0]) for k in range(16))
    for bits, row in ((8, bytes([1, 2, 3])), (4, bytes([0x12, 0x30]))):
        assert pictures.bmp(media.bmp(3, -1, bits, [row], palette))[1].tolist() == [[[k, 2 * k, 3 * k, 255] for k in (1, 2, 3)]]
    assert pictures.bmp(media.bmp(2, -1, 16, [struct.pack("<HH", 0x7C00, 0x03E1)]))[1].tolist() == [[[248, 0, 0, 255], [0, 248, 8, 255]]]
    rle = bytes([2, 5, 0, 0, 0, 3, 1, 2, 3, 0, 0, 1])
    assert pictures.bmp(media.bmp(3, 2, 8, [], palette, 1, rle))[1][:, :, 0].tolist() == [[1, 2, 3], [5, 5, 0]]
    assert pictures.bmp(media.bmp(4, 1, 4, [], palette, 2, bytes([4, 0x12, 0, 1])))[1][:, :, 0].tolist() == [[1, 2, 1, 2]]
    bgr = b"".join(swap(r) for r in rows)
    assert (pictures.tga(media.tga(2, 5, 4, 24, bgr, 32))[1] == want).all() and (pictures.tga(media.tga(2, 5, 4, 24, bgr))[1][::-1] == want).all()
    packed = b"\x82" + swap(rows[0])[:3] + b"\1" + swap(rows[0])[:6]
    assert pictures.tga(media.tga(10, 5, 1, 24, packed, 32))[1][0, :, 0].tolist() == [0, 0, 0, 0, 3]
    assert pictures.tga(media.tga(11, 4, 1, 8, b"\x81\7\1\1\2"))[1][0, :, 0].tolist() == [7, 7, 1, 2]
    colours = b"".join(bytes([k, k * 2, k * 3]) for k in range(8))
    index = bytes((x + y) % 8 for y in range(9) for x in range(5))
    for laced in (False, True):
        one, two = pictures.gif(media.gif(5, 9, colours, [(0, 0, 5, 9, index, laced, None), (1, 1, 2, 2, b"\1\2\3\4", False, 3)]))
        assert one[:, :, 0].tobytes() == index and two[1, 1].tolist() == [1, 2, 3, 255] and two[2, 1].tolist() == [0, 0, 0, 0] and two[0, 0, 3] == 0
    for order in ("II", "MM"):
        assert (pictures.tiff(media.tiff(order, 5, 4, 2, 3, RGB))[1] == want).all()
        assert pictures.tiff(media.tiff(order, 3, 1, 0, 1, b"\0\1\xff"))[1].tolist() == [[[255], [254], [0]]]
    assert pictures.tiff(media.tiff("II", 4, 1, 1, 1, bytes([254, 9, 0, 3]), 32773))[1].tolist() == [[[9], [9], [9], [3]]]
    assert pictures.tiff(media.tiff("II", 1, 1, 5, 4, bytes([0, 51, 255, 51])))[1].tolist() == [[[204, 163, 0, 255]]]
    t, p = items(images.webp, media.webp([40, 60, 5]))
    assert t[0]["image"] == {"width": 100, "height": 50} and [x["pts"] for x in p] == [0, 40, 100] and t[0]["duration"] == 105
    for sof in (0xC0, 0xC2):
        assert items(images.jpeg, media.jpeg(640, 480, sof))[0][0]["image"] == {"width": 640, "height": 480}
    assert items(images.gif, media.gif(5, 9, colours, [(0, 0, 5, 9, index, False, None)] * 3))[0][0]["nb_frames"] == 3


def test_tables_end_to_end(spark, tmp_path):
    a, b = blocks()
    pcm = np.arange(5000, dtype="<i2").tobytes()
    files = {
        "a.wav": media.wav(pcm), "b.flac": media.flac([media.flac_frame(0, [a, b])], total=64), "c.png": media.png(5, 1, 8, 2, [RGB[:15]]), "d.mp4": mp4(), "e.bin": b"nothing known", "f.wav": media.wav(b"ab", tag=9), "g.jpg": media.jpeg(8, 9),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    src = demux.sources(demux.read_files(spark, str(tmp_path)))
    name = lambda r: r.path.rsplit("/", 1)[1]
    tracks = demux.tracks(src)
    got = sorted((name(r), r["index"], r.codec, r.error_code) for r in tracks.collect() if r["index"] is not None)
    assert got == [("a.wav", 0, "pcm_s16le", 0), ("b.flac", 0, "flac", 0), ("c.png", 0, "png", 0), ("d.mp4", 0, "h264", 0), ("d.mp4", 1, "aac", 0), ("g.jpg", 0, "jpeg", 0)]
    packets = demux.packets(src)
    assert {(name(r), r.error_code) for r in packets.where("error_code <> 0").collect()} == {("e.bin", 3001), ("f.wav", 3002)}
    frames = decode.decode(packets, tracks).collect()
    wav = [f for f in frames if name(f) == "a.wav"]
    assert b"".join(f.audio.planes[0] for f in sorted(wav, key=lambda f: f.seq)) == pcm
    assert {(name(f), f.error_code) for f in frames if f.error_code} >= {("d.mp4", 4001), ("g.jpg", 4005), ("e.bin", 3001)}
    still = next(f for f in frames if name(f) == "c.png")
    assert (still.picture.width, still.picture.height, still.picture.planes[0].linesize) == (5, 1, 20)

    out = tmp_path / "out"
    good = packets.where("error_code = 0")
    muxed = sinks.mux_matroska(good.where("path like '%.mp4'"), tracks)
    flat = muxed.withColumn("path", spark_basename())
    sinks.write_files(flat, str(out))
    again = demux.packets(demux.sources(demux.read_files(spark, str(out)))).orderBy("seq").collect()
    first = demux.packets(src).where("path like '%.mp4'").orderBy("seq").collect()
    assert sorted(bytes(x.payload) for x in again) == sorted(bytes(x.payload) for x in first) and {r.error_code for r in muxed.collect()} == {0}
    remade = sinks.mux_wav(good.where("path like '%a.wav'"), tracks).collect()
    assert bytes(remade[0].content) == files["a.wav"]
    assert {r.type for r in demux.boxes(src.where("container = 'mp4'")).collect()} >= {"moov", "trak", "stbl", "stts", "mdat"}


def spark_basename():
    from pyspark.sql import functions as F

    return F.element_at(F.split("path", "/"), -1)


def test_pcm():
    x = decode.pcm("pcm_s24le", bytes([1, 0, 0, 255, 255, 255, 9]), 8000, 1)
    assert np.frombuffer(x["planes"][0], "<i4").tolist() == [1, -1] and x["bits_per_sample"] == 24
    x = decode.pcm("pcm_s16be", bytes([1, 2, 3]), 8000, 1)
    assert np.frombuffer(x["planes"][0], "<i2").tolist() == [258] and x["nb_samples"] == 1
    with pytest.raises(Malformed):
        decode.pcm("pcm_u8", b"", 8000, 1)
