"""Constant dimension tables: codecs, formats, profiles, pixel formats, errors.

They are small and fixed, so joins with them broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Codec, short name, long name, media type. (VC-3 has no entry.)
CODEC_META = [
    ("h261", "H.261", "H.261", "video"),
    ("h262", "H.262", "H.262 / MPEG-2 Video / MPEG-2 Part 2", "video"),
    ("h263", "H.263", "H.263", "video"),
    ("h264", "H.264 / AVC", "H.264 / AVC (Advanced Video Coding) / MPEG-4 Part 10", "video"),
    ("h265", "H.265 / HEVC", "H.265 / HEVC (High Efficiency Video Coding) / MPEG-H Part 2", "video"),
    ("h266", "H.266 / VVC", "H.266 / VVC (Versatile Video Coding) / MPEG-I Part 3", "video"),
    ("evc", "EVC", "EVC (Essential Video Coding) / MPEG-5 Part 1", "video"),
    ("lcevc", "LCEVC", "LCEVC (Low Complexity Enhancement Video Coding) / MPEG-5 Part 2", "video"),
    ("vp8", "VP8", "VP8", "video"),
    ("vp9", "VP9", "VP9", "video"),
    ("av1", "AV1", "AV1 (AOMedia Video 1)", "video"),
    ("mpeg4", "MPEG-4", "MPEG-4 Video", "video"),
    ("prores", "Apple ProRes", "Apple ProRes", "video"),
    ("theora", "Theora", "Theora", "video"),
    ("pcm_u8", "PCM U8", "PCM Unsigned 8-bit", "audio"),
    ("pcm_s16le", "PCM S16LE", "PCM Signed 16-bit Little-Endian", "audio"),
    ("pcm_s32le", "PCM S32LE", "PCM Signed 32-bit Little-Endian", "audio"),
    ("pcm_s16be", "PCM S16BE", "PCM Signed 16-bit Big-Endian", "audio"),
    ("pcm_s32be", "PCM S32BE", "PCM Signed 32-bit Big-Endian", "audio"),
    ("pcm_f32le", "PCM F32LE", "PCM Float 32-bit Little-Endian", "audio"),
    ("pcm_f64le", "PCM F64LE", "PCM Float 64-bit Little-Endian", "audio"),
    ("flac", "FLAC", "Free Lossless Audio Codec", "audio"),
    ("mp2", "MP2", "MPEG Audio Layer II", "audio"),
    ("mp3", "MP3", "MPEG Audio Layer III", "audio"),
    ("aac", "AAC", "Advanced Audio Coding", "audio"),
    ("opus", "Opus", "Opus", "audio"),
    ("vorbis", "Vorbis", "Vorbis", "audio"),
    ("alac", "ALAC", "Apple Lossless Audio Codec", "audio"),
    ("ape", "APE", "Monkey's Audio", "audio"),
    ("wma", "WMA", "Windows Media Audio", "audio"),
    ("dts", "DTS", "DTS Coherent Acoustics", "audio"),
    ("ac3", "AC-3", "Dolby Digital", "audio"),
    ("eac3", "E-AC-3", "Dolby Digital Plus", "audio"),
    ("jpeg", "JPEG", "Joint Photographic Experts Group", "image"),
    ("jpegxl", "JPEG XL", "JPEG XL", "image"),
    ("jpegxr", "JPEG XR", "JPEG Extended Range", "image"),
    ("png", "PNG", "Portable Network Graphics", "image"),
    ("webp", "WebP", "WebP", "image"),
    ("bmp", "BMP", "Bitmap", "image"),
    ("gif", "GIF", "Graphics Interchange Format", "image"),
    ("tiff", "TIFF", "Tagged Image File Format", "image"),
    ("avif", "AVIF", "AV1 Image File Format", "image"),
    ("heic", "HEIC", "High Efficiency Image Format", "image"),
    ("tga", "TGA", "Truevision TGA", "image"),
    ("exr", "EXR", "OpenEXR", "image"),
]

# Codec, profile number, profile name.
PROFILES = [
    ("h264", 66, "Baseline"), ("h264", 578, "Constrained Baseline"), ("h264", 77, "Main"), ("h264", 88, "Extended"),
    ("h264", 100, "High"), ("h264", 110, "High 10"), ("h264", 122, "High 4:2:2"), ("h264", 244, "High 4:4:4 Predictive"),
    ("h265", 1, "Main"), ("h265", 2, "Main 10"), ("h265", 3, "Main Still Picture"), ("h265", 4, "Range Extensions"),
    ("h266", 1, "Main 10"), ("h266", 33, "Main 10 4:4:4"),
    ("vp9", 0, "Profile 0"), ("vp9", 1, "Profile 1"), ("vp9", 2, "Profile 2"), ("vp9", 3, "Profile 3"),
    ("av1", 0, "Main"), ("av1", 1, "High"), ("av1", 2, "Professional"),
    ("prores", 0, "Proxy"), ("prores", 1, "LT"), ("prores", 2, "422"), ("prores", 3, "422 HQ"), ("prores", 4, "4444"), ("prores", 5, "4444 XQ"),
    ("aac", 1, "Main"), ("aac", 2, "LC"), ("aac", 3, "SSR"), ("aac", 4, "LTP"), ("aac", 5, "HE-AAC"), ("aac", 23, "LD"),
    ("aac", 29, "HE-AAC v2"), ("aac", 39, "ELD"), ("aac", 42, "xHE-AAC (USAC)"), ("aac", 128, "MPEG-2 LC"), ("aac", 131, "MPEG-2 HE-AAC"),
]

#: The engine's codec implementations, in order of registration. A codec that
#: only an absent library could decode is listed as disabled.
CODEC_DESCRIPTORS = [
    (codec, name, kind, decode, encode, hardware, enabled)
    for codec, name, kind, decode, encode, hardware, enabled in [
        ("pcm_u8", "pcm_u8", "audio", True, False, False, True),
        ("pcm_s16le", "pcm_s16le", "audio", True, True, False, True),
        ("pcm_s24le", "pcm_s24le", "audio", True, False, False, True),
        ("pcm_s32le", "pcm_s32le", "audio", True, False, False, True),
        ("pcm_f32le", "pcm_f32le", "audio", True, True, False, True),
        ("pcm_f64le", "pcm_f64le", "audio", True, False, False, True),
        ("flac", "flac", "audio", True, False, False, True),
        ("alac", "alac", "audio", True, False, False, False),
        ("mp3", "mp3", "audio", True, False, False, False),
        ("vorbis", "vorbis", "audio", True, False, False, False),
        ("opus", "opus", "audio", True, True, False, False),
        ("aac", "aac", "audio", True, False, False, False),
        ("av1", "av1", "video", True, False, False, False),
        ("h266", "h266", "video", True, False, False, False),
        ("evc", "evc_decoder", "video", True, False, False, False),
        ("evc", "evc_encoder", "video", False, True, False, False),
        ("h264", "h264", "video", True, False, False, False),
        ("h264", "h264_gpu", "video", True, True, True, False),
        ("h265", "h265", "video", True, False, False, False),
        ("h265", "h265_gpu", "video", True, True, True, False),
        ("png", "png", "image", True, False, False, True),
        ("jpeg", "jpeg", "image", True, False, False, True),
        ("webp", "webp", "image", True, False, False, False),
        ("gif", "gif", "image", True, False, False, True),
        ("tga", "tga", "image", True, False, False, True),
        ("bmp", "bmp", "image", True, False, False, True),
        ("tiff", "tiff", "image", True, False, False, True),
    ]
]

#: The engine's formats in order of registration: container, name, can demux, can mux.
FORMAT_DESCRIPTORS = [
    ("mp4", "bmff", True, False), ("mkv", "matroska", True, True), ("mp3", "mp3", True, False), ("wav", "wav", True, True), ("flac", "flac", True, False), ("ogg", "ogg", True, False),
    ("png", "png", True, False), ("jpeg", "jpeg", True, False), ("webp", "webp", True, False), ("gif", "gif", True, False), ("tga", "tga", True, False), ("bmp", "bmp", True, False), ("tiff", "tiff", True, False),
]

# Pixel format, planes, bytes per pixel of the first and the other
# planes, divisors of width and height of the other planes, bits per component.
# (The palette of pal8 is 256 x 1 whatever the picture's size.)
PIXEL_FORMATS = [
    ("rgba", 1, 4, 4, 1, 1, 8), ("bgra", 1, 4, 4, 1, 1, 8), ("yuv420p", 3, 1, 1, 2, 2, 8), ("yuv422p", 3, 1, 1, 2, 1, 8), ("yuv444p", 3, 1, 1, 1, 1, 8),
    ("yuv410p", 3, 1, 1, 4, 4, 8), ("yuv411p", 3, 1, 1, 4, 1, 8), ("yuvj420p", 3, 1, 1, 2, 2, 8), ("yuvj422p", 3, 1, 1, 2, 1, 8), ("yuvj444p", 3, 1, 1, 1, 1, 8),
    ("nv12", 2, 1, 1, 1, 2, 8), ("nv21", 2, 1, 1, 1, 2, 8), ("nv16", 2, 1, 1, 1, 1, 8), ("nv24", 2, 1, 1, 1, 1, 8), ("gray8", 1, 1, 1, 1, 1, 8), ("gray16", 1, 2, 2, 1, 1, 16),
    ("p010", 2, 2, 2, 1, 2, 10), ("p012", 2, 2, 2, 1, 2, 8), ("p016", 2, 2, 2, 1, 2, 16), ("yuv420p10", 3, 2, 2, 2, 2, 10), ("yuv420p12", 3, 2, 2, 2, 2, 12), ("yuv420p16", 3, 2, 2, 2, 2, 16),
    ("yuv422p10", 3, 2, 2, 2, 1, 10), ("yuv422p12", 3, 2, 2, 2, 1, 12), ("yuv422p16", 3, 2, 2, 2, 1, 16), ("yuv444p10", 3, 2, 2, 1, 1, 10), ("yuv444p12", 3, 2, 2, 1, 1, 12), ("yuv444p16", 3, 2, 2, 1, 1, 16),
    ("rgb32", 1, 4, 4, 1, 1, 8), ("rgba64", 1, 8, 8, 1, 1, 16), ("pal8", 2, 1, 4, 1, 1, 8), ("unknown", 1, 1, 1, 1, 1, 8),
]

# Error codes by band of a thousand.
ERRORS = [
    (0, "success"),
    (1000, "common_unknown_error"), (1001, "common_invalid_argument"), (1002, "common_not_initialized"), (1003, "common_not_implemented"), (1004, "common_not_supported"), (1005, "common_out_of_memory"), (1006, "common_overflow"), (1007, "common_timeout"), (1008, "common_cancelled"), (1009, "common_permission_denied"),
    (2000, "io_unknown_error"), (2001, "io_invalid_stream"), (2002, "io_seek_required"), (2003, "io_seek_failed"), (2004, "io_not_enough_data"), (2005, "io_end_of_stream"), (2006, "io_write_failed"), (2007, "io_read_failed"), (2008, "io_open_failed"), (2009, "io_network_error"), (2010, "io_network_timeout"), (2011, "io_network_interrupted"), (2012, "io_protocol_error"),
    (3000, "format_unknown_error"), (3001, "format_detection_failed"), (3002, "format_not_supported"), (3003, "format_invalid_header"), (3004, "format_corrupted"), (3005, "format_end_of_file"), (3006, "format_no_streams"), (3007, "format_stream_not_found"), (3008, "format_invalid_timestamp"), (3009, "format_muxing_failed"), (3010, "format_parse_failed"), (3011, "format_sync_lost"), (3012, "format_invalid_packet"), (3013, "format_missing_keyframe"),
    (4000, "codec_unknown_error"), (4001, "codec_not_found"), (4002, "codec_not_supported"), (4003, "codec_open_failed"), (4004, "codec_invalid_params"), (4005, "codec_decode_failed"), (4006, "codec_encode_failed"), (4007, "codec_need_more_data"), (4008, "codec_flushed"), (4009, "codec_hwaccel_failed"), (4010, "codec_hwaccel_not_found"),
    (5000, "frame_invalid"), (5001, "frame_wrong_format"), (5002, "frame_wrong_size"), (5003, "frame_reorder_overflow"), (5004, "frame_corrupt"),
]
BANDS = ["success", "common", "io", "format", "codec", "frame"]

# Sample entry code of ISO files to codec.
SAMPLE_ENTRIES = [
    ("alac", "alac"), ("mp4a", "aac"), ("MP4A", "aac"), ("ac-3", "ac3"), ("ec-3", "eac3"), ("fLaC", "flac"), ("Opus", "opus"),
    ("raw ", "pcm_u8"), ("twos", "pcm_s16be"), ("sowt", "pcm_s16le"), ("in24", "pcm_s24be"), ("in32", "pcm_s32be"), ("fl32", "pcm_f32be"), ("fl64", "pcm_f64be"),
    ("avc1", "h264"), ("avc2", "h264"), ("avc3", "h264"), ("avc4", "h264"), ("H264", "h264"), ("X264", "h264"),
    ("hvc1", "h265"), ("hev1", "h265"), ("HEVC", "h265"), ("vvc1", "h266"), ("vvi1", "h266"), ("evc1", "evc"),
    ("vp08", "vp8"), ("vp09", "vp9"), ("av01", "av1"), ("mp4v", "mpeg4"),
    ("apco", "prores"), ("apcs", "prores"), ("apcn", "prores"), ("apch", "prores"), ("ap4h", "prores"), ("ap4x", "prores"),
]

# Codec id strings of Matroska to codec.
MATROSKA_CODECS = [
    ("V_MPEG4/ISO/AVC", "h264"), ("V_MPEGH/ISO/HEVC", "h265"), ("V_VP8", "vp8"), ("V_VP9", "vp9"), ("V_AV1", "av1"), ("V_THEORA", "theora"), ("V_PRORES", "prores"),
    ("A_AAC", "aac"), ("A_OPUS", "opus"), ("A_VORBIS", "vorbis"), ("A_FLAC", "flac"), ("A_MPEG/L3", "mp3"), ("A_MPEG/L2", "mp2"), ("A_AC3", "ac3"), ("A_EAC3", "eac3"), ("A_DTS", "dts"),
    ("A_PCM/INT/LIT", "pcm_s16le"), ("A_PCM/INT/BIG", "pcm_s16be"), ("A_PCM/FLOAT/IEEE", "pcm_f32le"), ("A_ALAC", "alac"),
]

#: What the enabled implementations give: name, sample formats, pixel formats, threads.
CAPABILITIES = [
    ("pcm_u8", ["u8"], [], 1), ("pcm_s16le", ["s16"], [], 1), ("pcm_s24le", ["s32"], [], 1), ("pcm_s32le", ["s32"], [], 1), ("pcm_f32le", ["f32"], [], 1), ("pcm_f64le", ["f64"], [], 1), ("flac", ["s32"], [], 1),
    ("png", [], ["gray8", "rgba"], 1), ("jpeg", [], ["rgba"], 1), ("gif", [], ["rgba"], 1), ("tga", [], ["gray8", "rgba"], 1), ("bmp", [], ["rgba"], 1), ("tiff", [], ["gray8", "gray16", "rgba", "rgba64"], 1),
]

# Track dispositions by bit.
DISPOSITIONS = ["default", "forced", "dependent", "original", "dub", "comment", "lyrics", "karaoke", "clean_effects", "hearing_impaired", "visual_impaired", "captions", "descriptions", "cover", "timed_thumbnails", "metadata"]

# Bytes of a sample.
SAMPLE_BYTES = {"u8": 1, "s16": 2, "s32": 4, "f32": 4, "f64": 8}
# Rate control modes in order.
RATE_MODES = ["crf", "cbr", "vbr", "cqp", "abr", "hqcbr", "hqvbr", "qvbr", "vbr_lat", "icq"]

# Option keys of the Opus encoder; all are whole numbers.
OPTION_KEYS = [
    "opus.application", "opus.bitrate", "opus.vbr", "opus.complexity", "opus.frame_size", "opus.force_channels", "opus.signal_type", "opus.bandwidth", "opus.packet_loss_perc", "opus.fec", "opus.dtx", "opus.lsb_depth", "opus.lookahead",
]

_COLUMNS = {
    "codec_meta": (CODEC_META, "codec string, name string, long_name string, type string"),
    "profiles": (PROFILES, "codec string, profile int, profile_name string"),
    "codec_descriptors": ([(k, *r) for k, r in enumerate(CODEC_DESCRIPTORS)], "reg_order int, codec string, name string, type string, can_decode boolean, can_encode boolean, hardware boolean, enabled boolean"),
    "format_descriptors": ([(k, *r) for k, r in enumerate(FORMAT_DESCRIPTORS)], "reg_order int, container string, name string, can_demux boolean, can_mux boolean"),
    "pixel_formats": (PIXEL_FORMATS, "name string, planes int, bpp0 int, bpp1 int, sub_x int, sub_y int, bits int"),
    "capabilities": (CAPABILITIES, "name string, sample_formats array<string>, pixel_formats array<string>, threads int"),
    "errors": ([(c, n, BANDS[c // 1000]) for c, n in ERRORS], "code int, name string, band string"),
    "sample_entries": (SAMPLE_ENTRIES, "entry string, codec string"),
    "matroska_codecs": (MATROSKA_CODECS, "codec_id string, codec string"),
}


def rows(name: str) -> list[tuple]:
    return _COLUMNS[name][0]


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """The named dimension as a DataFrame."""
    return spark.createDataFrame(*_COLUMNS[name])


def values_sql(name: str) -> str:
    """The named dimension as a SQL subquery with its columns named."""
    data, ddl = _COLUMNS[name]
    cell = lambda v: "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    names = ", ".join(c.split(" ")[0] for c in ddl.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in data)}) AS v({names}))"
