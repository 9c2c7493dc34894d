"""Container and bitstream detection: one ordered first-match expression over a header.

compat=True keeps the known quirks (see the README): the sync word of MPEG audio
with its bytes swapped, transport streams only with three zero bytes after the
first, and M4A and HEIF behind the general ISO rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.bytesx import read_at, synchsafe, u8

PROBE_BYTES = 2048
#: Bytes whose hex text is made once for all rules.
HEAD = 12


@dataclass
class Header:
    """A header as rules see it: hex text of its first bytes, and the bytes."""

    text: Column
    data: Column


Test = Callable[[Header], Column]
Rule = tuple[Test, str | None, str | None]


def starts(*prefixes: str) -> Test:
    """Whether the header begins with one of these bytes, given as hex."""

    def run(h: Header) -> Column:
        out = F.startswith(h.text, F.lit(prefixes[0]))
        for p in prefixes[1:]:
            out = out | F.startswith(h.text, F.lit(p))
        return out

    return run


def text_at(position: int, *texts: str) -> Test:
    codes = [F.lit(t.encode().hex().upper()) for t in texts]
    return lambda h: F.substring(h.text, 2 * position + 1, 2 * len(texts[0])).isin(*codes)


def both(a: Test, b: Test) -> Test:
    return lambda h: a(h) & b(h)


def byte_at(position: int, value: int) -> Test:
    return lambda h: F.coalesce(u8(h.data, position) == value, F.lit(False))


def id3_size(b: Column) -> Column:
    """Bytes of an ID3v2 tag with its header and footer; 0 if there is none or it is malformed."""
    ok = F.startswith(b, F.unhex(F.lit("494433"))) & (u8(b, 3) != 255) & (u8(b, 4) != 255)
    return F.coalesce(F.when(ok, synchsafe(b, 6) + 10 + F.when(u8(b, 5).bitwiseAND(16) != 0, 10).otherwise(0)), F.lit(0))


def _flac_after_id3(h: Header) -> Column:
    skip = id3_size(h.data)
    return F.coalesce((skip > 0) & (F.hex(read_at(h.data, skip, 4)) == "664C6143"), F.lit(False))


def _nal(test: Callable[[Column], Column]) -> Test:
    digits = lambda h, p: F.conv(F.nullif(F.substring(h.text, 2 * p + 1, 2), F.lit("")), 16, 10).cast("int")
    return lambda h: F.coalesce(test(F.when(starts("00000001")(h), digits(h, 4)).when(starts("000001")(h), digits(h, 3))), F.lit(False))


def standard_rules(compat: bool = False) -> list[Rule]:
    """(test, container, codec) in order; the first that holds counts."""
    iso = text_at(4, "ftyp")
    m4a: Rule = (both(iso, text_at(8, "M4A ")), "m4a", None)
    heif: Rule = (both(iso, text_at(8, "avif", "heic", "hevc")), "heif", None)
    transport = starts("47000000") if compat else starts("47")
    sync = starts("FAFF", "FBFF") if compat else starts("FFFA", "FFFB")
    out: list[Rule] = [(starts("1A45DFA3"), "mkv", None), (both(iso, text_at(8, "webm")), "webm", None)]
    out += [] if compat else [m4a, heif]
    out += [
        (iso, "mp4", None),
        (starts("4F676753"), "ogg", None),
        (both(starts("52494646"), text_at(8, "AVI ")), "avi", None),
        (starts("000001BA"), "mpeg_ps", None),
        (both(transport, byte_at(188, 0x47)), "mpeg_ts", None),
        (starts("3026B275"), "asf", None),
        (starts("464C5601"), "flv", None),
        (starts("4E555453"), "nut", None),
        (starts("664C6143"), "flac", None),
        (both(starts("52494646"), text_at(8, "WAVE")), "wav", None),
        (both(starts("494433"), _flac_after_id3), "flac", None),
        (starts("494433"), "mp3", None),
        (sync, "mp3", None),
        m4a,
        (starts("4D616320"), "ape", None),
        (starts("FFD8FF"), "jpeg", None),
        (starts("89504E47"), "png", None),
        (both(starts("52494646"), text_at(8, "WEBP")), "webp", None),
        (starts("424D"), "bmp", None),
        (starts("47494638"), "gif", None),
        (starts("49492A00", "4D4D002A"), "tiff", None),
        (starts("00000100"), "ico", None),
        (starts("762F3101"), "exr", None),
        (starts("69636E73"), "icns", None),
        heif,
        (_nal(lambda x: x.bitwiseAND(31) == 7), None, "h264"),
        (_nal(lambda x: F.shiftright(x, 1).bitwiseAND(63) == 32), None, "h265"),
    ]
    return out


def detect(header: Header, compat: bool = False, rules: list[Rule] | None = None) -> Column:
    """Struct (container, codec) of a header; both null if it is shorter than 4 bytes or no rule holds.

    rules replaces the standard list; a pluggable detector is a rule put in it.
    """
    out = F.when(F.length(header.text) < 8, _answer(None, None))
    for test, container, codec in rules or standard_rules(compat):
        out = out.when(test(header), _answer(container, codec))
    return out.otherwise(_answer(None, None))


def _answer(container: str | None, codec: str | None) -> Column:
    return F.struct(F.lit(container).cast("string").alias("container"), F.lit(codec).cast("string").alias("codec"))


def with_format(df: DataFrame, content: str, name: str = "format", compat: bool = False, rules: list[Rule] | None = None) -> DataFrame:
    """df with the detected struct of a BINARY column; the header's hex text is made once for all rules."""
    made = df.withColumn("__head", F.hex(F.substring(F.col(content), 1, HEAD)))
    return made.withColumn(name, detect(Header(F.col("__head"), F.col(content)), compat, rules)).drop("__head")
