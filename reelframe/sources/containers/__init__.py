"""Container parsers: bytes of one file to tracks and packets.

A parser takes a file's bytes and yields ("track", {...}) and ("packet", {...})
items in order, and raises Malformed(code) where the file can't be read on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

Item = tuple[str, dict]
Parser = Callable[[bytes], Iterator[Item]]


class Malformed(Exception):
    """A file that can't be read (on); code is the error_code of its row."""

    def __init__(self, code: int = 3003) -> None:
        super().__init__(code)
        self.code = code


def track(index: int, kind: str, codec: str | None, **more) -> Item:
    base = {"index": index, "id": index, "type": kind, "codec": codec, "start_time": 0, "duration": -1, "disposition": 0, "error_code": 0}
    return "track", base | more


def packet(seq: int, pos: int, payload: bytes, **more) -> Item:
    base = {"seq": seq, "stream_index": 0, "pts": 0, "dts": 0, "duration": 0, "pos": pos, "flags": 0, "is_keyframe": True, "payload": payload, "error_code": 0}
    return "packet", base | more


def base(num: int, den: int) -> dict:
    return {"num": num, "den": den}


def u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "little")


def u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def big(b: bytes, at: int, n: int) -> int:
    if at + n > len(b):
        raise Malformed(3010)
    return int.from_bytes(b[at : at + n], "big")
