"""ZIP directories by range reads: where each member's bytes lie, without extracting anything.

Reads the end record, the ZIP64 end record where its locator is present, the central
directory with ZIP64 extra fields, and a member's local header for the start of its data.
Fixed values are those of the ZIP format.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED = 0
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    crc32: int
    stored_size: int
    size: int
    header: int


def _at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends at byte {offset + len(data)}, before {offset + length}")
    return data


def _directory(file, total: int) -> tuple[int, int, int]:
    """(entries, bytes, start) of the central directory."""
    if total < 22:
        raise ValueError("not a ZIP archive: too short")
    tail_at = max(0, total - 22 - _MAX16)  # the end record may be followed by a comment of 64 KB at most
    tail = _at(file, tail_at, total - tail_at)
    found = tail.rfind(END)
    while found >= 0:
        if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("not a ZIP archive: no end record")
    entries, size, start = struct.unpack_from("<HII", tail, found + 10)
    end_at = tail_at + found
    if end_at >= 20:
        locator = _at(file, end_at - 20, 20)
        if locator[:4] == LOCATOR64:
            end64 = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("ZIP64 locator does not point at an end record")
            entries, size, start = struct.unpack_from("<QQQ", end64, 32)
    return entries, size, start


def members(file, total: int) -> list[Member]:
    """The archive's members; ``file`` has seek and read, ``total`` is its size."""
    entries, size, start = _directory(file, total)
    data, at, out = _at(file, start, size), 0, []
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, p = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:  # 64-bit values, only of the fields that are all ones, in this order
                q = p + 4
                if full == _MAX32:
                    full, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                if stored == _MAX32:
                    stored, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                if header == _MAX32:
                    header = struct.unpack_from("<Q", extra, q)[0]
            p += 4 + n
        out.append(Member(name, method, crc, stored, full, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin in the archive."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed as a member; only stored members can be read by range")
    head = _at(file, member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra
