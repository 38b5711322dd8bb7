"""ZIP directories and ranged reads of stored members, on anything that can seek and read."""

from __future__ import annotations

import struct
from typing import BinaryIO, NamedTuple

END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_ALL16, _ALL32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


def _read(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) < n:
        raise ValueError(f"the archive ends inside {n} bytes at {at}")
    return data


def directory(file: BinaryIO, size: int) -> list[Member]:
    """The members of a ZIP archive of ``size`` bytes, from its end record (ZIP64 where that points to one)."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _read(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == _ALL16 or length == _ALL32 or start == _ALL32:
        locator = _read(file, tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("the end record asks for ZIP64, but there is no locator")
        record = _read(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record at its place")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    data, members, p = _read(file, start, length), [], 0
    for _ in range(count):
        if data[p : p + 4] != ENTRY:
            raise ValueError("the directory breaks off")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, p + 20)
        header = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            kind, n = struct.unpack_from("<HH", data, q)
            if kind == 1:  # ZIP64: only the fields that are full below, in this order
                r = q + 4
                if full == _ALL32:
                    full, r = struct.unpack_from("<Q", data, r)[0], r + 8
                if packed == _ALL32:
                    packed, r = struct.unpack_from("<Q", data, r)[0], r + 8
                if header == _ALL32:
                    header = struct.unpack_from("<Q", data, r)[0]
            q += 4 + n
        members.append(Member(name, method, full, packed, header))
        p = stop + n_comment
    return members


def data_start(file: BinaryIO, member: Member) -> int:
    """Where a stored member's bytes begin: its local header has name and extra fields of its own length."""
    if member.method:
        raise ValueError(f"{member.name} is compressed in the archive; only stored members can be read in ranges")
    header = _read(file, member.header, 30)
    if header[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name} at its place")
    return member.header + 30 + sum(struct.unpack_from("<HH", header, 26))


def read_range(file: BinaryIO, at: int, n: int) -> bytes:
    """n bytes at a place of the archive."""
    return _read(file, at, n)
