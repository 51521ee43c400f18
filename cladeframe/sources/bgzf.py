"""Blocked gzip: blocks of a stream, each a gzip member of its own that says how long it is."""

from __future__ import annotations

import struct
import zlib

#: Fixed values of the public format: the end marker, and the bytes that a block holds.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65280


def block(part: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(part) + c.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def blocks(data: bytes, level: int = 5):
    """The blocks of the data, without the end marker."""
    for at in range(0, len(data), BLOCK):
        yield block(data[at : at + BLOCK], level)


def inflate(data: bytes) -> bytes:
    """All members of a gzip or BGZF stream."""
    out, at = [], 0
    view = memoryview(data)
    while at < len(data):
        d = zlib.decompressobj(31)
        out.append(d.decompress(view[at:]) + d.flush())
        at = len(data) - len(d.unused_data)
    return b"".join(out)
