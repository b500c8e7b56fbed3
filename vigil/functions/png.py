"""PNG pictures with a palette, written and read back with zlib alone. A picture is an array (height, width) of palette numbers."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The format's signature, and the colours of paper, a marked range, the marked range that counts most, and the line.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PALETTE = ((255, 255, 255), (255, 224, 224), (255, 160, 160), (32, 32, 32))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(picture: np.ndarray, palette=PALETTE) -> bytes:
    """Eight bits a pixel; each row is stored as its difference to the row above (filter 2), which zlib packs well."""
    rows = np.asarray(picture, np.uint8)
    height, width = rows.shape
    up = rows - np.concatenate((np.zeros((1, width), np.uint8), rows[:-1]))
    body = np.concatenate((np.full((height, 1), 2, np.uint8), up), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 3, 0, 0, 0)
    colours = bytes(c for colour in palette for c in colour)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"PLTE", colours) + _chunk(b"IDAT", zlib.compress(body, 6)) + _chunk(b"IEND", b"")


def picture_of(data: bytes) -> np.ndarray:
    """The picture in a file that ``png`` wrote; ValueError for anything else, damage included."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, packed = 8, None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2:] != (8, 3, 0, 0, 0):
        raise ValueError("not a picture with an eight-bit palette")
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head[1], head[0] + 1)
    if (rows[:, 0] != 2).any():
        raise ValueError("rows have another filter")
    return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8)
