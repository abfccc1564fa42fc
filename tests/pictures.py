"""Writes PNG files without an image library."""

import struct
import zlib

import numpy as np


def write_png(path, pixels: np.ndarray) -> None:
    height, width, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def square(x: int, y: int, size: int = 7, side: int = 64) -> np.ndarray:
    picture = np.full((side, side, 3), 255, dtype=np.uint8)
    picture[y : y + size, x : x + size] = 0
    return picture
