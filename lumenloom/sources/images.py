"""Image files: their size from the header, and what to keep. Re-encoding is left to a provider."""

from __future__ import annotations

import struct


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height of PNG, GIF, JPEG or WebP data."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
        return None
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    return None


def accepted(data: bytes, most_bytes: int = 50_000_000, least_side: int = 100) -> bool:
    """Whether a downloaded image is worth keeping."""
    size = dimensions(data) if len(data) <= most_bytes else None
    return size is not None and min(size) >= least_side


def scaled(width: int, height: int, most_pixels: int = 25_000_000) -> tuple[int, int]:
    """The size to bring an image down to."""
    if width * height <= most_pixels:
        return width, height
    f = (most_pixels / (width * height)) ** 0.5
    return max(int(width * f), 1), max(int(height * f), 1)
