"""Image files with chosen facts, made byte by byte."""

import struct


def tiff(make=b"Maker\0", taken=b"2024:05:06 07:08:09\0", orientation=6, far=0):
    """Little-endian, with the values ``far`` bytes behind the directories."""
    entry = lambda tag, kind, count, value: struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
    gps_at = 8 + 2 + 4 * 12 + 4
    data_at = gps_at + 2 + 2 * 12 + 4 + far
    main = struct.pack("<H", 4) + entry(0x010F, 2, len(make), struct.pack("<I", data_at)) + entry(0x0112, 3, 1, struct.pack("<H", orientation))
    main += entry(0x0132, 2, len(taken), struct.pack("<I", data_at + len(make))) + entry(0x8825, 4, 1, struct.pack("<I", gps_at)) + b"\0" * 4
    gps = struct.pack("<H", 2) + entry(1, 2, 2, b"S\0") + entry(2, 5, 3, struct.pack("<I", data_at + len(make) + len(taken))) + b"\0" * 4
    return b"II*\0" + struct.pack("<I", 8) + main + gps + b"\0" * far + make + taken + struct.pack("<6I", 37, 1, 30, 1, 0, 1)


def jpeg(exif=b"", width=640, height=480, before=0, picture=100):
    """``before`` segments of 60 KB in front of the EXIF one; ``picture`` bytes after the last header."""
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + b"".join(segment(0xE2, b"p" * 60_000) for _ in range(before))
    if exif:
        out += segment(0xE1, b"Exif\0\0" + exif)
    return out + segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9) + segment(0xDA, b"\0" * 10) + b"\x55" * picture


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", width, height)
