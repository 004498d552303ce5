"""Headers of image and video files, read from an open file by seeking: pixels are never read."""

from __future__ import annotations

import struct

ImageFacts = tuple[int | None, int | None, str | None, str | None]
VideoFacts = tuple[int | None, int | None, float | None, int | None]
# Mode names by PNG colour type and by TIFF photometric tag.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
TIFF_MODES = {0: "L", 1: "L", 2: "RGB", 3: "P", 5: "CMYK", 6: "YCbCr", 8: "LAB"}


class Short(ValueError):
    """The file ends before its header does."""


def _take(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) < n:
        raise Short(at)
    return data


def _unpack(file, at: int, layout: str) -> tuple:
    return struct.unpack(layout, _take(file, at, struct.calcsize(layout)))


def _jpeg(file) -> ImageFacts:
    at = 2
    while True:
        mark = _unpack(file, at, ">BB")
        if mark[0] != 0xFF:
            at += 1
            continue
        kind = mark[1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, parts = _unpack(file, at + 5, ">HHB")
            return w, h, "JPEG", {1: "L", 3: "RGB", 4: "CMYK"}.get(parts)
        at += 1 if kind == 0xFF else 2 if 0xD0 <= kind <= 0xD9 or kind == 0x01 else 2 + _unpack(file, at + 2, ">H")[0]


def _tiff(file, order: str) -> ImageFacts:
    at = _unpack(file, 4, order + "I")[0]
    held = {}
    for i in range(_unpack(file, at, order + "H")[0]):
        tag, kind, _ = _unpack(file, at + 2 + 12 * i, order + "HHI")
        held[tag] = _unpack(file, at + 10 + 12 * i, order + ("H" if kind == 3 else "I"))[0]
    mode = "1" if held.get(258, 1) == 1 and held.get(277, 1) == 1 else TIFF_MODES.get(held.get(262, 1))
    return held.get(256), held.get(257), "TIFF", mode


def _webp(file) -> ImageFacts:
    kind = _take(file, 12, 4)
    if kind == b"VP8X":
        flags, w, h = _take(file, 20, 1)[0], _take(file, 24, 3), _take(file, 27, 3)
        return 1 + int.from_bytes(w, "little"), 1 + int.from_bytes(h, "little"), "WEBP", "RGBA" if flags & 16 else "RGB"
    if kind == b"VP8L":
        bits = _unpack(file, 21, "<I")[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "WEBP", "RGBA" if bits >> 28 & 1 else "RGB"
    w, h = _unpack(file, 26, "<HH")
    return w & 0x3FFF, h & 0x3FFF, "WEBP", "RGB"


def _codestream(file, at: int) -> ImageFacts:
    """JPEG 2000: the size marker that opens a code stream."""
    x1, y1, x0, y0 = _unpack(file, at + 8, ">IIII")
    parts = _unpack(file, at + 40, ">H")[0]
    return x1 - x0, y1 - y0, "JPEG2000", {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}.get(parts)


def _boxes(file, at: int, end: int):
    """(kind, start of its content, end) of the boxes between two places."""
    while at + 8 <= end:
        size, kind = _unpack(file, at, ">I4s")
        head = 8
        if size == 1:
            size, head = _unpack(file, at + 8, ">Q")[0], 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield kind, at + head, min(end, at + size)
        at += size


def image_header(file) -> ImageFacts:
    """(width, height, format, mode) of a PNG, GIF, BMP, JPEG, TIFF (DNG), WebP or JPEG 2000 file, else nulls."""
    try:
        head = file.read(32)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, depth, kind = struct.unpack(">IIBB", head[16:26])
            return w, h, "PNG", "1" if depth == 1 and kind == 0 else "I;16" if depth == 16 and kind == 0 else PNG_MODES.get(kind)
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return *struct.unpack("<HH", head[6:10]), "GIF", "P"
        if head[:2] == b"BM":
            if struct.unpack("<I", head[14:18])[0] == 12:
                w, h, _, depth = struct.unpack("<HHHH", head[18:26])
            else:
                w, h, _, depth = struct.unpack("<iiHH", head[18:30])
            return w, abs(h), "BMP", "1" if depth == 1 else "P" if depth <= 8 else "RGB"
        if head[:2] == b"\xff\xd8":
            return _jpeg(file)
        if head[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(file, "<" if head[:2] == b"II" else ">")
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(file)
        if head[:4] == b"\xff\x4f\xff\x51":
            return _codestream(file, 0)
        if head[4:8] == b"jP  ":
            for kind, at, _ in _boxes(file, 0, file.size()):
                if kind == b"jp2c":
                    return _codestream(file, at)
    except (struct.error, Short):
        pass
    return None, None, None, None


def _avi(file, end: int) -> VideoFacts:
    """The main header of an AVI file: the first chunk of its first list."""
    at = 12
    while at + 8 <= end:
        kind, size = _unpack(file, at, "<4sI")
        if kind == b"LIST" and _take(file, at + 8, 4) == b"hdrl":
            at += 12
            continue
        if kind == b"avih":
            micros, _, _, _, frames, _, _, _, w, h = _unpack(file, at + 8, "<10I")
            return w, h, 1e6 / micros if micros else 0.0, frames
        at += 8 + size + size % 2
    return None, None, None, None


def _mp4(file, end: int) -> VideoFacts:
    """The first video track of an MP4 or QuickTime file: its size, samples and duration."""
    for kind, at, stop in _boxes(file, 0, end):
        if kind != b"moov":
            continue
        for inner, a, b in _boxes(file, at, stop):
            if inner != b"trak":
                continue
            w = h = samples = scale = length = 0
            video = False
            todo = [(a, b)]
            while todo:
                for box, x, y in _boxes(file, *todo.pop()):
                    if box in (b"mdia", b"minf", b"stbl"):
                        todo.append((x, y))
                    elif box == b"tkhd":
                        w, h = (v >> 16 for v in _unpack(file, y - 8, ">II"))
                    elif box == b"hdlr":
                        video = _take(file, x + 8, 4) == b"vide"
                    elif box == b"mdhd":
                        wide = _take(file, x, 1)[0] == 1
                        scale, length = _unpack(file, x + (20 if wide else 12), ">IQ" if wide else ">II")
                    elif box == b"stsz":
                        samples = _unpack(file, x + 8, ">I")[0]
            if video:
                return w, h, samples * scale / length if length else 0.0, samples
    return None, None, None, None


def video_header(file) -> VideoFacts:
    """(width, height, frames a second, frames) of an AVI, MP4 or QuickTime file, else nulls."""
    try:
        head = file.read(12)
        if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
            return _avi(file, file.size())
        if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
            return _mp4(file, file.size())
    except (struct.error, Short):
        pass
    return None, None, None, None
