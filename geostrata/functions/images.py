"""Texture images as arrays: PNG by the public layout, cropping by texture coordinates, sheets.

Other formats need a decoder that isn't part of the library; such images count as missing.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the layout: the signature; samples by color type.
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """(height, width, 3 or 4) bytes; rows are stored as differences to the row above. level: from 0 to 9, others are clamped."""
    h, w, n = image.shape
    up = image.astype(np.uint8).reshape(h, w * n).copy()
    up[1:] -= image.astype(np.uint8).reshape(h, w * n)[:-1]
    rows = np.concatenate([np.full((h, 1), 2, np.uint8), up], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), max(0, min(9, level)))) + _chunk(b"IEND", b"")


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, n).astype(np.uint64), axis=0).astype(np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    out, up = row.tolist(), above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:  # the neighbour nearest to a + b - c; ties: left, above, both
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def decode_png(data: bytes | None) -> np.ndarray | None:
    """(height, width, 4) bytes of an 8-bit image that isn't interlaced; None for anything else."""
    if not data or not data.startswith(SIGNATURE):
        return None
    at, body, palette, alpha, head = 8, b"", None, None, None
    try:
        while at + 8 <= len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            own = data[at + 8 : at + 8 + n]
            at += 12 + n
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", own)
            elif kind == b"PLTE":
                palette = np.frombuffer(own, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                alpha = np.frombuffer(own, np.uint8)
            elif kind == b"IDAT":
                body += own
        w, h, depth, color, _, _, laced = head
        if depth != 8 or laced or color not in SAMPLES:
            return None
        n = SAMPLES[color]
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    except (TypeError, ValueError, struct.error, zlib.error):
        return None
    rows, above = [], np.zeros(w * n, np.uint8)
    for line in raw:
        above = _unfiltered(int(line[0]), line[1:], above, n)
        rows.append(above)
    x = np.array(rows, np.uint8).reshape(h, w, n)
    solid = np.full((h, w, 1), 255, np.uint8)
    if color == 3:
        index = np.minimum(x[..., 0], len(palette) - 1)
        a = np.full(len(palette), 255, np.uint8)
        if alpha is not None:
            a[: len(alpha)] = alpha[: len(palette)]
        return np.concatenate([palette[index], a[index][..., None]], axis=2)
    if color in (0, 4):
        return np.concatenate([np.repeat(x[..., :1], 3, axis=2), x[..., 1:] if color == 4 else solid], axis=2)
    return x if color == 6 else np.concatenate([x, solid], axis=2)


def cropped(image: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of an image that texture coordinates (n, 2) span, and the coordinates in it; at least one pixel."""
    low, high = uv.min(0), uv.max(0)
    h, w = image.shape[:2]
    x0, y0 = (int(np.clip(round(a * n), 0, n - 1)) for a, n in zip(low, (w, h), strict=True))
    x1, y1 = (int(np.clip(round(b * n), a + 1, n)) for a, b, n in zip((x0, y0), high, (w, h), strict=True))
    return image[y0:y1, x0:x1], (uv - low) / np.where(high > low, high - low, 1.0)


def smaller(image: np.ndarray, factor: int) -> np.ndarray:
    """Both sides divided by the factor and raised to the next power of two, by means of the pixels that meet; sides are never enlarged."""
    h, w = (min(n, 1 << (max(1, n // factor) - 1).bit_length()) for n in image.shape[:2])
    rows, cols = np.arange(h) * image.shape[0] // h, np.arange(w) * image.shape[1] // w
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.float64), rows, axis=0), cols, axis=1)
    count = np.diff([*rows, image.shape[0]])[:, None, None] * np.diff([*cols, image.shape[1]])[None, :, None]
    return np.round(sums / count).astype(np.uint8)


def sheet(images: list[np.ndarray], places: list[tuple[int, int]], width: int, height: int) -> np.ndarray:
    """Images on a black sheet at their (left, top)."""
    out = np.zeros((height, width, 3), np.uint8)
    for image, (left, top) in zip(images, places, strict=True):
        h, w = image.shape[:2]
        out[top : top + h, left : left + w] = image[..., :3]
    return out
