"""Pixels: decoding, the orientation transform, perceptual hashes and scaling, on arrays of rows, columns and channels."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np


def decode_png(data: bytes) -> np.ndarray:
    """8-bit PNG without interlace: grey, RGB, palette, and those with alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette = 8, b"", None
    width = height = kind = 0
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or interlace:
                raise ValueError("only 8-bit PNG without interlace")
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += chunk
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        filtered, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if filtered == 2:
            line = (line + above) & 255
        elif filtered == 1:
            line = (np.cumsum(line.reshape(-1, channels), axis=0) & 255).ravel()
        elif filtered in (3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b = above[x]
                if filtered == 3:
                    guess = (a + b) // 2
                else:
                    c = above[x - channels] if x >= channels else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[x] = (line[x] + guess) & 255
        out[y] = line
        above = line
    pixels = out.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if kind == 3 else pixels


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    """24- and 32-bit BMP without compression."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("only 24- and 32-bit BMP")
    step = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode_standard(data: bytes) -> np.ndarray:
    """By the first bytes. Other formats need a decoder of one's own, or Spark's image source (see sources.files)."""
    if data[:4] == b"\x89PNG":
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("no decoder for this format here")


def oriented(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """EXIF orientations 1 to 8: a turn, for 2, 4, 5 and 7 followed by a mirroring."""
    turned = np.rot90(pixels, {3: 2, 5: 1, 6: -1, 7: -1, 8: 1}.get(orientation or 1, 0))
    if orientation == 4:
        return turned[::-1]
    return turned[:, ::-1] if orientation in (2, 5, 7) else turned


def grey(pixels: np.ndarray) -> np.ndarray:
    x = pixels.astype(np.float64)
    return x[:, :, 0] if x.shape[2] < 3 else x[:, :, :3] @ np.array([0.2126, 0.7152, 0.0722])


def scaled(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """A plane (or planes) averaged over the area of each new pixel."""
    return _weights(plane.shape[0], height) @ plane @ _weights(plane.shape[1], width).T if plane.ndim == 2 else np.stack(
        [scaled(plane[:, :, c], height, width) for c in range(plane.shape[2])], axis=2
    )


def _weights(old: int, new: int) -> np.ndarray:
    edges = np.linspace(0, old, new + 1)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(old)[None, :]
    share = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def double_gradient(pixels: np.ndarray, size: int = 8) -> str:
    """Base64 of one bit for each rise between neighbours, across and down, of a small grey image."""
    n = size // 2 + 1
    small = scaled(grey(pixels), n, n)
    bits = np.concatenate([(small[:, :-1] < small[:, 1:]).ravel(), (small[:-1] < small[1:]).ravel()])
    return base64.b64encode(np.packbits(bits, bitorder="little").tobytes()).decode()


def thumbnail(pixels: np.ndarray, edge: int) -> np.ndarray:
    """Scaled into a square of that edge; small images stay as they are."""
    h, w = pixels.shape[:2]
    if w <= edge and h <= edge:
        return pixels
    f = np.float32
    if w > h:
        tw, th = edge, int(f(edge) / (f(w) / f(h)))
    else:
        tw, th = int(f(edge) / (f(h) / f(w))), edge
    return np.clip(np.rint(scaled(pixels.astype(np.float64), max(th, 1), max(tw, 1))), 0, 255).astype(np.uint8)
