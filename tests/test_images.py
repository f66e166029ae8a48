import struct
import zlib

import numpy as np
import pytest

from lenscape.functions import images


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    rng = np.random.default_rng(channels)
    p = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
    assert (images.decode_standard(images.encode_png(p)) == p).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    p = rng.integers(0, 256, (6, 4, 3), dtype=np.int32)
    rows = b""
    flat = p.reshape(6, 12)
    for y in range(6):
        out = []
        for x in range(12):
            a = flat[y, x - 3] if x >= 3 else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - 3] if y and x >= 3 else 0
            near = min((abs(a + b - c - v), i) for i, v in enumerate((a, b, c)))[1]
            guess = [0, a, b, (a + b) // 2, (a, b, c)[near]][kind]
            out.append((flat[y, x] - guess) & 255)
        rows += bytes([kind, *out])
    good = images.encode_png(p.astype(np.uint8))
    at = good.index(b"IDAT")
    size = struct.unpack(">I", good[at - 4 : at])[0]
    body = zlib.compress(rows)
    made = good[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + good[at + 8 + size :]
    assert (images.decode_png(made) == p).all()


def test_bmp():
    p = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    body = b"".join(row[:, ::-1].tobytes() + b"\0" * 3 for row in p[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(body), 0, 0, 0, 0)
    assert (images.decode_standard(head + body) == p).all()
    with pytest.raises(ValueError):
        images.decode_standard(b"\xff\xd8\xff")


def test_orientation():
    p = np.array([[1, 2, 3], [4, 5, 6]])[:, :, None]
    want = {
        1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]],
        5: [[6, 3], [5, 2], [4, 1]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[1, 4], [2, 5], [3, 6]], 8: [[3, 6], [2, 5], [1, 4]],
    }
    # 5 and 7 are a turn and then a mirroring
    want[5], want[7] = np.rot90(p[:, :, 0], 1)[:, ::-1].tolist(), np.rot90(p[:, :, 0], -1)[:, ::-1].tolist()
    for o, w in want.items():
        assert images.oriented(p, o)[:, :, 0].tolist() == w
    assert images.oriented(p, None).tolist() == images.oriented(p, 9).tolist() == p.tolist()


def bits(h):
    import base64

    return int.from_bytes(base64.b64decode(h), "little")


def test_perceptual_hash():
    y, x = np.mgrid[0:64, 0:64]
    p = (127 + 80 * np.sin(x / 9) + 40 * np.cos(y / 7))[:, :, None].repeat(3, axis=2).astype(np.uint8)
    h = images.double_gradient(p)
    assert images.double_gradient(p.copy()) == h and bits(h) < 1 << 40
    small = images.thumbnail(p, 32)
    assert small.shape == (32, 32, 3) and (bits(images.double_gradient(small)) ^ bits(h)).bit_count() <= 3
    other = np.random.default_rng(0).integers(0, 256, (64, 64, 3), dtype=np.uint8)
    assert (bits(images.double_gradient(other)) ^ bits(h)).bit_count() >= 8


def test_thumbnail_sizes():
    p = np.zeros((300, 1000, 3), np.uint8)
    assert images.thumbnail(p, 400).shape == (120, 400, 3) and images.thumbnail(p, 1600).shape == p.shape
    assert images.thumbnail(p.transpose(1, 0, 2), 400).shape == (400, 120, 3)
