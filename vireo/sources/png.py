"""PNG in the standard library and NumPy: decode, encode, and text chunks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunks(data: bytes):
    """(type, body) of each whole chunk; what is cut off is left out."""
    at = len(SIGNATURE)
    while data.startswith(SIGNATURE) and at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + n > len(data):
            return
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def text(data: bytes) -> dict[str, str]:
    """Keyword to text, of tEXt, zTXt and iTXt chunks; broken ones are left out."""
    out: dict[str, str] = {}
    for kind, body in chunks(data):
        try:
            key, _, rest = body.partition(b"\0")
            if kind == b"tEXt":
                out[key.decode("latin-1")] = rest.decode("latin-1")
            elif kind == b"zTXt":
                out[key.decode("latin-1")] = zlib.decompress(rest[1:]).decode("latin-1")
            elif kind == b"iTXt":
                value = rest[2:].split(b"\0", 2)[2]  # after language and translated keyword
                out[key.decode("latin-1")] = (zlib.decompress(value) if rest[0] else value).decode("utf-8")
        except (ValueError, IndexError, zlib.error):
            continue
    return out


def size(data: bytes) -> tuple[int, int] | None:
    for kind, body in chunks(data):
        if kind == b"IHDR" and len(body) == 13:
            return struct.unpack(">II", body[:8])
        break
    return None


def encode(pixels: np.ndarray, texts: dict[str, str] | None = None) -> bytes:
    """A PNG of (h, w) or (h, w, 3 or 4) bytes."""
    h, w = pixels.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
    for key, value in (texts or {}).items():
        try:
            out += chunk(b"tEXt", key.encode("latin-1") + b"\0" + value.encode("latin-1"))
        except UnicodeEncodeError:
            out += chunk(b"iTXt", key.encode("latin-1") + b"\0\0\0\0\0" + value.encode())
    return out + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray | None:
    """Pixels as (h, w), (h, w, 3) or (h, w, 4) bytes; palettes become colours, 16 bits the high 8, gray with alpha loses it. None: broken in any way."""
    try:
        return _decoded(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        return None


#: The seven passes of an interlaced image, as first column, first row, column step and row step.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _decoded(data: bytes) -> np.ndarray | None:
    head, palette, body = None, None, []
    for kind, x in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", x)
        elif kind == b"PLTE":
            palette = np.frombuffer(x, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(x)
    if head is None:
        return None
    w, h, depth, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or not w or not h or depth not in (1, 2, 4, 8, 16) or head[6] > 1:
        return None
    raw = zlib.decompress(b"".join(body))
    if head[6]:
        px, at = np.zeros((h, w, channels), np.uint8), 0
        for x0, y0, dx, dy in PASSES:
            pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
            if pw > 0 and ph > 0:
                px[y0::dy, x0::dx], at = _pass(raw, at, pw, ph, depth, channels)
    else:
        px = _pass(raw, 0, w, h, depth, channels)[0]
    if colour == 3:
        return None if palette is None or px.max() >= len(palette) else palette[px[:, :, 0]]
    if colour == 0 and depth < 8:
        px = (px.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return px[:, :, 0] if channels <= 2 else px


def _pass(raw: bytes, at: int, w: int, h: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples (h, w, channels) of an image or pass that begins at a place of the data, and where it ends."""
    stride, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1), at).reshape(h, stride + 1)
    out = unfiltered(rows[:, 0], rows[:, 1:], step)
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(out, axis=1)[:, : w * channels * depth].reshape(h, w * channels, depth)
        out = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return out.reshape(h, w, channels), at + h * (stride + 1)


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of filtered rows. Runs of rows whose bytes need their left neighbour's are undone along diagonals, many rows at once."""
    h, stride = rows.shape
    out = np.zeros((h + 1, stride), np.uint8)
    y = 0
    while y < h:
        kind = int(kinds[y])
        end = y + 1
        if kind in (3, 4):
            while end < h and kinds[end] in (3, 4):
                end += 1
            _diagonals(out[y : end + 1], rows[y:end], kinds[y:end], step)
        elif kind == 0:
            out[y + 1] = rows[y]
        elif kind == 2:
            out[y + 1] = rows[y] + out[y]
        elif kind == 1:
            padded = np.zeros((-(-stride // step), step), np.uint8)
            padded.ravel()[:stride] = rows[y]
            out[y + 1] = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[:stride]
        else:
            raise ValueError(f"filter {kind}")
        y = end
    return out[1:]


def _diagonals(out: np.ndarray, rows: np.ndarray, kinds: np.ndarray, step: int) -> None:
    """Rows of filters 3 and 4, below out[0]: a pixel needs those to its left, above, and above that, which lie on the two diagonals before."""
    n, stride = rows.shape
    wide = -(-stride // step)
    px = np.zeros((n + 1, wide + 1, step), np.int16)
    px[0, 1:].reshape(-1)[:stride] = out[0]
    filtered = np.zeros((n, wide * step), np.int16)
    filtered[:, :stride] = rows
    filtered = filtered.reshape(n, wide, step)
    mean = (kinds == 3)[:, None]
    for d in range(n + wide - 1):
        y = np.arange(max(0, d - wide + 1), min(n, d + 1))
        x = d - y
        a, b, c = px[y + 1, x], px[y, x + 1], px[y, x]
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        px[y + 1, x + 1] = (filtered[y, x] + np.where(mean[y], (a + b) >> 1, guess)) & 255
    out[1:] = px[1:, 1:].reshape(n, -1)[:, :stride]
