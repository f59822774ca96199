"""Media columns: Netpbm and BMP images, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, map_batches, slices

ROW = 64


def encode_pgm(a: np.ndarray) -> bytes:
    """Binary 8-bit grey map (P5)."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_ppm(a: np.ndarray) -> bytes:
    """Binary 8-bit colour map (P6) of rows x columns x 3."""
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def _header(raw: bytes, n: int) -> tuple[list[int], int]:
    """n numbers after the magic, over white space and comments; where the raster begins."""
    out: list[int] = []
    at = 2
    while len(out) < n:
        c = raw[at : at + 1]
        if c == b"#":
            at = raw.index(b"\n", at) + 1
        elif c.isspace():
            at += 1
        elif c.isdigit():
            end = at
            while raw[end : end + 1].isdigit():
                end += 1
            out.append(int(raw[at:end]))
            at = end
        else:
            raise ValueError("broken Netpbm header")
    return out, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6: rows x columns, or x 3 for colour. Bits come as 0 and 255 (white)."""
    kind = raw[1:2]
    if raw[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("no Netpbm image")
    numbers, at = _header(raw, 2 if kind in b"14" else 3)
    width, height = numbers[:2]
    top, planes = (numbers[2] if len(numbers) > 2 else 1), 3 if kind in b"36" else 1
    if kind == b"4":
        line = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, line * height, at).reshape(height, line), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    if kind in b"56":
        samples = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", width * height * planes, at)
    elif kind == b"1":
        text = b"".join(x.split(b"#")[0] for x in raw[at - 1 :].splitlines())
        samples = 1 - np.array([c - 48 for c in text if c in b"01"][: width * height], np.int64)
    else:
        text = b" ".join(x.split(b"#")[0] for x in raw[at - 1 :].splitlines())
        samples = np.array(text.split()[: width * height * planes], np.int64)
    if len(samples) != width * height * planes:
        raise ValueError("the raster is cut off")
    if top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    return samples.astype(np.uint8).reshape((height, width, 3) if planes == 3 else (height, width))


def encode_bmp(a: np.ndarray) -> bytes:
    """24 bits a pixel, or 8 with a grey palette; bottom row first."""
    grey = a.ndim == 2
    line = -(-a.shape[1] * (1 if grey else 3) // 4) * 4
    body = np.zeros((a.shape[0], line), np.uint8)
    flat = a[::-1] if grey else a[::-1, :, ::-1].reshape(a.shape[0], -1)
    body[:, : flat.shape[1]] = flat
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    at = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, a.shape[1], a.shape[0], 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 * grey, 0) + palette + body.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 or 32 bits: rows x columns x 3, or rows x columns if all is grey."""
    magic, _, _, _, at = struct.unpack_from("<2sIHHI", raw)
    size, width, height, _, depth, packing, _, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", raw, 14)
    if magic != b"BM" or size < 40 or packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError("a kind of BMP that is not read here")
    rows, line = abs(height), -(-width * depth // 32) * 4
    body = np.frombuffer(raw, np.uint8, rows * line, at).reshape(rows, line)
    if height > 0:
        body = body[::-1]
    if depth >= 24:
        out = body[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    else:
        palette = np.frombuffer(raw, np.uint8, 4 * (colours or 1 << depth), 14 + size).reshape(-1, 4)[:, 2::-1]
        if depth == 8:
            index = body[:, :width]
        else:
            bits = np.unpackbits(body, axis=1).reshape(rows, -1, depth)
            index = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :width]
        out = palette[index]
    grey = (out[:, :, 0] == out[:, :, 1]).all() and (out[:, :, 1] == out[:, :, 2]).all()
    return np.ascontiguousarray(out[:, :, 0] if grey else out)


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(a: np.ndarray, rows: int, columns: int, strip: int = 4096) -> np.ndarray:
    """Means over equal areas of a grey image, as doubles.

    The integral image holds the sum of all samples above and left of a corner; a cell's sum is
    the difference of four corners, and corners between samples are interpolated, which is exact
    for samples that are constant over their area. Strips of rows keep memory bounded.
    """
    y, x = np.linspace(0, a.shape[0], rows + 1), np.linspace(0, a.shape[1], columns + 1)
    y0, x0 = np.minimum(y.astype(int), a.shape[0] - 1), np.minimum(x.astype(int), a.shape[1] - 1)
    fy, fx = y - y0, x - x0
    corners = np.zeros((rows + 1, columns + 1))
    above = np.zeros(columns + 1)
    for at in range(0, a.shape[0], strip):
        part = a[at : at + strip]
        integral = np.zeros((len(part) + 1, a.shape[1] + 1), np.int64)
        np.cumsum(np.cumsum(part, 0, dtype=np.int64), 1, out=integral[1:, 1:])
        across = integral[:, x0] * (1 - fx) + integral[:, x0 + 1] * fx
        for k in np.flatnonzero((y0 >= at) & (y0 < at + len(part))):
            i = y0[k] - at
            corners[k] = above + across[i] * (1 - fy[k]) + across[i + 1] * fy[k]
        above = above + across[-1]
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return cells / (a.shape[0] * a.shape[1] / (rows * columns))


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else ((a.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(np.uint8)


def difference_hash(a: np.ndarray, size: int = 8) -> str:
    """Whether each mean of a grey image is over the one left of it: size * size bits as hex."""
    m = np.round(area_resize(grey(a), size, size + 1), 6)
    return np.packbits(m[:, 1:] > m[:, :-1]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    """NPY file, version 1.0, of an array in C order."""
    head = f"{{'descr': '{a.dtype.str}', 'fortran_order': False, 'shape': ({', '.join(map(str, a.shape))}{',' * (a.ndim == 1)}), }}"
    head += " " * (-(10 + len(head) + 1) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + np.ascontiguousarray(a).tobytes()


def tile(a: np.ndarray, size: int = 16) -> bytes:
    """Area-resized square tile of 8-bit samples as an NPY file."""
    return npy(np.clip(np.rint(area_resize(grey(a), size, size)), 0, 255).astype(np.uint8))


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8, with zeros up to a positive multiple of 64 bytes, and how long it was before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


FORMATS = {"pgm": encode_pgm, "bmp": encode_bmp}


def store(raw: bytes, form: str = "pgm") -> bytes:
    """The payload as a grey image of 64 columns: a Netpbm grey map, or a bitmap of 8 bits."""
    return FORMATS[form](np.frombuffer(raw, np.uint8).reshape(-1, ROW))


def media(docs: DataFrame, form: str = "pgm", with_files: bool = False) -> DataFrame:
    """Stored and read back: each row of `docs` (doc_id, text) as an image, with digests, its difference
    hash and its NPY tile.

    A null text counts as empty: 64 zeros. Repeated rows come back each; equal texts have equal
    values; other columns are not looked at. with_files adds the image itself.
    """

    def run(batches: Batches) -> Batches:
        for b in slices(batches, 500):
            out: list[tuple] = []
            for text in b.column(1).to_pylist():
                raw, n = payload(text)
                stored = store(raw, form)
                image = decode(stored)
                back = image.tobytes()
                small = tile(image)
                marks = difference_hash(image)
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{marks}-{zlib.crc32(small):08x}", marks, small)
                out.append((*row, stored) if with_files else row)
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()] + [pa.binary()] * with_files
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "difference_hash", "tile"] + ["image"] * with_files
    types = ["long", "long", "string", "long", "long", "string", "string", "string", "binary"] + ["binary"] * with_files
    return map_batches(docs.select("doc_id", "text"), run, ", ".join(f"{n} {t}" for n, t in zip(["doc_id", *names], ["long", *types], strict=True)))
