"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into segments of 22, 21 and 21. If two fingerprints differ in at
most three bits, then some pair of segments differs in at most (0, 1), (1, 0) or (1, 1) bits, and
it is (1, 1) only if all three segments differ in one, so that the first pair shows it. Each
segment, filled up with zeros to 23 bits, decodes to the one codeword of the perfect Golay code
within three bits. A segment one bit away decodes to one of the codewords that the segment's own
neighbours decode to. So each fingerprint stands in an index under its own codeword indices,
and asks under those of its neighbours too: several keys, of which one at least must meet.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, Written, fresh, map_batches, slices
from .components import connected_components

WIDTHS = (22, 21, 21)
#: Of the Golay code of 23 bits: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
PAIRS = ((0, 1), (0, 2), (1, 2))
DISTANCE = 3


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits: each is set if over half of the shingles' XXH64 (seed 42) have it set.

    Null and empty texts, and texts of white space, give zero; fewer words than width make one
    shingle of what there is.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, 50_000):
        part = words[at : min(n, at + 50_000) + width - 1]
        rows = [b" ".join(x) for x in zip(*(part[i:] for i in range(width)), strict=False)] if len(part) >= width else [b" ".join(part)]
        bits = np.unpackbits(np.array([digest(x, 42) for x in rows], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            counts += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of division by the generator: 11 bits that are zero for codewords only."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """By remainder, the one pattern of at most three wrong bits that leaves it."""
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    words = np.array(patterns, np.int64)
    out = np.full(1 << 11, -1, np.int64)
    out[_remainder(words)] = words
    assert (out >= 0).all()
    return out


def decode(segments: np.ndarray) -> np.ndarray:
    """Index, of 12 bits, of the codeword within three bits of each 23-bit word."""
    return (segments ^ _errors()[_remainder(segments)]) >> 11


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """decode() of all words of 22 bits."""
    part = np.arange(1 << 18, dtype=np.int64)  # in parts, for memory
    return np.concatenate([decode(part + at).astype(np.int16) for at in range(0, 1 << 22, 1 << 18)])


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in WIDTHS:
        out.append((fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def index_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): a key for each pair of segments."""
    own = [_table()[s].astype(np.int64) for s in _segments(fp)]
    keys = np.stack([(k << 24) | (own[i] << 12) | own[j] for k, (i, j) in enumerate(PAIRS)], 1)
    return np.repeat(np.arange(len(fp)), len(PAIRS)), keys.ravel()


def probe_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each pair of segments, own index with the neighbours' indices and the other
    way round; for the first pair, neighbours' with neighbours' too. Each key of a row once."""
    near = []
    for s, width in zip(_segments(fp), WIDTHS, strict=True):
        flips = np.concatenate([[0], 1 << np.arange(width)])
        near.append(_table()[s[:, None] ^ flips].astype(np.int64))
    found = []
    for k, (i, j) in enumerate(PAIRS):
        a, b = near[i], near[j]
        if k == 0:
            keys = [_distinct_product(a, b)]
        else:
            keys = [_distinct_product(a[:, :1], b), _distinct_product(a[:, 1:], b[:, :1])]
        for rows, key in keys:
            found.append((rows, (k << 24) | key))
    rows, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique(rows << 26 | keys)
    return both >> 26, both & ((1 << 26) - 1)


def _distinct_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of a << 12 | index of b) for the distinct indices of each row."""
    pairs = []
    for x in (a, b):
        own = np.unique((np.arange(len(x))[:, None] << 12 | x).ravel())
        pairs.append((own >> 12, own & 4095))
    (ra, ia), (rb, ib) = pairs
    n = np.bincount(rb, minlength=len(a))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    times = n[ra]
    left = np.repeat(np.arange(len(ra)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + first[ra[left]]
    return ra[left], ia[left] << 12 | ib[right]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of `docs` (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Batches) -> Batches:
        for b in slices(batches):
            fp = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _keys(of) -> callable:
    def run(batches: Batches) -> Batches:
        for b in slices(batches, 2000):
            fp = b.column(0).to_numpy()
            rows, keys = of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return run


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints of `fps` (fp) that differ in at most three bits.

    Pairs are made within a key only and checked in the join; each is given once.
    """
    index = map_batches(fps.select("fp"), _keys(index_keys), "key long, fp long")
    probe = map_batches(fps.select("fp"), _keys(probe_keys), "key long, fp long")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= DISTANCE
    return probe.alias("p").join(index.alias("i"), (F.col("p.key") == F.col("i.key")) & (F.col("p.fp") < F.col("i.fp")) & near).select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) of each row of `docs` (doc_id, text).

    Rows whose fingerprints differ in at most three bits are linked; component_id is the smallest
    doc_id reachable over links, kept marks it. Null and empty texts have fingerprint zero and are
    linked like others. Rows without doc_id take part, and their id is never the smallest unless
    no row of the component has one (then component_id is null). Repeated rows come back each. Only
    distinct fingerprints enter the search, so copies make no pairs.
    """
    rows = Written(fingerprints(docs, width)).df
    groups = Written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"))).df
    parts = connected_components(links(groups))
    named = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    named = Written(named).df
    least = named.groupBy("part").agg(F.min("first").alias("component_id"))
    labels = Written(named.join(least, "part").select("fp", "component_id")).df
    return rows.join(labels, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_first(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows of `docs` that stay: one of each component, with its smallest doc_id. All columns as they
    are. Of several rows with that doc_id and equal texts one stays; rows without doc_id stay. No
    rows: no rows. Null and empty texts are copies of each other.
    """
    (name,) = fresh(docs.columns, "__doc")
    kept = near_duplicates(docs.where("doc_id is not null"), width).where("kept").select(F.col("doc_id").alias(name)).distinct()
    mine = docs.where("doc_id is not null").join(kept, docs["doc_id"] == F.col(name), "left_semi")
    return mine.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
