"""Near-duplicate vectors over an inverted multi-index.

Vectors are scaled to length one and cut into halves. Each half has its own codebook, and a vector's
cell is the pair of its halves' nearest codes. A vector visits cells in multi-sequence order, that of
the sum of both squared distances, until the sum is more than a margin over that of its own cell; the
margin is set from the recall that a bounded sample needs. What is found is verified in double
precision.

All cells of a left code are one group. A vector goes to its own group, and once to each group of a
greater left code in which it visits cells, with the list of these, so that few copies of vectors are
shuffled and each pair of groups meets in one of both directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, Written, map_batches, partitions, thinned
from .components import connected_components, forest

#: Distinct vectors that codebooks are fitted on at most, in all and for each code; vectors of a cell;
#: found share of pairs at the very threshold; vectors of one block of a group.
SAMPLE, PER_CODE, PER_CELL, TARGET, BLOCK = 20_000, 16, 64, 0.95, 16_384
#: Codes of a half at most: cells hold more than PER_CELL vectors beyond CODES * CODES * PER_CELL.
CODES = 4096
#: Lengths of vectors that get codebooks at most, those of most vectors; each other length is one cell.
WIDTHS = 32
THRESHOLD = 0.9


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[at : at + 4096], codes).argmin(1) for at in range(0, len(x), 4096)])


def _codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    draw = np.random.default_rng(seed)
    codes = x[draw.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, codes)
        order, n = np.argsort(near, kind="stable"), np.bincount(near, minlength=k)
        held = n > 0
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[held])[:-1]]))
        codes = x[draw.integers(0, len(x), k)]
        codes[held] = sums / n[held][:, None]
    return codes


@dataclass
class Index:
    left: np.ndarray
    right: np.ndarray
    margin: float = 0.0

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _squares(x[:, :half], self.left), _squares(x[:, half:], self.right)

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, left code, right code) of every cell that each row visits: multi-sequence order, nearest
        first, up to the margin. Rows follow each other."""
        a, b = self.costs(x)
        i, j = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        row = np.arange(len(x))[:, None]
        a, b = a[row, i], b[row, j]
        room = self.margin + 1e-12
        wide, high = (max(1, int((c - c[:, :1] <= room).sum(1).max(initial=1))) for c in (a, b))  # no cell beyond these is near enough
        over = (a[:, :wide] - a[:, :1])[:, :, None] + (b[:, :high] - b[:, :1])[:, None, :]
        r, p, q = np.nonzero(over <= room)
        order = np.lexsort((over[r, p, q], r))
        r, p, q = r[order], p[order], q[order]
        return r, i[r, p], j[r, q]


def fit(sample: np.ndarray, count: int, threshold: float, target: float = TARGET, per_cell: int = PER_CELL, seed: int = 5) -> Index:
    """Codebooks for `count` unit vectors, and the margin.

    Calibration: each of up to 2000 sampled vectors gets a random partner at exactly the
    threshold, and the margin is what finds `target` of these; nearer ones are found more often.
    """
    k = codes(count, per_cell, len(sample))
    half = max(1, sample.shape[1] // 2)
    index = Index(_codebook(sample[:, :half], k, seed), _codebook(sample[:, half:], k, seed + 1) if sample.shape[1] > half else np.zeros((1, 0)))
    draw = np.random.default_rng(seed)
    x = sample[draw.permutation(len(sample))[:2000]]
    away = draw.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    norm = np.linalg.norm(away, axis=1)
    away /= np.where(norm > 0, norm, 1)[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * away
    over = np.zeros(len(x))
    for mine, theirs in zip(index.costs(x), index.costs(y), strict=True):
        over += mine[np.arange(len(x)), theirs.argmin(1)] - mine.min(1)
    index.margin = float(np.quantile(over, target, method="higher"))
    return index


def codes(count: int, per_cell: int = PER_CELL, sampled: int | None = None) -> int:
    """Codes of each half for so many vectors, out of a sample of so many."""
    most = CODES if sampled is None else min(CODES, max(1, sampled // 4))
    return int(np.clip(round((count / per_cell) ** 0.5), 1, most))


@dataclass
class Indexes:
    """By length of vectors: its index, or None for one cell."""

    known: dict[int, Index | None] = field(default_factory=dict)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = self.known.get(x.shape[1])
        if index is None:
            return np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        return index.traverse(x)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _groups(b: pa.RecordBatch, column: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch whose vectors are of one length, and these as a matrix."""
    size = b.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for s in np.unique(size):
        every = b.filter(pa.array(size == s))
        for at in range(0, every.num_rows, rows):
            part = every.slice(at, rows)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, s)


def _fitted(classes: DataFrame, threshold: float, target: float) -> Indexes:
    """Indexes of the lengths of most vectors, each on a bounded sample."""
    out = Indexes()
    sizes = classes.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "width").limit(WIDTHS).collect()
    for width, count in (tuple(r) for r in sizes if codes(r["c"]) > 1):
        wanted = max(SAMPLE, PER_CODE * codes(count))
        mine = thinned(classes.where(F.size("x") == width), F.col("first"), F.lit(count), wanted).orderBy(F.xxhash64("first"), "first").limit(wanted)
        sample = _units(np.array([r[0] for r in mine.select("x").collect()]))
        out.known[width] = fit(sample, count, threshold, target)
    return out


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of `table`.

    Links are pairs of cosine `threshold` or more, in double precision, that the index finds; none
    below it. Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing; vectors of different lengths don't link either. Rows of equal vectors link with each
    other: they enter the search once, under their smallest id. Rows with one id and different
    vectors are one node, whose links add up. Rows without an id link like others, but are never the
    smallest; where all rows of a vector have none, it links with nothing. No rows: no rows.
    """
    spark = table.sparkSession
    x = F.col(f"`{vector}`")
    kind = "float" if "array<float>" == dict(table.dtypes)[vector] else "double"
    x = x.cast(f"array<{kind}>")
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), F.when(fine, x).alias("x"))
    rows = rows.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(7), "x")})  # a class's name: 128 bits of its vector
    classes = Written(rows.where("x is not null").groupBy("k1", "k2", "x").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("first is not null")).df
    shared = spark.sparkContext.broadcast(_fitted(classes, threshold, target))
    schema = f"width int, left int, asks int, first long, n long, x array<{kind}>, cell int, cells array<int>"

    def placed(batches: Batches) -> Batches:
        """A row for the own group of each vector, and one for each greater one that it visits."""
        for b in batches:
            for part, raw in _groups(b, 2, 500):
                row, left, right = shared.value.place(_units(raw))
                own = np.flatnonzero(np.diff(row, prepend=-1))  # the nearest cell comes first
                mine, cell = left[own], right[own]
                keep = left >= mine[row]
                row, left, right = row[keep], left[keep], right[keep]
                order = np.lexsort((left, row))
                row, left, right = row[order], left[order], right[order]
                at = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(left, prepend=-1) != 0))
                r = row[at]
                cells = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(right.astype(np.int32)))
                took = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), raw.shape[1], np.int32)), pa.array(left[at].astype(np.int32)), pa.array((left[at] != mine[r]).astype(np.int32)), *took.columns, pa.array(cell[r].astype(np.int32)), cells], ["width", "left", "asks", "first", "n", "x", "cell", "cells"])

    spread = map_batches(classes.select("first", "n", "x"), placed, schema)
    sizes = spread.where("asks = 0").groupBy("width", "left").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = Written(sizes.where("blocks > 1")).df  # groups of over BLOCK vectors: a code or a length each
    spread = spread.join(F.broadcast(sizes), ["width", "left"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("asks") == 0, F.array(F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    # vectors of one group but of different blocks meet too: each asks the blocks before its own
    within = F.when((F.col("asks") == 0) & (F.col("blocks") > 1), F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k < F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))).otherwise(F.array().cast("array<int>"))
    to = F.concat(F.transform(block, lambda k: F.struct(k.alias("block"), F.col("asks").alias("asks"))), F.transform(within, lambda k: F.struct(k.alias("block"), F.lit(2).alias("asks"))))
    names = ["first", "n", "x", "cell", "cells"]
    met = spread.select("width", "left", F.inline(to), *names).select("width", "left", "block", "asks", *names)
    met = met.repartition(4 * partitions(spark), "width", "left", "block").sortWithinPartitions("width", "left", "block", "asks", "cell", "first")
    found = Written(map_batches(met, _verified(threshold), "a long, b long, links long")).df
    parts = connected_components(found.where("links = 0").select("a", "b"))
    totals = found.where("links > 0").groupBy(F.col("a").alias("first")).agg(F.sum("links").alias("links"))
    named = classes.select("k1", "k2", "first", "n").join(totals, "first", "left").join(parts.withColumnRenamed("node", "first"), "first", "left")
    labels = named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "first").alias("component"))
    out = rows.where("x is not null").join(labels, ["k1", "k2"], "left").select("id", "links", "component")
    out = out.union(rows.where("x is null").select("id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


@dataclass
class _Stored:
    """The vectors of a block, by cell."""

    at: tuple
    first: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    cell: np.ndarray
    visits: np.ndarray  # whether each vector visits each cell of its group

    def of(self, cell: int) -> slice:
        return slice(*np.searchsorted(self.cell, [cell, cell + 1]))


def _verified(threshold: float):
    def f(batches: Batches) -> Batches:
        """Reads the vectors of a block of a group, then those that ask for its cells."""
        held: list[tuple] = []
        block: _Stored | None = None
        links: dict[int, int] = {}
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def meet(first, n, unit, b: _Stored, s: slice, pairs: np.ndarray | None = None) -> None:
            """Links of vectors with those of a cell; pairs: which of them count."""
            cosine = unit @ b.unit[s].T
            hit = cosine >= threshold - 1e-12
            if pairs is not None:
                hit &= pairs
            i, j = np.nonzero(hit)
            close = np.flatnonzero(np.abs(cosine[i, j] - threshold) < 1e-9)
            under = [k for k in close if _cosine(unit[i[k]], b.unit[s][j[k]]) < threshold]
            i, j = np.delete(i, under), np.delete(j, under)
            if not len(i):
                return
            theirs, many = b.first[s][j], b.n[s][j]
            for ids, count in ((first[i], many), (theirs, n[i])):
                ids, at = np.unique(ids, return_inverse=True)
                for k, v in zip(ids.tolist(), np.bincount(at, count, len(ids)).astype(np.int64).tolist(), strict=True):
                    links[k] = links.get(k, 0) + v
            edges.append(forest(first[i], theirs))

        def ask(first, n, unit, cell, cells, b: _Stored, same: bool) -> None:
            """Rows that visit cells (lists) of the block; same: they are of its group, so that vectors
            of it may visit their cells, and a pair counts where either visits the other's."""
            of, row = np.concatenate(cells) if len(cells) else np.zeros(0, int), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            for c in np.unique(b.cell) if same else np.unique(of):
                s = b.of(c)
                if s.start == s.stop:
                    continue
                asked = np.zeros(len(first), bool)
                asked[row[of == c]] = True
                if not same:
                    rows = np.flatnonzero(asked)
                    meet(first[rows], n[rows], unit[rows], b, s)
                    continue
                either = asked[:, None] | b.visits[s][:, np.minimum(cell, b.visits.shape[1] - 1)].T & (cell < b.visits.shape[1])[:, None]
                rows = np.flatnonzero(either.any(1))
                if len(rows):
                    meet(first[rows], n[rows], unit[rows], b, s, either[rows])

        def store() -> None:
            """Puts what is held together, and lets its vectors meet: each those after it."""
            nonlocal block
            at = held[0][0]
            first, n, unit, cell = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            cells = [c for h in held for c in h[5]]
            visits = np.zeros((len(first), 1 + max([int(cell.max()), *(int(c.max()) for c in cells if len(c))])), bool)
            visits[np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells)] = True
            held.clear()
            block = _Stored(at, first, n, unit, cell, visits)
            for c in np.unique(cell):
                s = block.of(c)
                for k in range(0, len(first), 512):
                    rows = slice(k, min(k + 512, s.stop))  # cells come in order: those before and this one
                    if rows.start >= s.stop:
                        break
                    either = visits[rows, c][:, None] | visits[s][:, cell[rows]].T
                    either &= np.arange(rows.start, rows.stop)[:, None] < np.arange(s.start, s.stop)[None]
                    keep = np.flatnonzero(either.any(1))
                    if len(keep):
                        meet(first[rows][keep], n[rows][keep], unit[rows][keep], block, s, either[keep])

        def flush():
            if links:
                k = np.fromiter(links, np.int64, len(links))
                v = np.fromiter(links.values(), np.int64, len(links))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k), pa.array(v)], ["a", "b", "links"])
                links.clear()
            if edges:
                u, v = forest(*(np.concatenate(x) for x in zip(*edges, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), np.int64))], ["a", "b", "links"])
                edges.clear()

        for b in batches:
            keys = [b.column(i).to_numpy() for i in range(4)]
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], 0)) + 1 if b.num_rows else []
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                for k in range(s, e, 256):
                    part = b.slice(k, min(256, e - k))
                    here, asks = tuple(int(x[k]) for x in keys[:3]), int(keys[3][k])
                    if held and (asks or held[0][0] != here):
                        store()
                    raw = part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, here[0])
                    first, n, cell = (part.column(i).to_numpy() for i in (4, 5, 7))
                    cells = [c.values.to_numpy() for c in part.column(8)]
                    if not asks:
                        held.append((here, first, n, _units(raw), cell, cells))
                    elif block is not None and block.at == here:
                        ask(first, n, _units(raw), cell, cells, block, asks == 2)
            if len(links) > 100_000 or sum(len(x[0]) for x in edges) > 100_000:
                yield from flush()
        if held:
            store()
        yield from flush()

    return f


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of two vectors at the very threshold, with exact sums."""
    from math import fsum, sqrt

    return fsum(a * b) / sqrt(fsum(a * a) * fsum(b * b))
