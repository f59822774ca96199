"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers from 1 to the capacity, so the documents enter the search as a
histogram of at most `capacity` counts, however many there are. The driver packs the histogram;
each piece then finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, gathered, map_batches, partitions, written
from .tokens import chunk_ids, vocabulary

CAPACITY, END_ID = 4096, 1
#: Pieces of a filling that is tested for dominance, at most: the test tries all ways to deal them.
DEALT = 6
#: Nodes that the search visits at most, and fillings a node; pack() returns how far the result may be
#: from the optimum.
NODES, STEPS = 200, 50

#: Filling of a sequence: (length, how many) with descending lengths; how many sequences have it.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of `docs` (doc_id, text): ids, then end_id, cut only where longer than capacity.

    A null or empty text gives one piece that holds end_id alone. Repeated rows give their pieces
    each. Other columns are not looked at. with_ids adds the ids themselves.
    """
    path = path or vocabulary()

    def run(batches: Batches) -> Batches:
        ids, end, wide = chunk_ids(path), end_id.to_bytes(4, "little"), 4 * capacity
        for b in gathered(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, got in zip(b.column(0).to_pylist(), ids.texts(b.column(1).to_pylist()), strict=True):
                got += end
                for k, at in enumerate(range(0, len(got), wide)):
                    part = got[at : at + wide]
                    for column, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in out[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_batches(docs.select("doc_id", "text"), run, schema)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: what the sum needs, and for each threshold k what the pieces
    over capacity - k, over half, and the rest of at least k need."""
    if not counts:
        return 0
    v = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[x] for x in v.tolist()], dtype=np.int64)
    number, total = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * v))
    half = np.searchsorted(v, capacity // 2, "right")
    at = np.arange(half)  # thresholds: lengths of half the capacity at most
    big = np.searchsorted(v, capacity - v[:half], "right")
    free = capacity * (number[big] - number[half]) - (total[big] - total[half])
    small = total[half] - total[at]
    need = number[-1] - number[half] + np.maximum(0, -((free - small) // capacity))
    return int(max(-(-total[-1] // capacity), number[-1] - number[half], need.max(initial=0)))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, on equal sequences at once: what item-by-item best fit gives.

    Sequences are kept by their room; a bit set of the rooms finds the least that a length fits into."""
    room: dict[int, list[tuple]] = {}
    rooms = 0
    done: Plan = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        moved: list[tuple] = []
        while left and (fit := rooms >> length):
            rest = length + (fit & -fit).bit_length() - 1
            each, groups = rest // length, room[rest]
            while left and groups:
                filling, many = groups.pop()
                k = min(many, left // each)
                if k:
                    moved.append((filling + ((length, each),), k, rest - each * length))
                left, many = left - k * each, many - k
                if many and left:  # fewer than `each` are left: they go into one more sequence
                    moved.append((filling + ((length, left),), 1, rest - left * length))
                    left, many = 0, many - 1
                if many:
                    groups.append((filling, many))
            if not groups:
                del room[rest]
                rooms ^= 1 << rest
        each = capacity // length
        if left // each:
            moved.append((((length, each),), left // each, capacity - each * length))
        if left % each:
            moved.append((((length, left % each),), 1, capacity - left % each * length))
        for filling, many, rest in moved:
            if rest:
                room.setdefault(rest, []).append((filling, many))
                rooms |= 1 << rest
            else:
                done.append((filling, many))
    return done + [x for groups in room.values() for x in groups]


def _fits(items: tuple[int, ...], bins: tuple[int, ...]) -> bool:
    """Whether the items can be dealt to bins of these sizes."""
    if not items:
        return True
    return any(_fits(items[1:], bins[:i] + (b - items[0],) + bins[i + 1 :]) for i, b in enumerate(bins) if b >= items[0])


def _under(c: tuple[int, ...], k: tuple[int, ...]) -> bool:
    return len(c) <= len(k) and all(x <= y for x, y in zip(c, k, strict=False))


def completions(rest: int, lengths: list[int], counts: dict[int, int]) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of `rest` by any number of pieces, least waste first, larger pieces
    first; None for each filling that is left out. lengths: descending, those left.

    The sums that can be reached by each length and those after it are bit sets, so every filling
    is found without a dead end. A filling is dominated, and left out, if another piece still fits in
    or if its pieces fit into the places that the pieces of another take; those of more than DEALT
    pieces are only tested place by place.
    """
    fit = [x for x in lengths if x <= rest and counts[x]]
    if not fit or fit[0] == rest:
        yield tuple(fit[:1])  # nothing fits, or one piece that leaves no waste and so dominates everything
        return
    mask, reach = (1 << rest + 1) - 1, [1]
    for x in reversed(fit):
        sums, left, step = reach[-1], min(counts[x], rest // x), 1
        while left:
            step = min(step, left)
            sums |= sums << step * x & mask
            left, step = left - step, 2 * step
        reach.append(sums)
    reach.reverse()  # reach[i]: of fit[i:]

    def fillings(total: int) -> Iterator[tuple[int, ...]]:
        todo: list[tuple[int, int, tuple[int, ...]]] = [(total, 0, ())]
        while todo:
            total, i, made = todo.pop()
            if not total:
                yield made
            elif reach[i] >> total & 1:
                x = fit[i]
                for k in range(min(counts[x], total // x) + 1):  # the most pieces of x come out first
                    if reach[i + 1] >> total - k * x & 1:
                        todo.append((total - k * x, i + 1, made + (x,) * k))

    kept: list[tuple[int, ...]] = []
    sums = reach[0]
    while sums > 1:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        for c in fillings(total):
            more = next((x for x in reversed(fit) if counts[x] > c.count(x)), rest) <= rest - total
            if more or any(_under(c, k) or len(c) <= DEALT and len(k) <= DEALT and _fits(c, k) for k in kept):
                yield None
            else:
                kept.append(c)
                yield c


@dataclass
class _Node:
    """A partial packing: what is left, the sequences filled, and the filling last chosen."""

    lengths: np.ndarray
    counts: np.ndarray
    chosen: Plan
    used: int
    last: tuple | None
    seen: int = 0  # branches looked at
    open: Iterator | None = None  # the others, while this node is the deepest

    def left(self) -> dict[int, int]:
        return dict(zip(self.lengths.tolist(), self.counts.tolist(), strict=True))


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """Bin completion: branch on the fillings around the longest piece left, and on how many
    sequences have each.

    Best fit gives the first incumbent, and one at each node for what is left there. A filling is
    cut where its waste is more than the incumbent leaves to waste, a branch where the sequences used
    and the lower bound of the rest reach the incumbent. Sequences with the same longest piece are
    filled in one order only. The search ends when the incumbent meets the lower bound or all is
    searched (then it is optimal), or after `nodes` nodes or STEPS times as many fillings. Nodes above
    the deepest keep their counts alone, so that memory stays at some 50 KB a node.
    """
    floor, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    size = sum(m for _, m in best)

    def branches(node: _Node) -> Iterator[_Node | None]:
        left = node.left()
        lengths = node.lengths.tolist()
        top, held = lengths[0], int(node.lengths @ node.counts)
        for c in completions(capacity - top, lengths, {**left, top: left[top] - 1}):
            if c is None:
                yield None
                continue
            waste = capacity - top - sum(c)
            if waste > (size - 1 - node.used) * capacity - held:
                return  # so would be all that follow
            last = top, waste, tuple(-x for x in c)
            if node.last and node.last[0] == top and last <= node.last:
                yield None
                continue
            need = Counter((top, *c))
            filling = tuple(sorted(need.items(), reverse=True))
            taken = np.array([need.get(x, 0) for x in lengths])
            for many in range(min(left[x] // k for x, k in need.items()), 0, -1):
                after = node.counts - many * taken
                yield _Node(node.lengths[after > 0], after[after > 0], [*node.chosen, (filling, many)], node.used + many, last)

    lengths = np.array(sorted(counts, reverse=True), np.int64)
    stack = [_Node(lengths, np.array([counts[x] for x in lengths.tolist()], np.int64), [], 0, None)] if counts else []
    steps = STEPS * nodes
    while stack and size > floor and nodes > 0 and steps > 0:
        node = stack[-1]
        if node.open is None:
            node.open = branches(node)
            for _ in range(node.seen):
                next(node.open, None)
        child = next(node.open, stack)
        node.seen, steps = node.seen + 1, steps - 1
        if child is stack:
            stack.pop()
        if not isinstance(child, _Node):
            continue
        nodes -= 1
        left = child.left()
        if child.used + lower_bound(left, capacity) >= size:
            continue
        rest = best_fit(left, capacity)
        if child.used + sum(m for _, m in rest) < size:
            best, size = child.chosen + rest, child.used + sum(m for _, m in rest)
        if left:
            node.open = None
            stack.append(child)
    return best


def places(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces a sequence, first sequence, offset) by first rank."""
    out: dict[int, list] = {}
    seen: Counter = Counter()
    sequence = 0
    for filling, many in plan:
        offset = 0
        for length, each in filling:
            out.setdefault(length, []).append((seen[length], each, sequence, offset))
            seen[length] += each * many
            offset += each * length
        sequence += many
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id, offset and over_bound to `pieces` (doc_id, piece, start, length, ids_crc32).

    Every piece gets a place; places in a sequence follow each other without gaps from 0. Equal
    pieces are interchangeable. over_bound is how many sequences more than the lower bound there are: 0
    means that none could do with fewer. No pieces: no rows. Lengths are from 1 to capacity.
    """
    spark = pieces.sparkSession
    salts = 2 * partitions(spark)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    salted = written(pieces.select(*names, salt.alias("salt")))  # written, so that a row keeps its salt
    counts = written(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = complete(histogram, capacity, nodes)
    over = sum(m for _, m in plan) - lower_bound(histogram, capacity)
    shared = spark.sparkContext.broadcast(places(plan))
    first = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select(*names, (F.col("rank") + F.col("first")).alias("rank"))

    def run(batches: Batches) -> Batches:
        table = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                t, r = table[int(length[rows[0]])], rank[rows]
                i = np.searchsorted(t[:, 0], r, "right") - 1
                k = r - t[i, 0]
                sequence[rows] = t[i, 2] + k // t[i, 1]
                offset[rows] = t[i, 3] + k % t[i, 1] * length[rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), pa.array(np.full(len(rank), over))], [*names, "sequence_id", "offset", "over_bound"])

    return map_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, over_bound long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Pieces of whole documents, each with its place in as few sequences as the search finds.

    Defined cases: see cut() and pack().
    """
    return pack(cut(docs, path, capacity), capacity, nodes)
