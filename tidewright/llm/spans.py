"""Substring dedup over sliding spans of sentences.

A text is cut into sentences, and every run of three consecutive sentences is hashed and counted over
all documents. Words whose runs stand elsewhere too are then compared exactly: each span of fifty words
all of whose runs come again is hashed itself and joined over all documents, so a passage of fifty words
or more that stands before goes to its very edges, and shorter repeats stay.

A sentence ends at a full stop, question or exclamation mark. Where none comes for eight words, the
least word hash of each eight in a row begins a new one, so that lines without marks, tables and lists
have sentences too, the same ones wherever they stand and however lines are broken: any span of fifty
words holds a whole run whose borders its own words decide. A word ends at white space; in scripts
that write none between words, each character is one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, fresh, map_batches, partitions, slices, written

#: Sentences of a run, most words of a sentence without an end, and words of the least passage that goes.
SENTENCES, LIMIT, LEAST_WORDS = 3, 8, 50
#: Bits of the map of runs that come again, and of each of its parts. A full map only costs time.
BITS, PART = 26, 21
#: A span of more than this share of all spans has its rows dealt over all partitions; there are at most 1 / HOT.
HOT = 1e-4
LOW = (1 << 32) - 1
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_weight = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_scales: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: First two bytes of characters of scripts without spaces, from and to: Thai and Lao, Burmese, Khmer, kana and Han.
_unspaced = ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B3))
#: Marks that end a sentence, of one byte and of more, and those that may follow one.
_wide_stops = [c.encode() for c in "…。！？।؟۔"]
_stops, _closing, _wide_last = np.zeros((3, 256), bool)
_stops[[*b".!?"]] = _closing[[*b"\"')]}"]] = _wide_last[[c[-1] for c in _wide_stops]] = True
_least = np.iinfo(np.int64).min


@dataclass
class Cut:
    raw: bytes  # the texts, with a line feed between them
    docs: np.ndarray  # first word of each text, and how many words there are
    at: np.ndarray  # byte of raw at which each word begins, and the end
    words: np.ndarray  # hash of each word
    starts: np.ndarray  # first word of each sentence, and how many words there are


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end] for each pair, the same wherever the values stand."""
    n = len(values)
    if len(_scales[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(2 * n + 1, base, np.uint64)
            factors[0] = 1
            _scales[i] = np.cumprod(factors)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _scales[0][:n], out=total[1:])
    return _mixed((total[end] - total[begin]) * _scales[1][begin])


def _extreme(h: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of each `width` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h, have = pick(h[: max(0, len(h) - step)], h[step:]), have + step
    return h


def _ends(a: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word a[begin:end] ends a sentence."""
    last, long = a[end - 1], end - begin > 1
    closed = _closing[last] & long
    last = np.where(closed, a[end - 2], last)
    out = _stops[last]
    for k in np.flatnonzero(_wide_last[last] & long):
        e = end[k] - closed[k]
        word = a[max(begin[k], e - 3) : e].tobytes()
        out[k] |= any(word.endswith(c) for c in _wide_stops)
    return out


def _sentences(words: np.ndarray, ends: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """First words of sentences, of `limit` words at most where no mark ends them before."""
    new = np.concatenate([[True], ends[:-1]])[: len(words)]
    if len(words) >= limit:
        h = words.view(np.int64)
        before = np.concatenate([[0], np.cumsum(ends)])
        low = _extreme(h, limit, np.minimum)
        low[before[limit - 1 : -1] > before[: -limit]] = _least  # an end within
        edge = np.full(limit - 1, _least)
        new |= _extreme(np.concatenate([edge, low, edge]), limit, np.maximum) == h
    return np.append(np.flatnonzero(new), len(words))


def cut(*texts: str | None) -> Cut:
    """Words and sentences of texts, of all in one go; no sentence goes over the end of a text."""
    parts = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    raw = b"\n".join(parts)
    a = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _space[a], [True]])
    new, over = ~space[1:] & space[:-1], ~space[:-1] & space[1:]
    wide = np.flatnonzero(a >= 0xE0)
    if len(wide):
        code = a[wide].astype(np.int32) << 8 | a[wide + 1]
        wide = wide[np.any([(code >= x) & (code <= y) for x, y in _unspaced], 0)]
        wide = np.concatenate([wide, wide + np.where(a[wide] >= 0xF0, 4, 3)])
        new[wide] = ~space[1:][wide]
        over |= new & ~space[:-1]
    begin, end = np.flatnonzero(new), np.flatnonzero(over)
    words = _hashes(_weight[a], begin, end)
    docs = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in parts)]))
    if not len(words):
        return Cut(raw, docs, np.array([len(raw)]), words, np.zeros(1, np.int64))
    ends = _ends(a, begin, end)
    ends[docs[1:][docs[1:] > 0] - 1] = True
    return Cut(raw, docs, np.append(begin, len(raw)), words, _sentences(words, ends))


def runs(c: Cut) -> np.ndarray:
    """Signed 64-bit hash of each run of SENTENCES consecutive sentences, over the ends of texts too."""
    return _hashes(c.words, c.starts[:-SENTENCES], c.starts[SENTENCES:]).view(np.int64)


def spans(c: Cut, words: int, at: np.ndarray) -> np.ndarray:
    """Signed 64-bit hash of the spans of so many words that begin at the words `at`."""
    return _hashes(c.words, at, at + words).view(np.int64)


def likely(c: Cut, again: np.ndarray, words: int) -> np.ndarray:
    """First words of spans that may stand elsewhere: those all of whose runs do. again: of each run.
    Only runs count whose borders lie LIMIT words inside the span, where words outside can't shift
    them; spans too short to hold one are all likely."""
    n = len(c.words)
    last = np.repeat(c.docs[1:], np.diff(c.docs))  # end of each word's text
    p = np.flatnonzero(np.arange(n) + words <= last)
    before = np.zeros(n + 2, np.int64)  # sentences that begin before each word
    before[c.starts + 1] = 1
    before = np.cumsum(before)
    bad = np.concatenate([[0], np.cumsum(~again)])
    lo = np.minimum(before[np.minimum(p + (LIMIT - 1), n + 1)], len(again))
    hi = np.minimum(np.maximum(before[np.maximum(p + (words - LIMIT) + 1, 0)] - SENTENCES, lo), len(again))
    return p[bad[hi] == bad[lo]]


def removed(c: Cut, starts: np.ndarray, words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(first, after last) words of each passage to remove, given the spans seen before."""
    step = np.zeros(len(c.words) + 2, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + words, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(step) > 0])))
    return [(int(i), int(j)) for i, j in zip(edges[::2], edges[1::2], strict=True)]


def _later(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash stands before in its document."""
    order = np.lexsort((h, doc))  # stable, so that the first comes first
    more = np.zeros(len(h), bool)
    more[order[1:]] = (np.diff(h[order]) == 0) & (np.diff(doc[order]) == 0)
    return more


def _counted_runs(batches: Batches) -> Batches:
    for b in slices(batches, 1000, 0, 1 << 19):
        c = cut(*b.column(0).to_pylist())
        first = c.starts[: max(0, len(c.starts) - SENTENCES)]
        whole = c.starts[SENTENCES:] <= np.repeat(c.docs[1:], np.diff(c.docs))[first]  # of one text
        keys, n = np.unique(runs(c)[whole], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32))], ["key", "n"])


def _part(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PART, bool)
    bits[table.column(1).to_numpy()] = True
    return pa.table([table.column(0).slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])


def _map_of(keys: DataFrame) -> np.ndarray:
    """Bit map of keys (key) by their low BITS bits: the driver gets 2^BITS bits at most."""
    low = F.col("key").bitwiseAND((1 << BITS) - 1)
    split = keys.select(F.shiftright(low, PART).cast("int").alias("part"), low.bitwiseAND((1 << PART) - 1).cast("int").alias("bit")).distinct()
    out = np.zeros((1 << BITS - PART, 1 << PART - 3), np.uint8)
    for r in split.groupBy("part").applyInArrow(_part, "part int, bits binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & ((1 << BITS) - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def _likely_spans(words: int, shared):
    def f(batches: Batches) -> Batches:
        for b in slices(batches, 1000, 1, 1 << 19):
            c = cut(*b.column(1).to_pylist())
            at = likely(c, _set(shared.value, runs(c)), words)
            h, i = spans(c, words, at), np.searchsorted(c.docs, at, "right") - 1  # of texts without words, none begins there
            doc = b.column(0).to_numpy(zero_copy_only=False)[i]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, (at - c.docs[i]).astype(np.int32), h, _later(i, h))], ["doc", "place", "key", "again"])

    return f


def repeats(docs: DataFrame, words: int = LEAST_WORDS) -> DataFrame:
    """(doc, hits) of documents with spans that stand before: a hit is the place, and
    the low half of the key.

    What stands before is ordered by doc_id, then place. Rows of equal doc_id are one document; rows
    without doc_id or text take no part. Repeats inside a document are marked where it is read, so
    that joining documents takes sums of plain numbers only.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    counted = map_batches(own.select("text"), _counted_runs, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(_map_of(counted.where("n > 1")))
    found = map_batches(own, _likely_spans(words, shared), "doc long, place int, key long, again boolean")  # read twice: writing them takes more
    many = found.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("again").alias("more"), F.count(F.lit(1)).alias("n"))
    many = written(many.where("first != last or more").select("key", "first", "n"))
    total = many.agg(F.sum("n")).first()[0] or 0
    hot, salts = many.where(F.col("n") > max(1000, HOT * total)).select("key", F.lit(True).alias("hot")), partitions(spark)
    found = found.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "place"), F.lit(salts)).cast("int")).otherwise(0))
    many = many.join(F.broadcast(hot), "key", "left").select("key", "first", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    later = found.join(many, ["key", "salt"]).where(F.col("again") | (F.col("doc") != F.col("first")))
    hit = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("key").bitwiseAND(LOW))
    return later.groupBy("doc").agg(F.collect_list(hit).alias("hits"))


def _mapped(ids: np.ndarray) -> np.ndarray:
    return _mixed(ids.view(np.uint64)).view(np.int64)


def _ids(batches: Batches) -> Batches:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_mapped(b.column(0).to_numpy()))], ["key"])


def deduplicate(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` (with doc_id and text), text without passages that stand before, and as its last column
    (start, end) of what went, in characters of the whole text. That column is __removed, with more
    underscores where docs has one of that name.

    Null texts stay null; a text that is one passage becomes empty. The white space after a
    passage goes with it. Repeated rows come back each; other columns stay as they are. No rows: no
    rows. Only texts of documents that may lose something are joined with their hits.
    """
    gone, doc, hits = fresh(docs.columns, "__removed", "__doc", "__hits")
    names = docs.columns
    at, key = names.index("text"), names.index("doc_id")
    found = written(repeats(docs, least_words))
    shared = docs.sparkSession.sparkContext.broadcast(_map_of(map_batches(found.select("doc"), _ids, "key long")))
    fields = ", ".join(f"`{x.name.replace('`', '``')}` {x.dataType.simpleString()}" for x in docs.schema)
    whole = f"{fields}, `{gone}` array<struct<start: int, end: int>>"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def touched(b: pa.RecordBatch) -> np.ndarray:
        ids = b.column(key).cast(pa.int64())
        return _set(shared.value, _mapped(ids.fill_null(0).to_numpy(zero_copy_only=False))) & ids.is_valid().to_numpy(zero_copy_only=False)

    def untouched(batches: Batches) -> Batches:
        for b in batches:
            b = b.filter(pa.array(~touched(b)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[]] * b.num_rows, spans_type)], [*names, gone])

    def looked_at(batches: Batches) -> Batches:
        for b in batches:
            yield b.filter(pa.array(touched(b)))

    def taken(batches: Batches) -> Batches:
        for b in slices(batches, 1000, at):
            texts, lost = b.column(at).to_pylist(), [[] for _ in range(b.num_rows)]
            for i, h in enumerate(b.column(len(names))):
                if h.is_valid and texts[i]:
                    texts[i], lost[i] = without(cut(texts[i]), h.values.to_numpy(), least_words)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lost, spans_type)], [*names, gone])

    some = map_batches(docs, looked_at, fields)
    some = some.join(found.withColumnsRenamed({"doc": doc, "hits": hits}), some["doc_id"] == F.col(f"`{doc}`"), "left").drop(doc)
    return map_batches(docs, untouched, whole).union(map_batches(some, taken, whole))


def without(c: Cut, hits: np.ndarray, words: int) -> tuple[str, list[dict[str, int]]]:
    """The text without the spans of `hits`, and what went. Hits of another text with that doc_id don't count."""
    at = np.unique(hits >> 32)
    at = at[at <= len(c.words) - words]
    known = np.isin(at << 32 | spans(c, words, at) & LOW, hits)
    left, kept, gone = 0, [], []
    for s, e in removed(c, at[known], words):
        s, e = int(c.at[s]), int(c.at[e])
        kept.append(c.raw[left:s])
        gone.append({"start": len(c.raw[:s].decode("utf-8", "surrogatepass")), "end": len(c.raw[:e].decode("utf-8", "surrogatepass"))})
        left = e
    return (b"".join(kept) + c.raw[left:]).decode("utf-8", "surrogatepass"), gone
