"""Language identification with a string kernel.

Two texts' kernel is how many distinct n-grams of one to three letters both have, over the root
of the product of how many each has (a blended-spectrum presence kernel). A few training texts
of each language are landmarks; the Nyström map through their kernel matrix gives each text a
short vector, and ridge regression of one language against the rest is fitted on those.

Letters are code points of any script, and an n-gram is one whole number that holds them all, so no
two n-grams are ever taken for one another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, bucket_of, fresh, map_batches, slices, thinned, written

#: Training rows and landmarks of a language at most.
PER_LANGUAGE, LANDMARKS = 1000, 24
#: Languages that are learned at most, those with most rows, so that a dirty column stays bounded.
LANGUAGES = 200
#: A text is of no learned language where fewer of its n-grams than this share occur in any landmark.
#: Even one-word texts of a learned language have most of theirs; those in another script have none.
KNOWN = 0.2
UNDETERMINED = "und"
#: What stands for all that is no letter; 21 bits hold any code point and it.
BORDER, BITS = 0x110000, 21
#: Up to so many letters, n-grams of a text are marked in a table; up to this code point, so are letters.
DENSE, FEW = 160, 0x3000
_letter = re.compile(r"[^\W\d_]")
_is_letter = np.zeros(BORDER, bool)


def _letters() -> np.ndarray:
    if not _is_letter[97]:
        _is_letter[:] = [chr(i).isalpha() for i in range(BORDER)]
    return _is_letter


def has_letter(t: str) -> bool:
    return any(m[0].isalpha() for m in _letter.finditer(t))  # fractions and the like match too


def grams(text: str, part: int = 1 << 20) -> np.ndarray:
    """The distinct n-grams of one to three letters of a text, with a border before and after each
    word; long texts are read `part` letters at a time."""
    units = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    units = np.where(_letters()[units], units, 0)
    units = units[np.concatenate([[True], (units[1:] != 0) | (units[:-1] != 0)])]  # borders in a row are one
    letters = np.flatnonzero(np.bincount(units)) if units.max() < FEW else np.unique(units)
    n, name = len(letters), np.where(letters > 0, letters, BORDER).astype(np.int64)
    found = [name[letters > 0]]
    place = np.zeros(FEW, np.int64)
    if letters[-1] < FEW:
        place[letters] = np.arange(n)
    two, three = (np.zeros(n**k if n <= DENSE else 0, bool) for k in (2, 3))
    for at in range(0, len(units), part):
        a = units[at : at + part + 2]
        a = place[a] if letters[-1] < FEW else np.searchsorted(letters, a)
        pairs = a[:-1] * n + a[1:]
        triples = pairs[:-1] * n + a[2:]
        if n <= DENSE:
            two[pairs] = True
            three[triples] = True
        else:
            two, three = np.union1d(two, pairs).astype(np.int64), np.union1d(three, triples).astype(np.int64)
    if n <= DENSE:
        two, three = np.flatnonzero(two), np.flatnonzero(three)
    found += [name[two // n] << BITS | name[two % n], (name[three // (n * n)] << BITS | name[three // n % n]) << BITS | name[three % n]]
    return np.concatenate(found)


@dataclass
class Model:
    grams: np.ndarray  # that landmarks have, sorted
    landmarks: np.ndarray  # grams x landmarks, each column over the root of its count
    weights: np.ndarray  # landmarks x languages
    languages: list[str]

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernels of each text with each landmark, and the share of its n-grams that some landmark has."""
        rows = np.zeros((len(texts), len(self.grams)), np.float32)
        n = np.empty(len(texts))
        for i, t in enumerate(texts):
            has = grams(t)
            at = np.minimum(np.searchsorted(self.grams, has), len(self.grams) - 1)
            rows[i, at[self.grams[at] == has]] = 1
            n[i] = max(1, len(has))
        return (rows @ self.landmarks) / np.sqrt(n)[:, None], rows.sum(1) / n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, and the share of n-grams that landmarks know; `und`, 0 and 0 for
        null, for texts without a letter, and where no language was learned."""
        names, score, known = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if at and self.languages:
            kernels, known[at] = self.kernel([texts[i] for i in at])
            f = kernels @ self.weights
            p = np.exp(8 * (f - f.max(1, keepdims=True)))
            score[at] = (p / p.sum(1, keepdims=True)).max(1)
            for i, k in zip(at, f.argmax(1), strict=True):
                names[i] = self.languages[k]
        return names, score, known


def nystrom(has: list[np.ndarray], languages: list[str]) -> tuple[Model, np.ndarray]:
    """A model without weights over landmarks with these grams, and the root that maps kernels with
    them to vectors whose products are the landmarks' own kernels."""
    known = np.unique(np.concatenate(has))
    table = np.zeros((len(known), len(has)), np.float32)
    for k, g in enumerate(has):
        table[np.searchsorted(known, g), k] = 1 / np.sqrt(max(1, len(g)))
    between = table.T.astype(float) @ table
    values, vectors = np.linalg.eigh(between)
    keep = values > 1e-6 * values.max()
    return Model(known, table, np.zeros((len(has), len(languages))), languages), vectors[:, keep] / np.sqrt(values[keep])


def solve(total: np.ndarray, root: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of landmarks from the sums of x'x and x'y over all training rows, side by side."""
    m = len(total)
    inner, right = root.T @ total[:, :m] @ root, root.T @ total[:, m:]
    return root @ np.linalg.solve(inner + ridge * np.trace(inner) / len(inner) * np.eye(len(inner)), right)


def _gram_lists(batches: Batches) -> Batches:
    for b in slices(batches, 64, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.sort(grams(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["lang", "grams"])


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = 1e-3, most: int = LANGUAGES) -> Model:
    """Learns from `docs` (doc_id, text, lang) where `train` holds, lang isn't null and text has a
    letter. Of each of the `most` languages with most rows it takes the per_language rows of least
    hash, out of a share of its rows that holds eight times as many; no such rows, or no column lang:
    a model that knows no language. Of rows with one doc_id and lang, one is learned from."""
    spark, none = docs.sparkSession, Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), [])
    if "lang" not in docs.columns:
        return none
    labelled = docs.where(train & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    large = F.broadcast(sizes.orderBy(F.desc("size"), "lang").limit(most))  # `most` rows at most
    few = thinned(labelled.join(large, "lang"), F.col("doc_id"), F.col("size"), per_language)
    usable = few.where(F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = usable.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).distinct().withColumn("n", rank).where(F.col("n") <= per_language)
    chosen = written(chosen.select("doc_id", "lang", "n"))  # per_language rows for each language
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).where(F.col("text").rlike(r"\p{L}"))
    sample = written(sample.groupBy("doc_id", "lang", "n").agg(F.min("text").alias("text")).repartition(8))
    first = map_batches(sample.where(F.col("n") <= landmarks).select("lang", "text"), _gram_lists, "lang string, grams array<long>")
    first = sorted({(r["lang"], tuple(r["grams"])) for r in first.collect()})  # landmarks for each language
    if not first:
        return none
    languages = sorted({x[0] for x in first})
    model, root = nystrom([np.array(x[1], np.int64) for x in first], languages)
    at, m, k = {x: i for i, x in enumerate(languages)}, len(first), len(languages)
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Batches) -> Batches:
        total = np.zeros((m, m + k))
        for b in slices(batches, 64, 0):
            x, _ = shared.value.kernel(b.column(0).to_pylist())
            y = np.full((len(x), k), -1.0)
            y[np.arange(len(x)), [at[v] for v in b.column(1).to_pylist()]] = 1
            total += x.T @ np.hstack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["total"])

    known = sample.where(F.col("lang").isin(languages))
    total = sum(np.array(r[0]).reshape(m, m + k) for r in map_batches(known.select("text", "lang"), sums, "total array<double>").collect())
    model.weights = solve(total, root, ridge)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (with text; other columns stay), and as its last three columns the language, its score
    and the share of known n-grams (see Model.predict). Repeated rows come back each."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at, new = names.index("text"), fresh(names, "__lang_pred", "__score", "__known")

    def run(batches: Batches) -> Batches:
        for b in slices(batches, 64, at):
            lang, score, known = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(known)], [*names, *new])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema]
    return map_batches(docs, run, ", ".join([*fields, *(f"`{n}` {t}" for n, t in zip(new, ("string", "double", "double"), strict=True))]))


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of `docs` (doc_id, text, lang).

    Rows whose crc32 of doc_id modulo folds is `held` are never learned from; rows without
    doc_id neither (held_out is true). lang_pred is `und` for null texts and texts without a letter.
    """
    own = docs.select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), folds) == held, F.lit(True))
    got = predict(own.select("doc_id", "text"), fit(own, ~held_out))
    return got.select("doc_id", held_out.alias("held_out"), F.col(got.columns[-3]).alias("lang_pred"), F.col(got.columns[-2]).alias("score"))


def keep_identified(docs: DataFrame, least: float = KNOWN, model: Model | None = None) -> DataFrame:
    """Rows of `docs` (doc_id, text, lang) that are in some learned language, all columns as they are.

    The model is the one given, or learned from all labelled rows. Rejected, so gone: null texts, texts
    without a letter, and texts of which less than `least` of the n-grams are known, such as those in
    a script that no learned language has. Where nothing could be learned (no column lang, no labels),
    texts with a letter stay. No rows: no rows; repeated rows stay each."""
    model = model or fit(docs, F.col("doc_id").isNotNull())
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    got = predict(docs, model)
    return got.where((F.col(got.columns[-3]) != UNDETERMINED) & (F.col(got.columns[-1]) >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
