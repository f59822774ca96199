"""Secret scans: candidates by patterns, false positives removed by a random forest.

Everything on the data's path is a Catalyst expression. A text is split at its candidates, so each
candidate stands between the text before and after it, and its features, its score and the text
without secrets are array expressions of its own row: nothing is shuffled. The forest is grown on
the driver from a bounded table of labelled findings and becomes nested conditions.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# fixed values: public formats of credentials and words that name them
KEY_WORDS = "(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key|credential|bearer)"
_HEAD, _TAIL = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----", r"-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
FORMATS = {
    # up to its END, or where that is missing, over the lines that may be its body
    "private_key": rf"{_HEAD}(?:[^-]*+(?:-(?!----)[^-]*+)*+{_TAIL}|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{{16,}}+)*+)",
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
}
DICTIONARY = (
    "the and for that with this from have are not you all can her was one our out day get has him his how man new now old see two way who "
    "change example sample test dummy demo admin user name pass word secret token key value data file path home lib src bin usr etc var tmp "
    "version release build image html http https www com org net index page config default local host server client public private read write "
    "class method function object string number order item list table id uuid sha md5 commit hash none null true false your here insert foo bar baz"
).split()
PATH_MARKS = r"[/\\]|\.(?:com|org|net|io|html?|py|js|java|png|jpe?g|pdf|txt|json|xml|so|gz)\b|https?:"
NEAR_WORDS = r"(?i)(?:" + KEY_WORDS + r"|\bkey\b|\bcreds?\b|login)"
OTHER_WORDS = r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|uuid|guid|isbn|phone|tel|card|order|invoice|serial|version|image|href|src|id|ref)\b"
_NAMED = rf"(?:{KEY_WORDS})[\"']?[ ]{{0,2}}[:=][ ]{{0,2}}"
#: What is given to such a word: a private key, all up to the quote that closes, or a run of characters.
_GIVEN = (
    rf"[\"']?{FORMATS['private_key']}"
    + "".join(rf"|{q}(?=[^{q}\r\n]{{6}})(?:[^{q}\\\r\n]++|\\.)*+(?={q})" for q in "\"'")
    + r"|[\"']?[^\s\"'<>,;]{6,}+"
)
#: A candidate, whole however long: a known format, a value given to a word that names secrets, a
#: long word with a digit or with capitals inside, or a very long one of any letters.
CANDIDATE = (
    FORMATS["private_key"]
    + rf"|{_NAMED}(?:{_GIVEN})"
    + r"|" + FORMATS["jwt"]
    + r"|(?<![A-Za-z0-9])(?:" + "|".join(FORMATS[k] for k in ("aws_access_key", "github_token", "slack_token", "google_api_key")) + ")(?![A-Za-z0-9])"
    + r"|(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-]{16,}+|(?=(?:[A-Z+/_-]*+[a-z]++[A-Z]){3})[A-Za-z0-9+/_-]{20,}+|[A-Za-z+/_-]{32,}+)={0,2}"
)
VALUE = rf"^(?:{_NAMED}[\"']?)"
#: Characters of text on each side whose whole words are the neighbouring words.
CONTEXT = 48
#: Labelled findings, trees, depth and threshold of the forest.
FINDINGS, TREES, DEPTH, THRESHOLD = 6000, 20, 8, 0.5
NAMES = ("length", "digits", "uppers", "changes", "vowels", "dictionary", "marks", "path", "named", "near", "other", "format", "hex", "distinct")


def features(match: Column, before: Column, after: Column) -> Column:
    """Struct of NAMES as doubles, of a candidate and the text on both sides of it."""
    whole = F.regexp_replace(match, VALUE, "")
    value = F.regexp_replace(whole, rf"(?s)^({_HEAD}).*", "$1")  # a key is told by its header
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    whole_words = lambda part, cut, edge: F.when(F.length(part) > CONTEXT, F.regexp_replace(cut(part, F.lit(CONTEXT + 1)), edge, "")).otherwise(part)
    near = F.concat(whole_words(before, F.right, r"^\S+"), F.lit(" "), whole_words(after, F.left, r"\S+$"))
    words = F.lower(value)
    covered = F.length(value) - F.length(F.regexp_replace(words, "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))), ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]+", "\u0001"), "[a-z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    got = (
        F.least(n, F.lit(256.0)),
        share("[0-9]"),
        share("[A-Z]"),
        (F.length(kinds) - 1) / n,
        share("[aeiouAEIOU]"),
        covered / n,
        share("[^A-Za-z0-9]"),
        flag(value.rlike(PATH_MARKS) | F.right(before, F.lit(8)).rlike(r"[/\\.]$|https?:")),
        flag(F.length(whole) < F.length(match)),
        flag(near.rlike(NEAR_WORDS)),
        flag(near.rlike(OTHER_WORDS)),
        flag(value.rlike("^(?:" + "|".join(FORMATS.values()) + ")$")),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        F.array_size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
    )
    return F.struct(*(c.cast("double").alias(k) for k, c in zip(NAMES, got, strict=True)))


def labelled_findings(count: int = FINDINGS, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """(match, before, after, label) made by rule: secrets, and what looks like them."""
    r = random.Random(seed)
    pick = lambda letters, a, b=None: "".join(r.choice(letters) for _ in range(r.randint(a, b or a)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed, hexes = lower + upper + digits, "0123456789abcdef"
    syllables = "an be con der en fer ga ho in jo ka lo mi ne on pa que ra se ti un ver wa tion ent".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 7)))
    named = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key"]) + r.choice(["=", ": ", " = ", ' = "', '="', "='"])
    secrets = [
        lambda: (r.choice(["AKIA", "ASIA"]) + pick(upper + digits, 16), ""),
        lambda: ("gh" + r.choice("pousr") + "_" + pick(mixed, 36), ""),
        lambda: ("xoxb-" + pick(digits, 11) + "-" + pick(mixed, 24), ""),
        lambda: ("AIza" + pick(mixed + "_-", 35), ""),
        lambda: ("eyJ" + pick(mixed, 20, 60) + "." + pick(mixed, 30, 90) + "." + pick(mixed, 20, 43), ""),
        lambda: ("-----BEGIN " + r.choice(["RSA ", "", "EC ", "OPENSSH "]) + "PRIVATE KEY-----", ""),
        lambda: (named() + pick(hexes, 16, 64), ""),
        lambda: (named() + pick(mixed, 10, 48), ""),
        lambda: (named() + pick(mixed + "!#$%&*+-_", 8, 24), ""),
        lambda: (named() + word() + pick(digits, 1, 4) + r.choice(["", "!", "!!", pick(lower, 2, 4)]), ""),
        lambda: (named() + r.choice([str.upper, str.lower])(pick(hexes, 2, 4) * r.randint(5, 10)) + r.choice(["", "!", "!!"]), ""),
        lambda: (pick(mixed, 24, 64), r.choice(["key ", "secret key ", "bearer ", "token is "])),
        lambda: (pick(hexes, 32, 64), r.choice(["secret ", "api key ", "token "])),
        lambda: (pick(lower + upper, 24, 64), r.choice(["token here ", "api key ", "secret ", "the token is "])),
        lambda: (pick(r.choice([lower, upper]), 32, 64), r.choice(["token here ", "api key ", "secret ", "the token is "])),
    ]
    others = [
        lambda: (pick(hexes, 40), r.choice(["commit ", "sha1 ", "ref ", ""])),
        lambda: (pick(hexes, 32), r.choice(["md5 ", "checksum ", "digest ", ""])),
        lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid ", "id ", ""])),
        lambda: (pick(digits, 16, 19), r.choice(["card ", "order ", "phone ", ""])),
        lambda: ("/".join([r.choice(["usr", "home", "src", "var"]), word(), word() + pick(digits, 1, 3)]) + "/" + word(), r.choice(["", "path "])),
        lambda: (word() + "_" + word() + "_" + word() + pick(digits, 1, 4) + "_" + word(), ""),
        lambda: (word().title() + word().title() + word().title() + pick(digits, 1, 3) + word().title(), ""),
        lambda: (pick(digits, 4) + "-" + pick(digits, 2) + "-" + pick(digits, 2) + "T" + pick(digits, 6) + "Z", ""),
        lambda: (named() + r.choice(["changeme", "example", "your_password", "password", "your-token-here", "none_given", "secret_value", "insert_key_here", "test_user", "xxxxxxxx", "********"]), ""),
        lambda: (named() + word() + word() + word(), ""),
        lambda: (word() + "-" + word() + "-" + pick(digits, 4) + "-" + word() + "-" + word(), r.choice(["", "https://www.example.com/"])),
        lambda: ("".join(word().title() for _ in range(r.randint(4, 6))), r.choice(["", "class ", "token "])),
        lambda: (r.choice(["", "-", "_", "/"]).join(word() for _ in range(r.randint(6, 12))), r.choice(["", "key ", "path "])),
        lambda: (r.choice("abxyzEM_-/") * r.randint(32, 90), r.choice(["", "key "])),
    ]
    rows = []
    for i in range(count):
        label = i % 2
        match, ahead = r.choice(secrets if label else others)()
        rows.append((match, f"{prose()} {ahead}", f" {prose()}", label))
    return rows


@dataclass
class Forest:
    """Trees as nested tuples (feature, threshold, below or equal, above); leaves are shares."""

    trees: list

    def score(self, x: Column) -> Column:
        """Mean share of secrets over the trees, of a struct of features."""

        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(x[NAMES[node[0]]] <= float(node[1]), walk(node[2])).otherwise(walk(node[3]))

        total = walk(self.trees[0])
        for t in self.trees[1:]:
            total = total + walk(t)
        return total / F.lit(float(len(self.trees)))

    def value(self, x) -> float:
        """The same of a sequence of features, for tests."""
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 9) -> Forest:
    """Random forest on the driver: bootstrap rows, a random half of the features at each split."""
    draw = np.random.default_rng(seed)

    def split(rows: np.ndarray, left: int):
        share = float(round((y[rows].sum() + 0.5) / (len(rows) + 1), 4))
        if not left or len(rows) < 8 or share < 0.01 or share > 0.99:
            return share
        best: tuple = (0.0,)
        base = _gini(y[rows].sum(), len(rows))
        for f in draw.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[:-1] < v[1:])
            if not len(at):
                continue
            gain = base - _gini(ones[at], at + 1) - _gini(ones[-1] - ones[at], len(v) - at - 1)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (gain[k], int(f), round(float((v[at[k]] + v[at[k] + 1]) / 2), 6))
        if len(best) == 1:
            return share
        low = x[rows, best[1]] <= best[2]
        if low.all() or not low.any():
            return share
        return best[1], best[2], split(rows[low], left - 1), split(rows[~low], left - 1)

    return Forest([split(draw.integers(0, len(y), len(y)), depth) for _ in range(trees)])


def _gini(ones, n):
    return ones * (n - ones) / n


_forests: dict[str, Forest] = {}


def trained(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """Forest of labelled findings (match, before, after, label): those given or those made by rule.

    Their features come from the same expressions as the data's."""
    key = hashlib.sha256(repr(findings).encode("utf-8", "surrogatepass")).hexdigest() if findings else ""
    if key not in _forests:
        rows = findings or labelled_findings()
        given = docs.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, match string, before string, after string, label int")
        got = given.select("i", "label", features(F.col("match"), F.col("before"), F.col("after")).alias("x")).orderBy("i").collect()
        _forests[key] = grow(np.array([list(r["x"]) for r in got]), np.array([r["label"] for r in got]))
    return _forests[key]


def kind(match: Column) -> Column:
    value = F.regexp_replace(match, VALUE, "")
    out = F.when(F.length(value) < F.length(match), "assignment").otherwise("random")
    for name, pattern in reversed(FORMATS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})"), name).otherwise(out)
    return out


def _computed(docs: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """docs with columns that are computed once: an optimizer that writes them into each place that
    uses them would split a text again for each of its candidates."""
    (all_,) = fresh([*keep, *columns], "__computed")
    made = docs.select(*(F.col(f"`{c}`") for c in keep), F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias(all_))
    return made.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"{all_}.{k}").alias(k) for k in columns))


def scored(docs: DataFrame, forest: Forest, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns `keep` of `docs` (with text), and three arrays whose names come back too: the text between
    candidates, the candidates, and the score of each; null where a text has no candidate."""
    parts, found, score = names = fresh(keep, "__parts", "__found", "__score")
    has, text = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False)), F.col("text")
    out = _computed(docs, keep, **{parts: F.when(has, F.split(text, CANDIDATE, -1)), found: F.when(has, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))})
    each = F.transform(found, lambda m, i: features(m, F.get(parts, i), F.get(parts, i + 1)))
    return _computed(out, [*keep, parts, found], **{score: F.transform(each, forest.score)}), names


def scan(docs: DataFrame, threshold: float = THRESHOLD, forest: Forest | None = None) -> DataFrame:
    """Findings in `docs` (doc_id, text): doc_id, finding (from 0), kind, start, length, secret_sha256, score.

    start and length, in characters, are those of the secret itself, without the word that names
    it. Candidates whose score is under threshold are false positives and don't come back. Null
    and empty texts have no findings; repeated rows have theirs each; rows without doc_id keep a
    null one. Other columns are not looked at.
    """
    own, _ = scored(docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE)), forest or trained(docs), ["doc_id"])
    own = own.where(F.exists("__score", lambda s: s >= threshold))
    sizes = F.transform("__parts", lambda p, i: F.length(p) + F.coalesce(F.length(F.get("__found", i)), F.lit(0)))
    # running sums over blocks of sizes: each candidate ends where the sizes up to it add up
    size, total = 256, lambda a: F.aggregate(a, F.lit(0), lambda s, n: s + n)
    own = _computed(own, ["doc_id", "__found", "__score"], __sizes=sizes)
    last = F.floor((F.size("__sizes") - 1) / size).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice("__sizes", b * size + 1, F.lit(size))))
    own = _computed(own, ["doc_id", "__found", "__score", "__sizes"], __blocks=blocks)
    ends = F.transform("__sizes", lambda x, i: total(F.slice("__blocks", F.lit(1), F.floor(i / size).cast("int"))) + total(F.slice("__sizes", i - i % size + 1, i % size + 1)))
    own = _computed(own, ["doc_id", "__found", "__score"], __ends=ends)
    rows = own.select("doc_id", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("__found") - 1).alias("finding"), F.col("__found").alias("match"), F.col("__score").alias("score"), F.slice("__ends", F.lit(1), F.size("__found")).alias("end"))).alias("x"))
    rows = rows.where(F.col("x.score") >= threshold)
    value = F.regexp_replace("x.match", VALUE, "")
    return rows.select(
        "doc_id",
        F.col("x.finding").alias("finding"),
        kind(F.col("x.match")).alias("kind"),
        (F.col("x.end") - F.length(value)).alias("start"),
        F.length(value).alias("length"),
        F.sha2(value, 256).alias("secret_sha256"),
        F.round("x.score", 6).alias("score"),
    )


def redact(docs: DataFrame, threshold: float = THRESHOLD, forest: Forest | None = None) -> DataFrame:
    """`docs` with each secret in text, however long, replaced by [secret]; all rows and columns stay,
    and rows without secrets are as they were. Null texts stay null; no rows give no rows."""
    out, (parts, found, score) = scored(docs, forest or trained(docs), docs.columns)

    def clean(p: Column, i: Column) -> Column:
        m = F.get(found, i)
        named = F.regexp_extract(m, VALUE, 0)
        return F.concat(p, F.coalesce(F.when(F.get(score, i) >= threshold, F.concat(named, F.lit("[secret]"))).otherwise(m), F.lit("")))

    any_ = F.coalesce(F.exists(score, lambda s: s >= threshold), F.lit(False))
    new = F.when(any_, F.array_join(F.transform(parts, clean), "")).otherwise(F.col("text"))
    return out.withColumn("text", new).select(*(F.col(f"`{c}`") for c in docs.columns))
