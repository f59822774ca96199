"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The pieces of a text are the one sequence in which every piece and every two adjacent pieces
come back when they are merged again from characters. Encoding takes the longest piece at each
place (an Aho-Corasick automaton finds them), checks it against the piece before it, and tries
shorter pieces or goes back one piece where that fails; a bit field keeps the places that can't
be reached so that none is tried twice.

No piece holds a space mark after another character, so a text falls into chunks that each
begin with one, and the pieces of a text are its chunks' pieces in a row. Inside a chunk, two
adjacent characters that no piece holds side by side part it further.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, map_batches, slices
from .tokens import Recent, vocabulary

PIECE_BPE = "piece_bpe_32k.model"
SPACE = "▁"


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, at
        shift += 7


def _fields(b: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            value, at = _varint(b, at)
        else:
            n, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _varint(b, at)
            value = b[at : at + n]
            at += n
        yield key >> 3, value


class PieceModel:
    """A byte-pair model file without normalisation rules: pieces, scores and kinds."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str, most: int = 200_000):
        import ahocorasick

        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.piece: list[str] = []
        self.score: list[float] = []
        kinds: list[int] = []
        for number, value in model:
            if number == 1:
                x = dict(_fields(value))
                self.piece.append(x[1].decode())
                self.score.append(float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(x.get(3, self.NORMAL))
        trainer, rules = (dict(_fields(next((v for n, v in model if n == k), b""))) for k in (2, 3))
        assert trainer.get(3, 1) == 2, "a byte-pair model is needed"
        assert not rules.get(2) and rules.get(3, 1) and not rules.get(4, 1) and self.USER not in kinds and self.UNUSED not in kinds, "rules that are not built here"
        self.id = {p: i for i, (p, k) in enumerate(zip(self.piece, kinds, strict=True)) if k == self.NORMAL}
        self.unknown = kinds.index(self.UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.piece, kinds, strict=True)) if k == self.BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.hidden = {i for i, k in enumerate(kinds) if k == self.CONTROL}
        self.side_by_side = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        assert not any(p.lstrip(SPACE).count(SPACE) for p in self.id)
        #: Pieces that merging their own characters gives; the others never come out.
        self.whole = {p: i for p, i in self.id.items() if len(p) == 1 or self.merged(p) == [p]}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.whole), None) for p in self.whole}
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.packed = {p: self._raw([i]) for p, i in self.whole.items()}
        self.text_of = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.hidden else " ⁇ ".encode() if i == self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.written, self.numbers = self._table(self.text_of), self._table([b"%d," % i for i in range(len(self.piece))])
        #: A mark and letters that are pieces.
        self.letters = re.compile(SPACE + "[" + "".join(p for p in self.id if len(p) == 1 and p.isalpha() and ord(p) < 1 << 9) + "]+")
        self.fits = Recent(self._fits, most)
        self.runs = Recent(self._run, most)
        self.chunks = Recent(self._chunk, 2 * most)

    def merged(self, s: str) -> list[str]:
        """Merges of characters in the order of scores, leftmost first on ties."""
        parts: list[str | None] = list(s)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def look(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (k := self.id.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, both))

        for i in range(len(parts) - 1):
            look(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            look(before[i])
            look(i)
        return [p for p in parts if p is not None]

    def _fits(self, both: str) -> bool:
        a, b = both.split("\n")
        return self.merged(a + b) == [a, b]

    def backtracked(self, s: str) -> list[str]:
        """Pieces of s, whose characters are all pieces."""
        longest: list[str] = [""] * len(s)
        for end, p in self.automaton.iter(s):  # at each place, longer pieces end later
            longest[end + 1 - len(p)] = p
        failed, out, at, fits = bytearray(len(s) + 1), [], 0, self.fits
        token: str | None = longest[0]
        while at < len(s):
            last = out[-1] if out else None
            end = at + len(token)
            if not failed[end] and (last is None or fits[f"{last}\n{token}"]):
                out.append(token)
                at = end
                token = longest[at] if at < len(s) else None
            elif (token := self.shorter[token]) is None:
                failed[at] = 1
                token = out.pop()
                at -= len(token)
        return out

    def _raw(self, ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _run(self, s: str) -> bytes:
        """Ids of characters that may merge with each other."""
        if len(s) == 1:
            got = self.id.get(s)
            if got is not None:
                return self._raw([got])
            return self._raw([self.byte[x] for x in s.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown])
        # Merging alone settles runs of marks, whose pieces of 2, 4, 8 and more have equal scores, so that the
        # leftmost merge and not a pair of pieces decides; and line feeds, which part the pairs' keys.
        if s.startswith(SPACE * 2) or "\n" in s:
            return self._raw([self.id[p] for p in self.merged(s)])
        return b"".join([self.packed[p] for p in self.backtracked(s)])

    def _chunk(self, key: str) -> bytes:
        """Ids of a chunk, given without its first space mark."""
        chunk = SPACE + key.replace(" ", SPACE)
        m = self.letters.match(chunk)
        end = m.end() if m else 0
        if end == len(chunk):
            return self.runs[chunk]
        if end == len(chunk) - 1 and end and chunk[-2:] not in self.side_by_side:
            return self.runs[chunk[:-1]] + self.runs[chunk[-1]]
        out = []
        start = 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in self.side_by_side or chunk[i] not in self.id or chunk[i - 1] not in self.id:
                out.append(self.runs[chunk[start:i]])
                start = i
        return b"".join(out)

    _chunked = re.compile("[ ▁][ ▁]*[^ ▁]*")

    def keys(self, text: str) -> list[str]:
        """Chunks of a text, each without its first space mark."""
        if "  " in text or SPACE in text or text[0] == " ":
            return [x[1:].replace(SPACE, " ") for x in self._chunked.findall(" " + text)]
        return text.split(" ")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for an empty one."""
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.keys(text))) if text else b"", "<u4")

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in parts], np.int64)
        return np.cumsum(n) - n, n, np.frombuffer(b"".join(parts), np.uint8)

    @staticmethod
    def _strung(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        """The ids' entries of a table in a row."""
        at, n, body = table
        n = n[ids]
        end = np.cumsum(n)
        return body[np.arange(end[-1] if len(end) else 0) + np.repeat(at[ids] - (end - n), n)].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._strung(self.numbers, ids)[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids: the space that stands for the beginning goes, and bytes that
        make no character give U+FFFD each."""
        out = self._strung(self.written, ids)
        try:
            out.decode()
        except UnicodeDecodeError:
            out = self._mended(ids)
        return out[1:] if out.startswith(b" ") else out

    def _mended(self, ids: np.ndarray) -> bytes:
        out, raw = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[:n]).decode().encode())
                        del raw[:n]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\ufffd".encode())
                    del raw[:1]
            if i >= 0:
                out.append(self.text_of[i])
        return b"".join(out)


_held: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _held:
        _held[path] = PieceModel(path)
    return _held[path]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): how many ids, digests of ids and of the decoded text.

    A null text counts as empty: no ids, digests of nothing. Repeated rows come back each; other
    columns are not looked at. with_ids adds ids and decoded.
    """
    path = path or vocabulary(PIECE_BPE)

    def run(batches: Batches) -> Batches:
        model = piece_model(path)
        for b in slices(batches):
            n, ids_hash, text_hash, ids, texts = [], [], [], [], []
            for text in b.column(1).to_pylist():
                got = model.encode(text or "")
                plain = model.decode(got)
                n.append(len(got))
                ids_hash.append(hashlib.sha256(model.decimal(got)).hexdigest())
                text_hash.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    ids.append(got.tolist())
                    texts.append(plain.decode())
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return map_batches(docs.select("doc_id", "text"), run, schema)
