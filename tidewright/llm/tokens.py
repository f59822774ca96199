"""Token ids of whole texts from a public tokenizer file.

A text is cut at spaces and line feeds, which the tokenizer drops, so its ids are its chunks'
ids in a row. Each worker keeps the ids of words that it has seen.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"


def vocabulary(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


class Recent(dict):
    """Key -> make(key), kept for the keys used most recently: at most twice `most`.

    Two generations: when the young one is full it becomes the old one, from which keys in use
    come back.
    """

    def __init__(self, make, most: int = 200_000, longest: int = 200):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self.put(key, out)
        return out

    def put(self, key: str, value) -> None:
        if len(key) < self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The chunks of many texts are numbered by Arrow, so that each distinct one is looked up once;
    its ids are then laid out in the texts' order by numpy.
    """

    #: Letters whose lower case, class and composition don't depend on their neighbours.
    plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.others = Recent(self.encoded, most), Recent(self.encoded, most // 10)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.marks = {x: self.encoded(x) for x in ("", ".", ",")}

    def encoded(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str], together: int = 200) -> None:
        """Encodes new plain words in lower case many at a time. Each is one word to the tokenizer, so
        its ids end with the one id that ends a word."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                raw, at = ids.tobytes(), 0
                for w, end in zip(group, (4 * ends).tolist(), strict=True):
                    self.words.put(w, raw[at:end])
                    at = end

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks: plain words, with a full stop or comma or none, and others."""
        match, marks, known, old = self.plain.match, self.marks, self.words, self.words.old
        got = list(map(known.get, chunks))  # words as they stand
        rest, new = [], set()
        for i in [i for i, g in enumerate(got) if g is None]:
            s = chunks[i]
            m = match(s)
            tail = s[m.end() :] if m else None
            if tail not in marks or m.end() >= known.longest:
                got[i] = self.others[s]
                continue
            w = m[0].lower()
            rest.append((i, w, marks[tail]))
            if w not in known and w not in old:
                new.add(w)
        self.learn(list(new))
        for i, w, mark in rest:
            got[i] = known[w] + mark
        return got

    @staticmethod
    def lowered(t: str) -> str:
        """In lower case, as the tokenizer makes it, where every letter has one lower form and no
        special token can appear by it; else as it is."""
        try:
            t.encode("latin-1")
        except UnicodeEncodeError:
            return t
        return t if "<|" in t else t.lower()

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; nothing for null and empty ones."""
        lines = pc.replace_substring(pa.array([self.lowered(t) if t else "" for t in texts], pa.string()), "\n", " ")
        parts = pc.split_pattern(lines, " ")
        numbered = parts.flatten().dictionary_encode()
        got, which = self.chunks(numbered.dictionary.to_pylist()), numbered.indices.to_numpy()
        n = np.fromiter(map(len, got), np.int32, len(got)) // 4
        at, many = np.cumsum(n, dtype=np.int32) - n, n[which]
        end = np.cumsum(many, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        place = np.repeat(at[which] - (end - many).astype(np.int32), many)
        place += np.arange(total, dtype=np.int32)
        ids = np.frombuffer(b"".join(got), "<u4")[place].tobytes()
        cuts = (4 * np.concatenate([[0], end])[parts.offsets.to_numpy()]).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


_held: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    if path not in _held:
        _held[path] = ChunkIds(path)
    return _held[path]
