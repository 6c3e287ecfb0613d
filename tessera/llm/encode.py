"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Words of a batch lie in one flat array of symbols.  Each round looks up all neighbouring pairs by
binary search over the sorted pair keys of the vocabulary, takes each word's lowest rank, and
merges the occurrences of that pair in all words at once; words without a pair left leave the
array.  A long word is divided first where no token of the vocabulary lies across, as no merge can
join the two sides; so its parts merge independently.  The vocabulary is never trained here, only read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.spans import _BASE, Hashes, _mix
from tessera.session import table

#: Where the vocabulary files are unless a path is given.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")

# The pattern that splits a text into words before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of a word beyond which it is divided (speed only).
LONG = 256
#: Words a Python worker remembers from batch to batch (memory only; results don't depend on it).
REMEMBERED = 100_000
#: Characters that go through the merge rounds at once (memory only).
BATCH_CHARS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte, by letter.

    Printable Latin-1 bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary as arrays: the id of each byte, and of each pair its rank and merged id."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, merges = model["vocab"], model["merges"]
        letters = byte_letters()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = np.arange(len(pairs), dtype=np.int64)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        tokens: dict[int, list[list[int]]] = {}
        for t in {a + b for a, b in pairs}:
            tokens.setdefault(len(t), []).append([letters[x] for x in t])
        #: By length the sorted hashes of all tokens that a merge makes.
        self.made = {n: np.sort(self._hashes(np.array(ts, np.uint64))) for n, ts in sorted(tokens.items())}

    @staticmethod
    def _hashes(rows: np.ndarray) -> np.ndarray:
        powers = np.cumprod(np.r_[np.uint64(1), np.full(rows.shape[1] - 1, _BASE)])
        return _mix((_mix(rows + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64) + np.uint64(rows.shape[1]))

    def divided(self, word: bytes) -> list[bytes]:
        """The parts of a word between which no merge is possible: no token stands across."""
        n = len(word)
        hashes = Hashes(np.frombuffer(word, np.uint8))
        across = np.zeros(n + 1, np.int64)
        for length, made in self.made.items():
            if length > n:
                break
            h = hashes.of(np.arange(n - length + 1), length)
            at = np.flatnonzero(made[np.minimum(np.searchsorted(made, h), len(made) - 1)] == h)
            across[at + 1] += 1  # the boundaries after its first to before its last byte
            across[at + length] -= 1
        cuts = np.flatnonzero(np.cumsum(across)[1:n] == 0) + 1
        return [word[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n])]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; an empty word has none."""
        long = {x: self.divided(w) for x, w in enumerate(words) if len(w) > LONG}
        if not long:
            return self._merged(words)
        parts = [[w] if x not in long else long[x] for x, w in enumerate(words)]
        ids = iter(self._merged([p for ps in parts for p in ps]))
        return [[i for _ in ps for i in next(ids)] for ps in parts]

    def _merged(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        never = len(self.ranks)
        while len(flat):
            left = np.flatnonzero(word[:-1] == word[1:])
            key = flat[left] * self.base + flat[left + 1]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], never)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # where each word begins
            full = np.full(len(flat), never)
            full[left] = rank
            lowest = np.minimum.reduceat(full, first)
            lengths = np.diff(np.r_[first, len(flat)])
            ended = lowest == never
            if ended.any():
                for f, n in zip(first[ended].tolist(), lengths[ended].tolist()):
                    out[word[f]] = flat[f : f + n].tolist()
            hit = (full < never) & (full == np.repeat(lowest, lengths))
            # of pairs that overlap (a run of the same symbol) every second one merges
            start = hit & ~np.r_[False, hit[:-1]]
            index = np.arange(len(flat))
            hit &= (index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0
            new = flat.copy()
            at_full = np.zeros(len(flat), np.int64)
            at_full[left] = at
            new[hit] = self.merged[at_full[hit]]
            keep = ~np.r_[False, hit[:-1]] & ~np.repeat(ended, lengths)
            flat, word = new[keep], word[keep]
        return out


def chunks(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[list[str | None]]:
    """Consecutive texts of at most so many characters together, or one that is longer."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "")
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def encode_texts(texts: list[str | None], merges: Merges, known: dict[str, list[int]]) -> list[list[int]]:
    """The ids of each text; ``known`` holds words encoded before and takes the new ones."""
    import regex

    find = regex.compile(PATTERN).findall
    split = [find(t) if t else [] for t in texts]
    new = list({w for words in split for w in words if w not in known})
    if new:
        known.update(zip(new, merges.encode([w.encode() for w in new])))
    out = []
    for words in split:
        ids: list[int] = []
        for w in words:
            ids += known[w]
        out.append(ids)
    if len(known) > REMEMBERED:
        known.clear()
    return out


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """``key`` and ids (array of int) of every row, without special tokens.

    Null and empty texts both give an empty list; text that looks like a special token is plain
    text; repeated rows give repeated results.  Other columns are left behind.  No shuffle.
    """
    spark = df.sparkSession
    # bounded by the vocabulary: some 50,000 pairs
    held = spark.sparkContext.broadcast(Merges(os.path.join(folder or TOKENIZERS, vocabulary)))
    kind = dict(df.dtypes)[key]

    def run(batches):
        merges, known = held.value, {}
        for b in batches:
            keys, at = b.column(0), 0
            for part in chunks(b.column(1).to_pylist()):
                ids = encode_texts(part, merges, known)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])
                at += len(part)

    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
