"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that the BPE encoding of that prefix ends with. It is the
token t for which the encoding of what precedes t ends with a token that may stand before t, that is, whose boundary
to t no earlier merge would have closed. A table of those last tokens gives the encoding by walking back, can be
extended byte by byte, and after an edit needs new entries from the edit on only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepare, release

#: Words that a worker remembers with their ids (about 200 bytes each); beyond that it forgets them. Results don't depend on it.
CACHE_ENTRIES = 400_000


class Vocabulary:
    """Ranks of a byte-level BPE, with the pair each token was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known_fits: dict[int, bool] = {}
        self.reachable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.left[rank] = self.right[rank] = rank
                self.reachable[token] = rank
                continue
            for cut in range(1, len(token)):
                a, b = self.reachable.get(token[:cut]), self.reachable.get(token[cut:])
                if a is not None and b is not None and self._separate(a, b):
                    self.left[rank], self.right[rank], self.merged[a, b] = a, b, rank
                    self.reachable[token] = rank
                    break
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.reachable.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _separate(self, a: int, b: int) -> bool:
        """Whether no merge closes the boundary between a and b before both are complete."""
        before = 1 << 60  # merges of a lower rank than this happened before what has been undone
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b and self.right[a] != a:
                before, a = a, self.right[a]
            elif self.left[b] != b:
                before, b = b + 1, self.left[b]  # of merges of one rank the one further left comes first
            elif self.right[a] != a:
                before, a = a, self.right[a]
            else:
                return True

    def fill(self, data: bytes, last: list[int], stop: Callable[[int], bool] | None = None) -> None:
        """Extend last, the last tokens of data's prefixes so far, to all prefixes of data, or until stop."""
        done = len(last) - 1
        low = max(0, done + 1 - self.longest)
        last += [-1] * (len(data) - done)
        fits = self.known_fits
        for end, (token, length) in self.automaton.iter(data.decode("latin-1"), low):
            if end < done:
                continue
            end += 1
            start = end - length
            if start < low:  # an occurrence that begins before the part read here is one the automaton can't report
                continue
            if start:
                pair = last[start] << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) > CACHE_ENTRIES:
                        fits.clear()
                    fit = fits[pair] = self._separate(last[start], token)
                if not fit:
                    continue
            last[end] = token
            done = end
            if stop and stop(end):
                del last[end + 1 :]
                return
        if done != len(data):
            raise ValueError("the vocabulary lacks single bytes")


class PrefixTable:
    """The last token of every prefix of one piece of text; grows at its end and re-encodes near edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1]
        vocabulary.fill(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.fill(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of data[start:end]; returns how many entries were computed anew."""
        old, shift, same = self.last, len(new) - (end - start), 0
        self.data, last = self.data[:start] + new + self.data[end:], old[: start + 1]

        def agreed(at: int) -> bool:
            # once, beyond the edit, as many entries in a row as the longest token agree, all later ones do
            nonlocal same
            same = same + 1 if at > start + len(new) and old[at - shift] == last[at] else 0
            return same >= self.vocabulary.longest

        self.vocabulary.fill(self.data, last, agreed)
        computed, at = len(last) - start - 1, len(last) - 1
        self.last = last + old[at - shift + 1 :]
        return computed

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Encoder:
    """Encodes whole texts: the pattern's matches one by one, each by its prefix table, with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.words: dict[str, bytes] = {}  # by what follows the space before them
        self.packed = {i: i.to_bytes(4, "little") for i in vocabulary.tokens}
        dense = len(vocabulary.tokens) == max(vocabulary.tokens) + 1
        self.of = [vocabulary.tokens[i] for i in range(len(vocabulary.tokens))] if dense else vocabulary.tokens

    def match(self, piece: str) -> bytes:
        """Ids of one match of the pattern."""
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = PrefixTable(self.vocabulary, data).ids() if whole is None else [whole]
        return b"".join(map(self.packed.__getitem__, ids))

    def remember(self, word: str, ids: bytes) -> bytes:
        if len(word) < 100:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = ids
        return ids

    def forget(self) -> None:
        self.words.clear()
        self.vocabulary.known_fits.clear()

    def plain(self, text: str) -> bytes:
        return b"".join([self.word(x) if x[0] == " " and not x[-1].isspace() else self.match(x) for x in self.pattern.findall(text)])

    def word(self, spaced: str) -> bytes:
        ids = self.words.get(spaced[1:])
        return self.remember(spaced[1:], self.match(spaced)) if ids is None else ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where one space stands between two other characters a match always starts there, so such words are encoded,
        and remembered, by themselves; any other white space around a space sends the text to the pattern as a whole.
        """
        first, *parts = text.split(" ")
        if not parts or first[-1:].isspace():
            return self.plain(text)
        out, known = [self.plain(first)], self.words.get
        for part in parts:
            ids = known(part)
            if ids is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return self.plain(text)
                found = self.pattern.findall(f" {part}")
                if len(found) == 1:
                    ids = self.remember(part, self.match(found[0]))
                else:
                    ids = self.word(found[0]) + b"".join(map(self.match, found[1:]))
                    if len(part) < 16:
                        self.remember(part, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Token ids of every text, and what they decode to.

    Returns the columns `keep`, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256, and with with_ids also ids (array of int) and decoded (string). A null text counts as empty: no
    tokens. Repeated rows are encoded again; other columns are left aside, so their names can't clash. Partitions are
    the input's, nothing is shuffled, and a worker holds one batch, one text's ids and a bounded memory of words.
    """
    prepare(docs.sparkSession)
    kept = docs.select(*keep, docs[text].alias("__text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields[:-1])}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha, ids, decoded = [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                packed = own.encode(value.as_py() or "")
                data = own.decode(packed)
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                decoded_sha.append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    ids.append(packed)
                    decoded.append(data.decode())
            more = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                offsets = pa.array(np.cumsum([0, *n], dtype=np.int32))
                more += [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + more, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])
        own.forget()
        release()

    return kept.mapInArrow(run, schema)
