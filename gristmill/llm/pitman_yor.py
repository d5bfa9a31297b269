"""A hierarchical Pitman-Yor language model of words.

Three levels: a restaurant for each word that stands before another (and one for the start of a text), the restaurant
of single words that all of these share as parent, and a uniform base over the words of training and one that stands
for all others. How many tables the customers of a word take in a restaurant is drawn by Gibbs sampling: its customers
are taken out and reseated together, given how all the others sit. Scores average the predictive probabilities of
several seatings.

Tokens travel once, as cells (word before, word, count) of a block of documents, to the bucket of the word before.
There the restaurants of that bucket are seated. Between rounds buckets send how many tables each word has to the
word's place, and get back its customers and tables in the parent; a round's sweeps keep to the parent as it was at the start of the round.
Contexts that hold more than a quarter of a bucket are split by word, and their totals exchanged in the same way.
Draws are hashed from words and rounds, so they don't depend on partitions or retries.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, kept, prepare, release
from .neardup import mix, word_hashes

START, END = np.uint64(0x57A2757A2757A275), np.uint64(0x5EED5EED5EED5EED)
#: Text that is packed together, and text whose tokens one bucket holds, in bytes.
BLOCK_BYTES, BUCKET_BYTES, BLOCK_DOCS = 8 << 20, 16 << 20, 16384
#: Exchanges with the parent, the last of them that scores are averaged over, and sweeps of the restaurants in each.
ROUNDS, SAMPLES, SWEEPS = 4, 3, 2
STRENGTH = (1.0, 1.0)  # of the parent and of the restaurants below it
#: Up to so many customers of a word the numbers of seatings are exact; beyond, by saddle points.
EXACT = 1024
#: Words of a restaurant that are reseated one after another; those of the same turn (and all beyond EXACT) are reseated side by side.
TURNS = 8
#: Kinds of rows: a bucket's cells, the blocks they are from, its seating, what it sends to a place, what that replies, and the place's sums.
CELLS, REFS, STATE, SENT, REPLY, SUMS = range(6)
ROWS = "bucket long, kind int, place long, blob binary, one long, two long"
ROW_TYPES = {"bucket": pa.int64(), "kind": pa.int32(), "place": pa.int64(), "blob": pa.binary(), "one": pa.int64(), "two": pa.int64()}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, each with the smallest type that holds it, byte by byte, compressed."""
    parts = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
        planes = np.ascontiguousarray(a.astype(("u1", "<u2", "<u4", "<u8")[kind])).view(np.uint8).reshape(len(a), 1 << kind)
        parts.append(struct.pack("<BQ", kind, len(a)) + planes.T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<BQ", raw, at)
        planes = np.frombuffer(raw, np.uint8, n << kind, at + 9).reshape(1 << kind, n)
        out.append(np.ascontiguousarray(planes.T).view(("u1", "<u2", "<u4", "<u8")[kind]).ravel())
        at += 9 + (n << kind)
    return out


def tokens_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words and the end, and of what stands before each."""
    w = np.append(word_hashes((text or "").encode()), END)
    return w, np.append(START, w[:-1])


def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(ids, held out, texts) of bounded size."""
    ids, held, texts, size = [], [], [], 0
    for b in batches:
        for i, h, t in zip(*(b.column(k) for k in range(3)), strict=True):
            t = t.as_py() or ""
            if texts and (size + len(t) > BLOCK_BYTES or len(texts) >= BLOCK_DOCS):
                yield ids, held, texts
                ids, held, texts, size = [], [], [], 0
            ids.append(i.as_py())
            held.append(h.as_py())
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, held, texts


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values of all keys starts, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


@dataclass
class Dealing:
    """Into how many buckets, and into how many parts the contexts are split that hold much of all tokens."""

    buckets: int
    split: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted
    parts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __call__(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = u.copy()
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, u), len(self.split) - 1)
            hot = np.flatnonzero(self.split[at] == u)
            part = mix(w[hot] ^ np.uint64(0x9A27)) % self.parts[at[hot]].astype(np.uint64)
            key[hot] = mix(u[hot] + (part + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        return ((mix(key) >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)


def dealing(docs: DataFrame, buckets: int) -> Dealing:
    """Find the contexts to split, in one pass over all documents.

    A block names the words that are an eighth of a bucket's share of its tokens. What a word lacks in blocks that
    don't name it is less than that share, so every word of a quarter of a bucket is found; at most 8 * buckets are.
    """
    if buckets == 1:
        return Dealing(1)
    share = 1 / (8 * buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in blocks_of(batches):
            u, c = np.unique(np.concatenate([tokens_of(t)[1] for t in texts]), return_counts=True)
            top, total = c >= share * c.sum(), int(c.sum())
            yield pa.RecordBatch.from_pydict({"u": pa.array([None, *u[top].view(np.int64).tolist()], pa.int64()), "c": pa.array([total, *c[top].tolist()], pa.int64())})

    found = kept(docs.select("id", "held", "text").mapInArrow(run, "u long, c long").groupBy("u").agg(F.sum("c").alias("c")), "contexts")
    total = found.filter("u is null").first()
    total = total["c"] if total else 0
    rows = found.filter((F.col("u").isNotNull()) & (F.col("c") >= F.lit(share * total))).toArrow()  # at most 1 / share rows
    drop_kept(found)
    u, c = rows.column("u").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(u)
    return Dealing(buckets, u[order], np.ceil(2 * c[order] * buckets / max(total, 1)).astype(np.int64) + 1)


def block_number(ids: list, w: np.ndarray) -> int:
    """A number for a block of documents that a repeated task gives again."""
    own = np.array([0 if i is None else i + 1 for i in ids], np.int64).view(np.uint64)
    parts = mix(own + np.arange(len(ids), dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), mix(w ^ np.uint64(3))
    return int(mix(np.add.reduce(np.concatenate(parts), keepdims=True))[0] >> np.uint64(1))


def dealt(docs: DataFrame, deal: Dealing) -> DataFrame:
    """bucket, block and payload: a block's cells of that bucket. Bucket -1 - k has the block's documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, texts in blocks_of(batches):
            found = [tokens_of(t) for t in texts]
            n = np.array([len(f[0]) for f in found])
            w, u = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            del found
            block, where = block_number(ids, w), deal(u, w)
            order = np.lexsort((w, u, where))
            w, u, where = w[order], u[order], where[order]
            cut = runs(where, u, w)
            doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)[order]
            cell = np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
            del order
            count = np.add.reduceat((~np.array(held, bool))[doc].astype(np.int64), cut[:-1])
            by_doc = np.argsort(doc, kind="stable")  # of each document its cells, in order
            step = np.diff(cell[by_doc], prepend=0)
            first = np.append(0, np.cumsum(n)[:-1])
            step[first] = cell[by_doc][first]
            meta = pack(np.array([0 if i is None else i + (1 << 63) for i in ids], np.uint64), np.array([i is None for i in ids], np.uint8), np.array(held, np.uint8), n, step)
            w, u, where = w[cut[:-1]], u[cut[:-1]], where[cut[:-1]]
            rows = [(-1 - block % deal.buckets, block, meta)]
            of = runs(where)
            for a, b in zip(of[:-1], of[1:], strict=True):
                of_u = runs(u[a:b])
                rows.append((int(where[a]), block, pack(u[a:b][of_u[:-1]], np.diff(of_u), w[a:b], count[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "block", "payload"])
        release()

    return docs.select("id", "held", "text").mapInArrow(run, "bucket long, block long, payload binary")


def merged(rows: DataFrame, partitions: int) -> DataFrame:
    """A row for each bucket: cells, and refs (of each block the cells it has there). Rows of documents stay."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table({"bucket": group.column("bucket"), "block": group.column("block"), "cells": pa.array([None] * group.num_rows, pa.binary()), "refs": group.column("payload")})
        group = group.sort_by("block")
        parts = [unpack(x.as_py()) for x in group.column("payload")]
        u = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        w, count = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        sizes = [len(p[2]) for p in parts]
        del parts
        order = np.lexsort((w, u))
        cut = runs(u[order], w[order])
        cell = np.empty(len(u), np.int64)
        cell[order] = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        steps = [np.diff(x, prepend=0) for x in np.split(cell, np.cumsum(sizes)[:-1])]  # a block's cells are in order
        refs = pack(group.column("block").to_numpy().astype(np.uint64), np.array(sizes), np.concatenate(steps))
        count = np.add.reduceat(count[order].astype(np.int64), cut[:-1])
        u, w = u[order][cut[:-1]], w[order][cut[:-1]]
        of_u = runs(u)
        words, word = np.unique(w, return_inverse=True)
        cells = pack(u[of_u[:-1]], np.diff(of_u), words, word, count)
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "block": pa.array([None], pa.int64()), "cells": pa.array([cells], pa.binary()), "refs": pa.array([refs], pa.binary())})

    return rows.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(run, "bucket long, block long, cells binary, refs binary")


@dataclass
class Totals:
    """What all restaurants share: words and tokens of training, discounts (parent's first), and the parent's customers and tables after each round."""

    words: int
    tokens: int
    discount: tuple[float, float]
    rounds: list[tuple[int, int]] = field(default_factory=list)

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)

    def new(self, k: int) -> float:
        """Weight of a new table for one given word in the parent, after round k."""
        return (STRENGTH[0] + self.discount[0] * self.rounds[k][1]) * self.base


class Cells:
    """A bucket's cells, sorted by context and word. word: number of its word in words."""

    def __init__(self, data: bytes):
        self.contexts, per, self.words, word, count = unpack(data)
        self.ctx = np.repeat(np.arange(len(per)), per)
        self.word, self.count = word.astype(np.int64), count.astype(np.int64)
        self.several = np.flatnonzero(self.count > 1)
        self.customers = np.bincount(self.ctx, self.count, len(per)).astype(np.int64)
        self.word_counts = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)

    def tables(self, several: np.ndarray | None) -> np.ndarray:
        """Tables of all cells, given those of cells with several customers (None: one each)."""
        t = np.minimum(self.count, 1)
        if several is not None:
            t[self.several] = several
        return t


def draw(key: np.ndarray, k: int) -> np.ndarray:
    """Uniform in (0, 1), by key and number."""
    return ((mix(key + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    less = np.ones_like(x)
    for _ in range(8):
        small = x < 8
        less[small] *= x[small]
        x[small] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - np.log(less)


@lru_cache(maxsize=8)
def seatings(d: float, most: int = EXACT) -> np.ndarray:
    """[c, t]: log of the generalised Stirling number, the weight of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[c, t] = np.logaddexp(out[c - 1, t - 1], np.where(t < c, np.log(np.maximum(c - 1 - t * d, 1e-300)) + out[c - 1, t], -np.inf))
    return out


def saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the same number for many customers, by the saddle point of its generating function."""
    ratio = np.log(c / t)
    lo, hi = np.full(len(c), -4000.0), np.full(len(c), -1e-9)

    def log_h(z: np.ndarray) -> np.ndarray:
        return np.log(-np.expm1(z)) + math.log(d) + (d - 1) * z - np.log(-np.expm1(d * z))

    for _ in range(50):
        z = (lo + hi) / 2
        high = log_h(z) > ratio
        lo, hi = np.where(high, z, lo), np.where(high, hi, z)
    z = (lo + hi) / 2
    h = c / t
    with np.errstate(over="ignore"):
        spread = np.where(z < -30, math.log(1 - d) - z, np.log(np.maximum(1 - h + (1 - d) * -np.expm1(z) * np.exp(np.minimum(-z, 30)), 1e-12)))
    value = t * np.log(-np.expm1(d * z)) - c * np.log1p(-np.exp(z)) - 0.5 * (math.log(2 * math.pi) + np.log(c) + spread)
    return value + log_gamma(c + 1) - log_gamma(t + 1) - t * math.log(d)


@lru_cache(maxsize=8)
def limit(d: float) -> np.ndarray:
    """[t]: what is left of the last row of seatings() without its factors in t and c; from t = 0 on, where it has a limit."""
    t = np.arange(1, EXACT + 1, dtype=float)
    row = seatings(d)[EXACT, 1:] - factors(np.full(EXACT, float(EXACT)), t, d)
    return np.append(math.log(d) - math.lgamma(1 - d), row)


def factors(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    return log_gamma(c + 1) - log_gamma(t + 1) - t * math.log(d) + np.log(t) - (1 + d) * np.log(c)


def log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """As seatings() beyond its table, within some hundredths.

    Few tables, up to 2 c^d and 0.6 c: but for known factors the number depends on t / c^d alone, so the table's last row gives
    it. More: by saddle points, whose error depends on t above all and is taken from the same row.
    """
    c, t = c.astype(float), t.astype(float)
    out = np.empty(len(c))
    few = t <= np.minimum(2 * c**d, 0.6 * c)
    at = t[few] * (EXACT / c[few]) ** d
    low = np.minimum(at.astype(int), EXACT - 1)
    known = limit(d)
    out[few] = known[low] + (at - low) * (known[low + 1] - known[low]) + factors(c[few], t[few], d)
    out[~few] = saddle(c[~few], t[~few], d)
    near = ~few & (t < EXACT // 2)
    if near.any():
        k = t[near]
        out[near] += seatings(d)[EXACT, k.astype(int)] - saddle(np.full(len(k), float(EXACT)), k, d)
    return out


class Restaurants:
    """What the draw of a word's tables depends on, for each of some words: its customers, and the other words' tables."""

    def __init__(self, count: np.ndarray, others: np.ndarray, strength: float, discount: float):
        self.count, self.others, self.strength, self.discount = count, others, strength, discount

    def take(self, i: np.ndarray) -> Restaurants:
        raise NotImplementedError

    def above(self, j: np.ndarray) -> np.ndarray:
        """log probability that the parent gives the word for table j + 1 after j (words x j)."""
        raise NotImplementedError

    def above_all(self, t: np.ndarray) -> np.ndarray:
        """The sum of above() for t tables (words x any)."""
        raise NotImplementedError

    def log_weight(self, t: np.ndarray) -> np.ndarray:
        """log of the weight of t tables in all (words x any)."""
        d, free = self.discount, self.strength / self.discount + self.others[:, None]
        here = t * math.log(d) + log_gamma(free + t) - log_gamma(free)
        c = np.broadcast_to(self.count[:, None], t.shape)
        return log_seatings(c.ravel(), t.ravel(), d).reshape(t.shape) + here + self.above_all(t)

    def draw(self, u: np.ndarray) -> np.ndarray:
        """Tables of each word, drawn from what their number's distribution is given all the rest; u: uniform numbers."""
        out = np.minimum(self.count, 1)
        width = 2
        while width <= EXACT:
            of = np.flatnonzero((self.count > width // 2) & (self.count <= width) & (self.count > 1))
            j = np.arange(width, dtype=float)
            for at in range(0, len(of), chunk := max(1, (1 << 20) // width)):
                i = of[at : at + chunk]
                some = self.take(i)
                steps = np.log(self.strength + self.discount * (some.others[:, None] + j)) + some.above(j)
                out[i] = 1 + pick(seatings(self.discount)[some.count, 1 : width + 1] + np.cumsum(steps, axis=1), u[i])
            width *= 2
        i = np.flatnonzero(self.count > EXACT)
        if len(i):
            some, lo, hi = self.take(i), np.ones(len(i)), self.count[i].astype(float)
            weight = lambda t: some.log_weight(t[:, None])[:, 0]
            for _ in range(int(math.log2(hi.max())) + 2):  # the most likely number
                mid = np.floor((lo + hi) / 2)
                up = (weight(np.minimum(mid + 1, self.count[i])) > weight(mid)) & (mid < hi)
                lo, hi = np.where(up, mid + 1, lo), np.where(up, hi, mid)
            step = np.maximum(1, np.floor(np.sqrt(lo) / 4))  # the grid reaches eight standard deviations either way
            t = lo[:, None] + step[:, None] * np.arange(-32, 33)
            fits = (t >= 1) & (t <= self.count[i][:, None])
            k = pick(np.where(fits, some.log_weight(np.clip(t, 1, self.count[i][:, None])), -np.inf), u[i])
            t = t[np.arange(len(i)), k] + np.floor(step * (u[i] * 4096 % 1) - step / 2 + 0.5)
            out[i] = np.clip(t, 1, self.count[i]).astype(np.int64)
        return out


class Children(Restaurants):
    """Restaurants of contexts. Of the parent: the word's customers and tables there, and all customers, without those that are redrawn; its discount, and the weight of a new table."""

    def __init__(self, count, others, customers: np.ndarray, tables: np.ndarray, everybody: np.ndarray, discount: float, new: float, own: tuple[float, float]):
        super().__init__(count, others, *own)
        self.customers, self.tables, self.everybody, self.parent_discount, self.new = customers, tables, everybody, discount, new

    def take(self, i: np.ndarray) -> Children:
        return Children(self.count[i], self.others[i], self.customers[i], self.tables[i], self.everybody[i], self.parent_discount, self.new, (self.strength, self.discount))

    def above(self, j: np.ndarray) -> np.ndarray:
        d = self.parent_discount
        known = self.customers[:, None] + j - d * self.tables[:, None]
        return np.log(np.where(self.customers[:, None] > 0, known, np.where(j > 0, j - d, 0.0)) + self.new) - np.log(self.everybody[:, None] + j)

    def above_all(self, t: np.ndarray) -> np.ndarray:
        d, everybody = self.parent_discount, self.everybody[:, None].astype(float)
        b = np.where(self.customers > 0, self.customers - d * self.tables + self.new, 1.0)[:, None]
        known = log_gamma(b + t) - log_gamma(b)
        fresh = math.log(self.new) + log_gamma(self.new + t - d) - log_gamma(np.array(self.new + 1 - d))
        return np.where(self.customers[:, None] > 0, known, fresh) - log_gamma(everybody + t) + log_gamma(everybody)


class Root(Restaurants):
    """The parent of all, whose tables draw their word from the base."""

    def __init__(self, count, others, base: float, own: tuple[float, float]):
        super().__init__(count, others, *own)
        self.base = base

    def take(self, i: np.ndarray) -> Root:
        return Root(self.count[i], self.others[i], self.base, (self.strength, self.discount))

    def above(self, j: np.ndarray) -> np.ndarray:
        return np.full((1, len(j)), math.log(self.base))

    def above_all(self, t: np.ndarray) -> np.ndarray:
        return t * math.log(self.base)


def pick(log_p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of each row the column that u falls on."""
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True)).cumsum(axis=1)
    return np.minimum((p < (u * p[:, -1])[:, None]).sum(axis=1), log_p.shape[1] - 1)


@dataclass
class Parent:
    """Of a bucket's words: customers, tables in the parent and count in training; of its contexts: tables and customers."""

    customers: np.ndarray
    tables: np.ndarray
    count: np.ndarray
    ctx_tables: np.ndarray
    ctx_customers: np.ndarray


def sweep(cells: Cells, several: np.ndarray, parent: Parent, totals: Totals, k: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Tables of the cells with several customers after `sweeps` Gibbs sweeps, given the parent after round k."""
    i = cells.several
    ctx, word, count = cells.ctx[i], cells.word[i], cells.count[i]
    start, t, tables = several.astype(np.int64), several.astype(np.int64).copy(), parent.ctx_tables.astype(np.int64).copy()
    key = mix(cells.contexts[ctx] * np.uint64(3) + mix(cells.words[word] + np.uint64(1))) if len(i) else np.empty(0, np.uint64)
    cut = runs(ctx)
    turn = (np.arange(len(i)) - np.repeat(cut[:-1], np.diff(cut))) % TURNS
    turn[count > EXACT] = 0
    above = parent.customers[word] - start
    above_tables = np.minimum(parent.tables[word], above)
    for n in range(sweeps):
        for r in range(TURNS):
            j = np.flatnonzero(turn == r)
            if len(j):
                everybody = STRENGTH[0] + totals.rounds[k][0] - start[j]
                some = Children(count[j], tables[ctx[j]] - t[j], above[j], above_tables[j], everybody, totals.discount[0], totals.new(k), (STRENGTH[1], totals.discount[1]))
                new = some.draw(draw(key[j], 1 + k * sweeps + n))
                np.add.at(tables, ctx[j], new - t[j])
                t[j] = new
    return t


def seat_parent(words: np.ndarray, customers: np.ndarray, before: np.ndarray, totals: Totals, k: int) -> np.ndarray:
    """Tables of words in the parent in round k, given its tables after the round before."""
    some = Root(customers, totals.rounds[k - 1][1] - before, totals.base, (STRENGTH[0], totals.discount[0]))
    return some.draw(draw(mix(words ^ np.uint64(0xA0761D6478BD642F)), k))


def probabilities(cells: Cells, t: np.ndarray, parent: Parent, totals: Totals, k: int) -> np.ndarray:
    """Predictive probability of each cell's word after its context, of one seating."""
    customers, _ = totals.rounds[k]
    single = (np.maximum(parent.customers - totals.discount[0] * parent.tables, 0) + totals.new(k)) / (STRENGTH[0] + customers)
    s, d = STRENGTH[1], totals.discount[1]
    return (np.maximum(cells.count - d * t, 0) + (s + d * parent.ctx_tables[cells.ctx]) * single[cells.word]) / (s + parent.ctx_customers[cells.ctx])


def place_of(h: np.ndarray, places: int) -> np.ndarray:
    """Where a word, or split context, is added up over buckets; sorted hashes have sorted places."""
    return (((h >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)).astype(np.int64)


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(ROW_TYPES.items())})


def rows_of(bucket: int, cells: Cells, t: np.ndarray, before: np.ndarray, split: np.ndarray, state: bytes, places: int) -> pa.Table:
    """What a bucket sends after a pass: to each place its words' tables and its split contexts', and its seating."""
    ctx = np.flatnonzero(np.isin(cells.contexts, split))
    contexts, tables = cells.contexts[ctx], np.bincount(cells.ctx, t, len(cells.contexts)).astype(np.int64)[ctx]
    of_words, of_contexts = (np.searchsorted(place_of(h, places), np.arange(places + 1)) for h in (cells.words, contexts))
    sums = np.bincount(cells.word, t, len(cells.words)).astype(np.int64)
    rows = [(bucket, STATE, None, state, int((cells.count == 1).sum()), int((cells.count == 2).sum()))]
    for k in range(places):
        i, j = slice(of_words[k], of_words[k + 1]), slice(of_contexts[k], of_contexts[k + 1])
        if i.stop > i.start or j.stop > j.start:
            rows.append((bucket, SENT, k, pack(cells.words[i], sums[i], before[i], cells.word_counts[i], contexts[j], tables[j], cells.customers[ctx[j]]), None, None))
    return table_of(rows)


def read_group(group: pa.Table) -> tuple[int, Cells, list[np.ndarray], list[list[np.ndarray]]]:
    """bucket, cells, seating (empty before the first) and replies, in order of their places, of a bucket."""
    kind, place = group.column("kind").to_numpy(), group.column("place").to_pylist()
    blob = lambda k: [group.column("blob")[int(i)].as_py() for i in sorted(np.flatnonzero(kind == k), key=lambda i: place[i] or 0)]
    state = blob(STATE)
    return group.column("bucket")[0].as_py(), Cells(blob(CELLS)[0]), unpack(state[0]) if state else [], [unpack(x) for x in blob(REPLY)]


def parent_of(cells: Cells, t: np.ndarray, replies: list[list[np.ndarray]], split: np.ndarray) -> Parent:
    a, b, c, ctx_a, ctx_c = (np.concatenate([r[i] for r in replies]).astype(np.int64) for i in range(5))
    at = np.flatnonzero(np.isin(cells.contexts, split))
    if len(a) != len(cells.words) or len(ctx_a) != len(at):
        raise ValueError("the replies don't fit the bucket's words")
    tables, customers = np.bincount(cells.ctx, t, len(cells.contexts)).astype(np.int64), cells.customers.copy()
    tables[at], customers[at] = ctx_a, ctx_c
    return Parent(a, b, c, tables, customers)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def by_key(rows: DataFrame, key: str, n: int):
    """rows grouped by key, in n partitions."""
    return rows.repartition(n, key).groupBy(key)


def first_pass(cells: DataFrame, split: np.ndarray, places: int, partitions: int) -> DataFrame:
    """Everybody of a word at one table."""

    def run(group: pa.Table) -> pa.Table:
        bucket, c, _, _ = read_group(group)
        return rows_of(bucket, c, c.tables(None), np.zeros(len(c.words), np.int64), split, pack(np.ones(len(c.several), np.int64)), places)

    return by_key(cells, "bucket", partitions).applyInArrow(run, ROWS)


def next_pass(rows: DataFrame, split: np.ndarray, totals: Totals, k: int, places: int, partitions: int) -> DataFrame:
    """Round k from rows (cells, seatings and replies after round k - 1). Seatings that count are carried along."""

    def run(group: pa.Table) -> pa.Table:
        bucket, c, state, replies = read_group(group)
        t = c.tables(state[0])
        parent = parent_of(c, t, replies, split)
        if k - 1 > ROUNDS - SAMPLES:
            state += [state[0], parent.customers, parent.tables, parent.ctx_tables[np.isin(c.contexts, split)]]
        state[0] = sweep(c, state[0], parent, totals, k - 1)
        return rows_of(bucket, c, c.tables(state[0]), parent.tables, split, pack(*state), places)

    return by_key(rows, "bucket", partitions).applyInArrow(run, ROWS)


def last_pass(rows: DataFrame, split: np.ndarray, totals: Totals, partitions: int) -> DataFrame:
    """block, part (the bucket) and payload: of each block's cells in the bucket log10 of the averaged probability, and the word's count."""

    def run(group: pa.Table) -> pa.Table:
        bucket, c, state, replies = read_group(group)
        parent = parent_of(c, c.tables(state[0]), replies, split)
        at = np.flatnonzero(np.isin(c.contexts, split))
        all_ = [state[i : i + 4] for i in range(1, len(state), 4)] + [[state[0], parent.customers, parent.tables, parent.ctx_tables[at]]]
        p = np.zeros(len(c.count))
        for n, (several, customers, tables, split_tables) in enumerate(all_):
            t = c.tables(several)
            ctx_tables = np.bincount(c.ctx, t, len(c.contexts)).astype(np.int64)
            ctx_tables[at] = split_tables
            here = Parent(customers.astype(np.int64), tables.astype(np.int64), parent.count, ctx_tables, parent.ctx_customers)
            p += probabilities(c, t, here, totals, ROUNDS - len(all_) + 1 + n)
        log_p, known = np.log10(p / len(all_)).astype("<f4").view("<u4"), parent.count[c.word]
        refs = next(group.column("blob")[int(i)].as_py() for i in np.flatnonzero(group.column("kind").to_numpy() == REFS))
        blocks, sizes, steps = unpack(refs)
        ends = np.cumsum(sizes.astype(np.int64))
        out = []
        for a, b in zip(ends - sizes, ends, strict=True):
            at = np.cumsum(steps[a:b].astype(np.int64))
            out.append(pack(log_p[at], known[at]))
        return pa.table({"block": pa.array(blocks.astype(np.int64)), "part": pa.array(np.full(len(out), bucket)), "payload": pa.array(out, pa.binary())})

    return by_key(rows, "bucket", partitions).applyInArrow(run, "block long, part long, payload binary")


def replies(rows: DataFrame, totals: Totals | None, k: int, places: int) -> DataFrame:
    """What buckets get back: of each of their words its customers and tables in the parent and its count, of split contexts tables and customers. And a row of sums for each place."""

    def run(group: pa.Table) -> pa.Table:
        place, buckets = group.column("place")[0].as_py(), group.column("bucket").to_pylist()
        parts = [unpack(x.as_py()) for x in group.column("blob")]
        h, a, before, c, ctx, ctx_a, ctx_c = (np.concatenate([p[i] for p in parts]) for i in range(7))
        words, of = np.unique(h, return_inverse=True)
        contexts, of_ctx = np.unique(ctx, return_inverse=True)
        add = lambda x, of, n: np.bincount(of, x, n).astype(np.int64)
        customers, count = add(a, of, len(words)), add(c, of, len(words))
        tables = np.zeros(len(words), np.int64)
        tables[of] = before  # all buckets were told the same
        tables = np.minimum(customers, 1) if totals is None else seat_parent(words, customers, tables, totals, k)
        whole = [x[of] for x in (customers, tables, count)], [add(x, of_ctx, len(contexts))[of_ctx] for x in (ctx_a, ctx_c)]
        rows_, i, j = [], 0, 0
        for bucket, p in zip(buckets, parts, strict=True):
            rows_.append((bucket, REPLY, place, pack(*(x[i : i + len(p[0])] for x in whole[0]), *(x[j : j + len(p[4])] for x in whole[1])), *[None] * 6))
            i, j = i + len(p[0]), j + len(p[4])
        rows_.append((None, SUMS, place, None, *(int(x.sum()) for x in (customers, tables, count, count > 0, customers == 1, customers == 2))))
        names = dict.fromkeys(("customers", "tables", "tokens", "words", "one", "two"), pa.int64())
        return pa.table({n: pa.array([r[i] for r in rows_], t) for i, (n, t) in enumerate((dict(list(ROW_TYPES.items())[:4]) | names).items())})

    sent = rows.filter(F.col("kind") == SENT).select("bucket", "place", "blob")
    return kept(by_key(sent, "place", places).applyInArrow(run, "bucket long, kind int, place long, blob binary, customers long, tables long, tokens long, words long, one long, two long"), "replies")


def scored(parts: DataFrame, key: str, totals: Totals) -> DataFrame:
    """Documents with their scores, from the rows of documents and what buckets gave for their blocks."""
    floor = math.log10(totals.tokens + totals.words + 1)

    def run(group: pa.Table) -> pa.Table:
        part, payload = group.column("part").to_pylist(), group.column("payload")
        metas = [i for i, p in enumerate(part) if p is None]
        ids, null, held, n, step = unpack(payload[metas[0]].as_py())
        found = [unpack(payload[i].as_py()) for _, i in sorted({p: i for i, p in enumerate(part) if p is not None}.items())]
        log_p, count = np.concatenate([f[0] for f in found]).astype("<u4").view("<f4").astype(float), np.concatenate([f[1] for f in found])
        first = np.append(0, np.cumsum(n.astype(np.int64))[:-1])
        # cells of a document are numbered by their steps, each document's from 0
        at = np.cumsum(step.astype(np.int64))
        at -= np.repeat(np.append(0, at[first[1:] - 1]), n)
        add = lambda x: np.add.reduceat(x[at], first)
        score, n = add(log_p), n.astype(np.int64)
        ids = (ids.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        table = {
            key: pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(n), "n_known": pa.array(add((count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ids), totals.tokens)),
            "base_score": pa.array(add(np.log10(count + 1.0)) - n * floor), "score": pa.array(score), "perplexity": pa.array(10 ** (-score / n)),
        }
        return pa.concat_tables([pa.table(table)] * len(metas))  # blocks of the same rows are scored as often as they occur

    return parts.groupBy("block").applyInArrow(run, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (by token, of the score).

    Rows whose crc32(key as text) mod 7 is 2 are held out (a null key counts as the empty text), the model learns from
    all others. A null or empty text is its end alone. Repeated rows count, and are scored, as often as they occur.
    Discounts come from the numbers of cells, and of words' contexts, that occur once and twice. No task holds more
    than a block of documents or a bucket; what is broadcast are the split contexts, at most 8 for each bucket.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    docs = docs.select(F.col(key).cast("long").alias("id"), held.alias("held"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    partitions = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * buckets), buckets // 4)
    places = -(-buckets // 4)
    deal = dealing(docs, buckets)
    table = kept(merged(dealt(docs, deal), partitions), "cells")
    of_buckets = table.filter("bucket >= 0")
    cells, refs = (of_buckets.select("bucket", F.lit(k).alias("kind"), F.col(c).alias("blob")) for k, c in ((CELLS, "cells"), (REFS, "refs")))
    rows = kept(first_pass(union([spark.createDataFrame([], ROWS), cells]), deal.split, places, partitions), "seatings")
    back, totals = replies(rows, None, 0, places), None
    for k in range(ROUNDS + 1):
        got = back.filter(F.col("kind") == SUMS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "tables", "tokens", "words", "one", "two"))).first()
        if totals is None:
            cell = rows.filter(F.col("kind") == STATE).agg(F.sum("one").alias("one"), F.sum("two").alias("two")).first()
            clip = lambda x: min(0.9, max(0.05, x["one"] / (x["one"] + 2 * x["two"]) if x["one"] else 0.5))
            totals = Totals(got["words"], got["tokens"], (clip(got), clip(cell)))
        totals.rounds.append((got["customers"], got["tables"]))
        known = union([rows.filter(F.col("kind") == STATE), cells, back.filter(F.col("kind") == REPLY).select("bucket", "kind", "place", "blob")])
        if k < ROUNDS:
            after = kept(next_pass(known, deal.split, totals, k + 1, places, partitions), "seatings")
            back_after = replies(after, totals, k + 1, places)
            drop_kept(rows, back)
            rows, back = after, back_after
    parts = last_pass(union([known, refs]), deal.split, totals, partitions)
    documents = table.filter("bucket < 0").select("block", F.lit(None).cast("long").alias("part"), F.col("refs").alias("payload"))
    return scored(parts.unionByName(documents), key, totals)
