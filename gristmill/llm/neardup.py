"""Near-duplicate documents by MinHash signatures in a multi-index Hamming join, confirmed on full shingle sets.

A signature is cut into chunks of slots. If two signatures differ in fewer slots than twice the number of chunks, some
chunk differs in one slot at most (pigeonhole); leaving out each slot of each chunk in turn gives keys of which such a
pair shares at least one. So all pairs under that distance meet, and nearly all similar pairs do that lie beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, kept, prepare, release

WORDS = 5
#: Slots of a chunk; slots of the longer signature and bits of the map that pairs are compared by before their sets are.
SLOTS, LONG, BITS = 6, 128, 1024
#: Chances that a pair at exactly the limit of similarity shares no key, and that its longer signatures are too far apart.
MISSED, TOO_FAR = 1e-5, 1e-9
BLOCK = 1 << 20
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 256
#: Classes of copies that hold at least one in so many of all rows have their rows joined without an exchange.
HOT_CLASSES = 1000
#: Members of a bucket that are compared in one go; larger buckets are compared block by block, in different tasks.
SIDE = 512

@dataclass(frozen=True)
class Limit:
    """A link: 100 * intersection >= percent * union. What is needed for it follows."""

    percent: int = 85

    @property
    def differ(self) -> float:
        """Chance that a slot of eight bits differs between sets at the limit."""
        return (1 - self.percent / 100) * 255 / 256

    @property
    def chunks(self) -> int:
        """So many that the chance that all differ in two slots or more is small."""
        p = self.differ
        two = 1 - (1 - p) ** SLOTS - SLOTS * p * (1 - p) ** (SLOTS - 1)
        return min(LONG // SLOTS, math.ceil(math.log(MISSED) / math.log(two)))

    @property
    def distance(self) -> int:
        """Signatures in fewer than this many different slots always share a key."""
        return 2 * self.chunks

    @property
    def far(self) -> int:
        """Pairs further apart than this in the longer signature aren't confirmed."""
        p, left = self.differ, 1.0
        for d in range(LONG):
            left -= math.comb(LONG, d) * p**d * (1 - p) ** (LONG - d)
            if left < TOO_FAR:
                return d
        return LONG


P = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i, modulo 2^64, for i < n."""
    up = np.full(n, P, np.uint64)
    down = np.full(n, pow(P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
UP, DOWN = powers(BLOCK)
OWN = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))  # each byte's own number


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, in order; worked off a block of words at a time."""
    raw = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK - 1)
        if end < len(raw):
            cut = np.flatnonzero(SPACE[raw[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # a word longer than a block
                later = np.flatnonzero(SPACE[raw[end:]])
                end = end + int(later[0]) if len(later) else len(raw)
                out.append(np.array([long_hash(LOWER[raw[at:end]])], np.uint64))
                at = end
                continue
        out.append(word_hashes_in(LOWER[raw[at:end]]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_hashes_in(b: np.ndarray) -> np.ndarray:
    space = SPACE[b]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(OWN[b] * UP[: len(b)], out=sums[1:])
    out = mix((sums[end] - sums[start]) * DOWN[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = long_hash(b[start[i] : end[i]])
    return out


def long_hash(b: np.ndarray) -> int:
    """Long words can be made to collide under a polynomial modulo a power of two, so they have another hash."""
    return xxhash.xxh3_64_intdigest(b.tobytes(), 1)


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes; of fewer words the whole sequence is one."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(P) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


SEEDS = mix(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(P))


def signature(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """Eight bits of each of LONG minima, each of another multiply-shift hash of the shingles."""
    least = np.full(LONG, MASK, np.uint64)
    odd = (SEEDS | np.uint64(1))[:, None]
    for i in range(0, len(shingles), block):
        x = shingles[i : i + block]
        h = (x ^ (SEEDS >> np.uint64(7))[:, None]) * odd
        np.minimum(least, h.min(axis=1), out=least)
    return (mix(least) >> np.uint64(56)).astype(np.uint8)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, np.uint8)
    out[(shingles >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(out)


def chunk_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """chunks * SLOTS keys for each signature: a chunk without one of its slots, chunk by chunk and slot by slot."""
    part = signatures[:, : chunks * SLOTS].astype(np.uint64).reshape(-1, chunks, SLOTS)
    out = np.empty((len(signatures), chunks, SLOTS), np.uint64)
    for left_out in range(SLOTS):
        h = np.full(part.shape[:2], left_out + 1, np.uint64) + np.arange(chunks, dtype=np.uint64) * np.uint64(64)
        for slot in range(SLOTS):
            if slot != left_out:
                h = mix(h * np.uint64(P) + part[:, :, slot])
        out[:, :, left_out] = h
    return out.reshape(len(signatures), -1)


def whole(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set as a whole."""
    if not len(shingles):
        return b""
    both = np.bitwise_xor.reduce(mix(shingles * np.uint64(P))), np.add.reduce(mix(shingles ^ np.uint64(P)))
    return b"".join(int(x).to_bytes(8, "little") for x in both)


def sets_of(docs: DataFrame) -> DataFrame:
    """id, n, whole and shingles (array of long) of each row of docs(id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set((t.as_py() or "").encode()) for t in part.column(1)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                arrays = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([whole(s) for s in sets], pa.binary()), arrays], names=["id", "n", "whole", "shingles"])
        release()

    return docs.select("id", "text").mapInArrow(run, "id long, n long, whole binary, shingles array<long>")


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs(id, text): id, n, whole, sign (the signature) and bits (the bitmap)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                s = shingle_set((t.as_py() or "").encode())
                rows.append((len(s), whole(s), signature(s).tobytes(), bitmap(s).tobytes()))
            more = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *more], names=["id", "n", "whole", "sign", "bits"])
        release()

    return docs.select("id", "text").mapInArrow(run, "id long, n long, whole binary, sign binary, bits binary")


def keys_of(rows: DataFrame, chunks: int) -> DataFrame:
    """id, slot (number of the key, from 0) and bucket (the key) of rows(id, sign, ...), one for each key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                keys = chunk_keys(wide(part.column(1)), chunks).view(np.int64)
                n = keys.shape[1]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), pa.array(keys.ravel())], names=["id", "slot", "bucket"])

    return rows.select("id", "sign").mapInArrow(run, "id long, slot int, bucket long")


def wide(column: pa.Array) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def close(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, limit: Limit) -> np.ndarray:
    """Which of some pairs may be links, by their sizes n and m, long signatures a and b, bitmaps p and q.

    Sizes and bitmaps exclude no link: sets that overlap enough differ in few elements, and so in few bits.
    """
    apart = (n + m) * (100 - limit.percent) / (100 + limit.percent)  # the most elements by which linked sets differ
    ok = np.abs(n - m) <= apart
    ok[ok] = ONES[p[ok] ^ q[ok]].sum(axis=1) <= apart[ok]
    ok[ok] = (a[ok] != b[ok]).sum(axis=1) <= limit.far
    return ok


def confirmed(pairs: DataFrame, docs: DataFrame, heads: DataFrame, limit: Limit) -> DataFrame:
    """Of pairs(a, b) of ids those whose full sets are alike enough. Sets are computed for documents in pairs only."""
    pairs = kept(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    needed = broadcast_if_small(needed, needed.count(), 2_000_000)
    sets = sets_of(docs.join(needed, "id", "left_semi")).join(heads.select("id", "whole"), ["id", "whole"], "left_semi").dropDuplicates(["id", "whole"])
    sets = kept(sets.drop("whole"), "sets")
    left, right = sets.select(F.col("id").alias("a"), "n", F.col("shingles").alias("s")), sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return kept(pairs.join(left, "a").join(right, "b").filter(both * 100 >= limit.percent * (F.col("n") + F.col("m") - both)).select("a", "b"), "links")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of links(a, b) reaches. Large and small stars in turn.

    Every round sends each edge's ends to the least neighbour; a hub's edges are combined before their shuffle (only
    its least neighbour is gathered), and each round's edges are written to the shared folder.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        after = kept(small.filter("u <> v").distinct(), "edges")
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def cross_pairs(members: DataFrame, limit: Limit) -> DataFrame:
    """Pairs (a, b) that may be links and lie in different components, of members(bucket, x, y, side, id, component, ...).

    Rows come sorted by (bucket, x, y), a group at a time; side 0 is compared with side 1, and with itself where x = y.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            ids = [t.column(c).to_numpy() for c in ("bucket", "x", "y")]
            change = np.flatnonzero((ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (ids[2][1:] != ids[2][:-1])) + 1
            for lo, hi in zip([0, *change[:-1]], change, strict=False):
                yield from compare(t.slice(lo, hi - lo), limit)
            rest = t.slice(int(change[-1])) if len(change) else t
        if rest is not None and rest.num_rows:
            yield from compare(rest, limit)

    return members.mapInArrow(run, "a long, b long")


def compare(t: pa.Table, limit: Limit) -> Iterator[pa.RecordBatch]:
    side, ids, comp, n = (t.column(c).to_numpy() for c in ("side", "id", "component", "n"))
    sign, bits = wide(t.column("sign")), wide(t.column("bits"))
    own, slot = t.column("x")[0].as_py() == t.column("y")[0].as_py(), t.column("slot")[0].as_py()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
    n = n.astype(np.float64)
    for i in left:
        j = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (not own))]
        if len(j):
            k = np.full(len(j), i)
            j = j[close(n[k], n[j], sign[k], sign[j], bits[k], bits[j], limit)]
        if len(j):
            j = j[first_shared(sign[i], sign[j], limit.chunks) == slot]
        if len(j):
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(ids[i], ids[j])), "b": pa.array(np.maximum(ids[i], ids[j]))})


def first_shared(a: np.ndarray, b: np.ndarray, chunks: int) -> np.ndarray:
    """The number of the first key that signature a shares with each of b, which share one: there the pair is given."""
    differ = (a[: chunks * SLOTS] != b[:, : chunks * SLOTS]).reshape(-1, chunks, SLOTS)
    chunk = (differ.sum(axis=2) <= 1).argmax(axis=1)
    return chunk * SLOTS + differ[np.arange(len(b)), chunk].argmax(axis=1)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links) and kept (key = component_id).

    A link is a similarity of `percent` or more. Texts of equal sets are one class, held by its smallest key; classes are joined by chunk keys. First every bucket's
    members are held against its smallest (a star, so a group of near copies gives as many pairs as it has members);
    then, in buckets that still hold several components, the members of different ones are compared by size, bitmap
    and longer signature, in blocks of bounded size, and what may be a link is confirmed on full sets too. A text
    without words (or null) has an empty set and links with nothing, also not with its repeats. Repeated rows of a key
    are one document to the links: whatever one of its texts links with, the others' partners reach too. A null key
    links with nothing and is its own component (null, kept).
    """
    spark: SparkSession = docs.sparkSession
    limit = Limit(percent)
    prepare(spark)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = kept(sketches(docs), "sketches")
    full = rows.filter("n > 0 and id is not null")
    classes = kept(full.groupBy("n", "whole").agg(F.min("id").alias("class"), F.count("*").alias("copies")), "sets-of-copies")
    held = classes.select(F.col("class").alias("id"), "n", "whole")  # a key repeated with several texts may hold several classes
    heads = kept(full.join(held, ["id", "n", "whole"], "left_semi").dropDuplicates(["id", "whole"]), "classes")
    keys = keys_of(heads, limit.chunks)
    buckets = keys.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("size")).filter("size > 1")
    shared = kept(keys.join(buckets, "bucket").select("bucket", "slot", "id", "least", "size"), "buckets")
    slim = heads.select("id", "n", "sign", "bits")
    stars = shared.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = confirmed(sieved(stars, slim, limit), docs, heads, limit)
    links = links.union(several_texts(full, classes))
    links = links.union(confirmed(residual(shared, components(links), slim, spark, limit), docs, heads, limit))
    found = components(links)
    comps = found.withColumnsRenamed({"id": "class", "component": "__component"})
    of_class = classes.join(comps, "class", "left").select("n", "whole", "copies", F.coalesce("__component", "class").alias("__component"))
    member = with_class(rows.select("id", "n", "whole"), kept(of_class, "components-of-copies"))
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("__component")).otherwise(F.col("id"))
    return member.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def several_texts(full: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): keys that occur with several texts, and the keys that hold these texts' classes."""
    several = full.groupBy("id").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("lo <> hi").select("id")
    texts = kept(full.select("id", "n", "whole").join(several, "id", "left_semi").distinct(), "several-texts")
    return texts.join(classes, ["n", "whole"]).filter("id <> class").select(F.greatest("id", "class").alias("a"), F.least("id", "class").alias("b"))


def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows(id, n, whole) with __component of their class in classes(n, whole, copies, __component).

    Classes of at least one in HOT_CLASSES of all rows, which are at most so many, are broadcast, so that their rows stay
    where they are; all others are joined by an exchange.
    """
    least = -(-(classes.agg(F.sum("copies")).first()[0] or 0) // HOT_CLASSES)
    hot = classes.filter(F.col("copies") >= least).select("n", "whole", F.col("__component").alias("__hot"))
    tagged = rows.join(F.broadcast(hot), ["n", "whole"], "left")
    cold = classes.filter(F.col("copies") < least).select("n", "whole", "__component")
    other = tagged.filter("__hot is null").drop("__hot").join(cold, ["n", "whole"], "left")
    return tagged.filter("__hot is not null").withColumnRenamed("__hot", "__component").unionByName(other)


def sieved(pairs: DataFrame, slim: DataFrame, limit: Limit) -> DataFrame:
    """pairs(a, b) without those that can't be links."""
    left = slim.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("sign").alias("s"), F.col("bits").alias("p"))
    right = slim.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sign").alias("t"), F.col("bits").alias("q"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = {f: b.column(f) for f in b.schema.names}
                ok = close(c["n"].to_numpy().astype(float), c["m"].to_numpy().astype(float), *(wide(c[f]) for f in "stpq"), limit)
                yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(ok)), c["b"].filter(pa.array(ok))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "s", "t", "p", "q").mapInArrow(run, "a long, b long")


def residual(shared: DataFrame, found: DataFrame, slim: DataFrame, spark: SparkSession, limit: Limit) -> DataFrame:
    """Pairs that may be links in buckets that hold several components (buckets of two have been confirmed)."""
    of = shared.filter("size > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = of.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
    members = of.select("bucket", "slot", "id", "component").join(open_.select("bucket", "members"), "bucket").join(slim, "id")
    blocks = F.ceil(F.col("members") / SIDE).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = spread.select("bucket", "slot", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "component", "n", "sign", "bits")
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return cross_pairs(rows, limit)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """docs with one document of each group: that of the smallest key, and of its repeated rows one."""
    name = free_name(docs, "__key")
    found = kept(near_duplicates(docs, key, text, percent).filter("kept").select(F.col(key).alias(name)).distinct(), "first-ones")
    once = docs.join(broadcast_if_small(found, found.count(), 2_000_000), F.col(key).eqNullSafe(F.col(name)), "left_semi")
    if once.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).filter("k is not null and n > 1").isEmpty():
        return once
    return once.filter(F.col(key).isNotNull()).dropDuplicates([key]).union(once.filter(F.col(key).isNull()))
