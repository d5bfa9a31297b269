"""The language model against a sampler that reseats one customer at a time, and against counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gristmill.llm import pitman_yor

from .test_operators import ODD, docs


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["\0"]


def test_language_model(spark):
    rng = random.Random(11)

    def follow(n):
        at = [rng.randrange(60)]
        for _ in range(n):  # a word mostly has one of two after it
            at.append((at[-1] * 7 + rng.randrange(2)) % 60 if rng.random() < 0.9 else rng.randrange(60))
        return " ".join(f"W{x}" for x in at)

    texts = list(enumerate([*ODD, *(follow(rng.randrange(200)) for _ in range(150))]))
    df = docs(spark, texts, "clash").union(docs(spark, texts[-2:], "clash"))
    got = pitman_yor.score(df).collect()
    assert len(got) == len(texts) + 2
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in texts + texts[-2:] if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    by = dict(texts)
    for r in got:
        w = tokens(by[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(w)))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.8 * sum(r["base_score"] for r in out)  # what follows a word is mostly known
    parts = pitman_yor.score(df.repartition(5)).collect()
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in parts) == sorted((r["doc_id"], round(r["score"], 6)) for r in got)
    assert pitman_yor.score(df.limit(0)).count() == 0


def test_split_contexts_and_many_buckets_give_the_same(spark, monkeypatch):
    rng = random.Random(14)
    texts = list(enumerate(" ".join("the" if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.8)) % 500}" for _ in range(rng.randrange(60))) for _ in range(200)))
    df = docs(spark, [*texts, (None, "the the the"), (3, texts[3][1])])
    rows = lambda: sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6), r["n_tokens"], r["score"]) for r in pitman_yor.score(df).collect())
    one = rows()
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 4000)
    found = []
    find = pitman_yor.dealing
    monkeypatch.setattr(pitman_yor, "dealing", lambda *a: found.append(find(*a)) or found[-1])
    many = rows()
    assert [x[:4] for x in many] == [x[:4] for x in one]
    # which words of a context are reseated in turn depends on how it is split, so the seatings are others
    assert max(abs(a[4] - b[4]) / a[3] for a, b in zip(many, one, strict=True)) < 0.08 and sum(a[4] for a in many) == pytest.approx(sum(b[4] for b in one), rel=0.005)
    assert found[0].buckets > 5 and pitman_yor.tokens_of("the")[0][0] in found[0].split and found[0].parts.max() > 2


class Plain:
    """The same model, its customers taken out and reseated one by one."""

    def __init__(self, texts, d, s, base, seed):
        self.d, self.s, self.base, self.rng = d, s, base, random.Random(seed)
        self.tables, self.parent = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        self.cells = [(u, w) for t in texts for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)]
        for u, w in self.cells:
            self.add(u, w)

    def single(self, w):
        customers, tables = sum(map(sum, self.parent.values())), sum(map(len, self.parent.values()))
        return (sum(self.parent[w]) - self.d[0] * len(self.parent[w]) + (self.s[0] + self.d[0] * tables) * self.base) / (self.s[0] + customers)

    def probability(self, u, w):
        mine = self.tables[u][w]
        customers, tables = sum(map(sum, self.tables[u].values())), sum(map(len, self.tables[u].values()))
        return (sum(mine) - self.d[1] * len(mine) + (self.s[1] + self.d[1] * tables) * self.single(w)) / (self.s[1] + customers)

    def sit(self, tables, discount, new):
        k = self.rng.choices(range(len(tables) + 1), [n - discount for n in tables] + [new])[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def leave(self, tables):
        k = self.rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(self, u, w):
        n = sum(map(len, self.tables[u].values()))
        if self.sit(self.tables[u][w], self.d[1], (self.s[1] + self.d[1] * n) * self.single(w)):
            n = sum(map(len, self.parent.values()))
            self.sit(self.parent[w], self.d[0], (self.s[0] + self.d[0] * n) * self.base)

    def sweep(self):
        for u, w in self.cells:
            if self.leave(self.tables[u][w]):
                self.leave(self.parent[w])
            self.add(u, w)


@pytest.mark.parametrize(("n", "v", "d"), [(10, 8, (0.5, 0.6)), (25, 30, (0.7, 0.8)), (20, 3, (0.3, 0.4))])
def test_seatings_agree_with_reseating_one_by_one(n, v, d):
    rng, s, rounds, burn = random.Random(4), pitman_yor.STRENGTH, 700, 100
    texts = [[f"w{int(rng.paretovariate(0.8)) % v}" for _ in range(rng.randrange(3, 9))] for _ in range(n)]
    names = sorted({w for t in texts for w in t} | {"</s>"})
    plain = Plain(texts, d, s, 1 / (len(names) + 1), 5)
    count = Counter(plain.cells)
    keys = sorted(count, key=lambda x: (x[0], names.index(x[1])))
    contexts = sorted({u for u, _ in keys})
    per = [sum(u == x for u, _ in keys) for x in contexts]
    number = np.arange(1, len(names) + 1, dtype=np.uint64)
    cells = pitman_yor.Cells(pitman_yor.pack(np.arange(len(contexts), dtype=np.uint64), np.array(per), number, np.array([names.index(w) for _, w in keys]), np.array([count[k] for k in keys])))
    totals = pitman_yor.Totals(len(names), len(plain.cells), d)
    several, before = np.ones(len(cells.several), np.int64), np.zeros(len(names), np.int64)
    got, want, tables = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(2)
    for k in range(rounds):
        t = cells.tables(several)
        customers = np.bincount(cells.word, t, len(names)).astype(np.int64)
        before = np.minimum(customers, 1) if k == 0 else pitman_yor.seat_parent(cells.words, customers, before, totals, k)
        totals.rounds.append((int(customers.sum()), int(before.sum())))
        parent = pitman_yor.Parent(customers, before, cells.word_counts, np.bincount(cells.ctx, t, len(contexts)).astype(np.int64), cells.customers)
        p = pitman_yor.probabilities(cells, t, parent, totals, k)
        plain.sweep()
        if k >= burn:
            got += p / (rounds - burn)
            want += np.array([plain.probability(*x) for x in keys]) / (rounds - burn)
            tables += np.array([t.sum(), sum(len(x) for of in plain.tables.values() for x in of.values())]) / (rounds - burn)
        several = pitman_yor.sweep(cells, several, parent, totals, k)
    assert tables[0] == pytest.approx(tables[1], rel=0.02)
    assert abs(np.log(got / want)).max() < 0.15 and abs(np.log(got / want)).mean() < 0.02


def test_probabilities_after_a_context_sum_to_one():
    rng = np.random.default_rng(12)
    count = np.where(rng.random((30, 50)) < 0.3, rng.integers(1, 3000, (30, 50)), 0)
    count[:, 7] += 1
    cells = pitman_yor.Cells(pitman_yor.pack(np.arange(30), np.full(30, 50), np.arange(50), np.tile(np.arange(50), 30), count.ravel()))
    totals = pitman_yor.Totals(50, int(count.sum()), (0.5, 0.7))
    t = cells.tables(None)
    customers = np.bincount(cells.word, t, 50).astype(np.int64)
    totals.rounds.append((int(customers.sum()), 50))
    parent = pitman_yor.Parent(customers, np.ones(50, np.int64), cells.word_counts, np.bincount(cells.ctx, t, 30).astype(np.int64), cells.customers)
    several = pitman_yor.sweep(cells, np.ones(len(cells.several), np.int64), parent, totals, 0)
    t = cells.tables(several)
    assert (t <= cells.count).all() and (t >= np.minimum(cells.count, 1)).all()
    parent = pitman_yor.Parent(np.bincount(cells.word, t, 50).astype(np.int64), np.ones(50, np.int64), cells.word_counts, np.bincount(cells.ctx, t, 30).astype(np.int64), cells.customers)
    totals.rounds.append((int(parent.customers.sum()), 50))
    p = pitman_yor.probabilities(cells, t, parent, totals, 1).reshape(30, 50).sum(axis=1)
    s, d = pitman_yor.STRENGTH, totals.discount
    unknown = (s[1] + d[1] * parent.ctx_tables) / (s[1] + cells.customers) * totals.new(1) / (s[0] + totals.rounds[1][0])
    assert np.allclose(p + unknown, 1)


@pytest.mark.parametrize("d", [0.05, 0.3, 0.5, 0.8, 0.9])
def test_large_numbers_of_seatings(d):
    exact = pitman_yor.seatings(d, 3000)
    t = np.unique(np.geomspace(1, 2500, 80).astype(int))
    assert abs(pitman_yor.log_seatings(np.full(len(t), 3000), t, d) - exact[3000, t]).max() < 0.1
    # drawn tables of many customers have the mean that the exact weights give
    n, log_base = 1500, math.log(1e-4)
    some = pitman_yor.Root(np.full(3000, n), np.full(3000, 400), 1e-4, (1.0, d))
    got = some.draw(pitman_yor.draw(pitman_yor.mix(np.arange(3000, dtype=np.uint64)), 1))
    weight = exact[n, 1 : n + 1] + np.cumsum(np.log(1 + d * (400 + np.arange(n))) + log_base)
    p = np.exp(weight - weight.max())
    assert got.mean() == pytest.approx((p * np.arange(1, n + 1)).sum() / p.sum(), rel=0.03)
