import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from weightlake.llm import katz

K = katz.CUTOFF


def discounts(counts):
    n = Counter(counts.values())
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1
    out = {}
    for r in range(1, K + 1):
        good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0
        f = (good - tail) / (1 - tail) if tail < 1 else 0
        out[r] = f if 0 < f < 1 else (r - 0.5) / r
    return out


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


class Brute:
    def __init__(self, rows):
        self.tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"] for _, t in rows]
        train = [t for (d, _), t in zip(rows, self.tokens) if not held(d)]
        self.one = Counter(w for t in train for w in t)
        two = Counter(p for t in train for p in zip(["\ns", *t], t))
        self.n, self.v = sum(self.one.values()), len(self.one)
        d1, self.d2 = discounts(self.one), discounts(two)
        mass = sum(d1.get(c, 1) * c for c in self.one.values())
        below = self.n if mass < self.n else self.n + 1
        self.p1 = {w: d1.get(c, 1) * c / below for w, c in self.one.items()}
        self.unseen = 1 - mass / below if self.n else 1.0
        self.after = defaultdict(dict)
        for (h, w), c in two.items():
            self.after[h][w] = c
        self.h = {}
        for h, ws in self.after.items():
            total, left = sum(ws.values()), sum(c * (1 - self.d2.get(c, 1)) for c in ws.values())
            below = total if left > 0 else total + 1
            left = left if left > 0 else 1
            self.h[h] = below, left / below / max(1 - sum(self.p1[w] for w in ws), 1e-15)

    def p(self, h, w):
        if w in self.after.get(h, ()):
            c = self.after[h][w]
            return self.d2.get(c, 1) * c / self.h[h][0]
        return (self.h[h][1] if h in self.h else 1) * self.p1.get(w, self.unseen)

    def rows(self, ids):
        for d, t in zip(ids, self.tokens):
            base = sum(math.log10((self.one.get(w, 0) + 1) / (self.n + self.v + 1)) for w in t)
            yield d, held(d), len(t), sum(w in self.one for w in t), self.n, base, sum(math.log10(self.p(h, w)) for h, w in zip(["\ns", *t], t))


def check(spark, rows, parts=4):
    brute = Brute(rows)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, batch int").repartition(parts)
    key = lambda r: (str(r[0]), *r[1:4], round(r[5], 6), round(r[6], 6))
    got = sorted((tuple(r) for r in katz.score_documents(df).collect()), key=key)
    want = sorted(brute.rows([d for d, _ in rows]), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)
    return brute


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"W{int(rng.paretovariate(0.8))}" for _ in range(20_000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    brute = check(spark, rows)
    # exactly normalised: every history's probabilities, with the unseen word's, add up to one
    for h in list(brute.after)[:40]:
        total = sum(brute.p(h, w) for w in brute.one) + brute.h[h][1] * brute.unseen
        assert abs(total - 1) < 1e-9


def test_many_batches_and_a_frequent_history(spark, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_BYTES", 400)
    rng = random.Random(2)
    rows = [(i, " ".join(f"the w{rng.randrange(300)}" for _ in range(rng.randint(1, 40)))) for i in range(120)]
    check(spark, rows, 3)


def test_edge_rows(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check(spark, [(1, None), (2, ""), (None, " a\tB "), (3, "a b"), (3, "a b"), (4, "z " * 3000)])
    only_held = next(i for i in range(100) if held(i))
    check(spark, [(only_held, "never seen")])


def test_held_out_texts_gain(spark):
    df = katz.score_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("held_out")
    r = df.selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_table_is_dropped(spark):
    katz.score_documents(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("katz_batches")]
