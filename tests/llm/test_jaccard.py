import random
import re

import numpy as np

from weightlake.llm import jaccard


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ref string").repartition(5)
    return sorted(map(tuple, jaccard.with_component_ids(jaccard.jaccard_components(df)).collect()), key=str)


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([["new"], [], [w[k], "more"]])
    return w


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 80, 200]))]
        rows += [" ".join(near(rng, base, rng.choice([0, 0, 1, 2, 3, 5, 8]))) for _ in range(rng.choice([1, 2, 6]))]
    rng.shuffle(rows)
    rows = [(100 - i, t) for i, t in enumerate(rows)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({c for _, _, c in want}) < len(rows) - 10


def test_chains_and_common_passages(spark):
    """Links that only a chain makes, and documents that share a passage but no link."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows, w = [], [f"c{i}" for i in range(120)]
    for i in range(12):
        rows.append((i, " ".join(w)))
        w = w[8:] + [f"d{i}_{k}" for k in range(8)]
    rows += [(100 + i, " ".join(passage + [f"q{i}_{k}" for k in range(rng.choice([10, 15, 22, 40]))])) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    assert run(spark, []) == []
    rows = [(5, None), (4, ""), (3, " \n"), (2, "a b"), (1, "A B"), (None, "a b"), (9, "one two three four five"), (9, "one two three four five"), (8, "x " * 50_000), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(near(rng, base, rng.choice([1, 2, 3, 4])))) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_sketches_prune_no_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[rng.random(n) < rng.choice([0.7, 0.85, 0.95, 1.0])], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            known, table = jaccard._class_table([jaccard._class_counts(s) for s in (x, y)])
            assert not known.all() or jaccard._counts_may_link(table[0], table[1], len(x), len(y))
            assert abs(int(jaccard._levels(np.array([len(x)]))[0] - jaccard._levels(np.array([len(y)]))[0])) <= 1
            for k in (2, 3):
                assert jaccard.sketches_may_link(np.frombuffer(jaccard._sketch(x, k), "<u2"), len(x), np.frombuffer(jaccard._sketch(y, k), "<u2"), len(y))
