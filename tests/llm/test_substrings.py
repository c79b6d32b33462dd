import random
import re
from collections import Counter

from pyspark.sql import functions as F

from weightlake.llm import substrings


def brute(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, k):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, th int").repartition(4)
    return sorted((tuple(r)[:4] for r in substrings.remove_repeats(df, window=k).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    for k in (12, 35):
        pool = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(k - 3, 3 * k))] for _ in range(8)]
        rows = []
        for d in range(60):
            w = []
            for _ in range(rng.randint(0, 4)):
                p = rng.choice(pool)
                a = rng.randint(0, len(p) // 3)
                w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 10))] + p[a : len(p) - rng.randint(0, len(p) // 3)]
            rows.append((d, "  ".join(w)))
        want = brute(rows, k)
        assert run(spark, rows, k) == want and sum(r[2] for r in want) > 300


def test_repeats_within_a_text(spark):
    for k in (10, 35):
        for text in ("a " * 200, "a b c " * 80, " ".join(f"w{i % 17}" for i in range(120)), " ".join(f"w{i % 50}" for i in range(120)), "a " * (k + 1), "a " * k):
            assert run(spark, [(1, text)], k) == brute([(1, text)], k), (k, text[:30])


def test_edge_rows(spark):
    assert run(spark, [], 35) == []
    long = " ".join(f"w{i}" for i in range(60_000))
    same = " ".join(f"s{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, same), (4, same), (None, same), (5, long), (6, "x " + long[:2000]), (7, "é b " * 50)]
    assert run(spark, rows, 35) == brute(rows, 35)


def test_paths_are_compacted(spark):
    """One passage in three texts is one path, found at its place in each."""
    p = " ".join(f"p{i}" for i in range(300))
    rows = [(i, " ".join(f"x{i}_{k}" for k in range(i * 7)) + " " + p + f" y{i}") for i in range(3)]
    got = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and len({s.path for r in got for s in r.spans}) == 1
    for r in got:
        assert {s.origin for s in r.spans} == {r.id * 7} and max(s.end for s in r.spans) - min(s.start for s in r.spans) == 300


def test_what_is_removed_comes_from_paths(spark, monkeypatch):
    """Without paths, or with other words at their sources, nothing is removed; words stay whole where digests disagree."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {passage} c{i}") for i in range(4)], "doc_id long, text string")
    removed = lambda: sorted(r.n_removed for r in substrings.remove_repeats(docs).collect())
    assert removed() == [60] * 4
    real = substrings.compact_paths
    monkeypatch.setattr(substrings, "compact_paths", lambda found: real(found).where("false"))
    assert removed() == [0] * 4
    monkeypatch.setattr(substrings, "compact_paths", lambda found: real(found).withColumn("source_check", F.col("source_check") + 1))
    assert removed() == [0] * 4


def test_paths_and_their_sources(spark):
    """Two passages that always follow each other are one path, whose source is the earliest document."""
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "xy")
    docs = spark.createDataFrame([(5, f"{one} {two}"), (3, f"start {one} {two} end"), (8, f"q {one} r")], "doc_id long, text string")
    found = {r.id: sorted((s.start, s.end, s.origin) for s in r.spans) for r in substrings.repeated_spans(docs).collect()}
    covered = {k: {w for a, e, _ in v for w in range(a, e)} for k, v in found.items()}
    assert covered == {5: set(range(100)), 3: set(range(1, 101)), 8: set(range(1, 51))}
    assert min(o for _, _, o in found[3]) == 1 and min(o for _, _, o in found[5]) == 0
