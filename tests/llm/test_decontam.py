import itertools
import random
import re

from weightlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").lower())


def brute(docs, items):
    out = set()
    least = min(map(len, decontam.MASKS))
    for d, t in docs:
        w = words(t)
        for k, s in items:
            v = words(s)
            width = min(len(v), decontam.WINDOW)
            allowed = decontam.MAX_SUBSTITUTED if width == decontam.WINDOW else 0
            if len(v) < least:
                continue
            if any(sum(0 <= i + x < len(w) and w[i + x] == v[j + x] for x in range(width)) >= width - allowed for i in range(-2, len(w)) for j in range(len(v) - width + 1)):
                out.add((d, k))
    return out


def run(spark, docs, items):
    df = decontam.contaminated_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return [(r.doc_id, r.item_id) for r in df.collect()]


def test_masks_hit_every_window():
    """Some mask fits between any substitutions that a window may hold."""
    for bad in itertools.combinations(range(decontam.WINDOW), decontam.MAX_SUBSTITUTED):
        assert any(all(p + i not in bad for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for p in range(decontam.WINDOW - len(m) + 1))


def test_finds_substituted_passages(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([6, 8, 12, 13, 20, 40])))) for k in range(30)]
    docs = []
    for d in range(120):
        t = text(rng.randint(0, 80))
        _, s = rng.choice(items)
        s = s.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            s[rng.randrange(len(s))] = "changed"
        if d % 2:
            k = rng.randint(0, len(t))
            t = t[:k] + [x.upper() + "," for x in s] + t[k:]
        docs.append((d, " ".join(t)))
    got = run(spark, docs, items)
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items) and len(got) > 15


def test_edge_rows(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    assert run(spark, [], [(1, passage)]) == []
    assert run(spark, [(1, passage)], []) == []
    docs = [(None, passage), (1, None), (2, ""), (3, passage), (3, passage), (3, "x " + passage), (4, "y " * 30_000 + passage)]
    got = sorted(run(spark, docs, [(7, passage), (7, passage), (None, None), (8, "")]), key=str)
    assert got == [(3, 7), (3, 7), (4, 7), (None, 7)]


def test_drop_keeps_columns(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, "a"), (2, "clean text", "b"), (2, "clean text", "b"), (None, None, None)], "doc_id long, text string, th string")
    got = decontam.drop_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(2, "clean text", "b"), (2, "clean text", "b"), (None, None, None)]


def brute_short(docs, items):
    """As ``brute``, with items of every length, and one substitution from eight words on."""
    out = set()
    for d, t in docs:
        w = words(t)
        for k, s in items:
            v = words(s)
            width = min(len(v), decontam.WINDOW)
            allowed = 2 if width == decontam.WINDOW else 1 if width >= 8 else 0
            if v and any(sum(0 <= i + x < len(w) and w[i + x] == v[j + x] for x in range(width)) >= width - allowed for i in range(-2, len(w)) for j in range(len(v) - width + 1)):
                out.add((d, k))
    return out


def test_short_items(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(k % 15))) for k in range(60)]
    docs = []
    for d in range(200):
        t, s = text(rng.randint(0, 30)), rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            if s:
                s[rng.randrange(len(s))] = "changed"
        k = rng.randint(0, len(t))
        docs.append((d, " ".join(t[:k] + s + t[k:])))
    # every place of one substitution, at the text's start, end and alone
    for k, s in items[:15]:
        for x in range(len(words(s))):
            v = words(s)
            v[x] = "changed"
            docs.append((1000 + len(docs), " ".join(v)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated_spans(*frames, short=True).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_short(docs, items) and set(got) > brute(docs, items)


def test_short_items_in_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "so who wrote the book of hours"), (2, "name the largest lake in all of africa now"), (3, "clean")], "doc_id long, text string")
    spark.createDataFrame([(1, "Who wrote the book?"), (2, "Name the largest city in all of Africa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [3]
