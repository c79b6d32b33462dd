import random

from weightlake.llm import lines

BLANK = " \t\n\x0b\f\r"


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    """(kept text, dropped, near) by document, comparing every two lines."""
    low, high = lines.NEAR_CHARS
    every = sorted((i, n, x.strip(BLANK)) for i, t in dict(rows).items() if t is not None for n, x in enumerate(t.split("\n")))
    every = [x for x in every if x[2]]
    first = {}
    for i, n, x in every:
        first.setdefault(x, (i, n))
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (None, 0, 0)
            continue
        kept, near, equal = [], 0, 0
        for n, raw in enumerate(t.split("\n")):
            x = raw.strip(BLANK)
            if x and low <= len(x) <= high and any(low <= len(y) <= high and y != x and p < first[x] and within_one(x, y) for y, p in first.items()):
                near += 1
            elif x and first[x] != (i, n):
                equal += 1
            else:
                kept.append(raw)
        out[i] = ("\n".join(kept), equal + near, near)
    return out


def run(spark, rows, schema="doc_id long, text string"):
    df = lines.dedup_lines(spark.createDataFrame(rows, schema))
    return {r.row.doc_id: (r.row.text, r.n_dropped, r.n_near) for r in df.collect()}


def edited(rng, s):
    k, c = rng.randrange(len(s) + 1), rng.choice("abcé ")
    return rng.choice([s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[: max(k - 1, 0)] + c + s[k:]])


def test_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(rng.randint(0, 12)):
            s = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                s = edited(rng, s)
            t.append(rng.choice(["", " "]) + s)
        rows.append((i, "\n".join(t)))
    got, want = run(spark, rows), brute(rows)
    assert sum(x[2] for x in want.values()) > 20
    assert got == want


def test_template_lines_and_insertions(spark):
    rows = [(i, f"a line with the number {i} in it\nx{i}") for i in range(30)] + [(100, "a line with the number 7 in itt"), (101, "a line with the number 7 n it")]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    assert run(spark, []) == {}
    rows = [(None, "same line here"), (1, None), (2, ""), (3, "same line here\n\n  \nsame line here"), (4, "y" * 5000 + "\n" + "y" * 4999 + "z")]
    got = run(spark, rows)
    assert got == {None: ("same line here", 0, 0), 1: (None, 0, 0), 2: ("", 0, 0), 3: ("\n  ", 2, 0), 4: (rows[4][1], 0, 0)}


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "one line of text\nother", 5, "a"), (1, "one line of text\nother", 5, "a"), (1, "one line of texts\nmore", 6, None)]
    df = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, th int, row string"))
    got = sorted((r.row.text, r.row.th, r.row.row) for r in df.collect())
    # the repeated rows are one document; of the same id, the text with the lesser hash comes first
    assert len(got) == 3 and got[1][0] == got[2][0] if got[0][0] != got[1][0] else got[0] == got[1]
    kept = {t for t, _, _ in got}
    assert kept in ({"one line of text\nother", "more"}, {"other", "one line of texts\nmore"})


def test_long_lines(spark, monkeypatch):
    """Lines of 3,000 to 50,000 characters, with one edit and with two, against brute force without an upper bound."""
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdé \U0001f600") for _ in range(n)) for n in (1999, 2000, 2001, 2002, 3000, 3999, 4001, 8000, 20_000, 50_000)]
    pool += ["ab" * 3000, "y" * 5000, "0123456789" * 700]
    texts = []
    for s in pool:
        texts += [s] + [edited(rng, s) for _ in range(5)] + [edited(rng, edited(rng, s)) for _ in range(2)]
        # edits at the ends, in the middle, at block borders and in two blocks
        for k in (0, 999, 1000, len(s) // 2 - 1, len(s) // 2, len(s) // 2 + 1000, len(s) - 1):
            texts += [s[:k] + "#" + s[k:], s[:k] + s[k + 1 :], s[:k] + "#" + s[k + 1 :]]
        texts += [s[:500] + "#" + s[500:-500] + "#" + s[-500:], s[::-1], s]
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[i * 5 : i * 5 + 5])) for i in range((len(texts) + 4) // 5)]
    df = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), longest=None)
    got = {r.row.doc_id: (r.row.text, r.n_dropped, r.n_near) for r in df.collect()}
    monkeypatch.setattr(lines, "NEAR_CHARS", (lines.NEAR_CHARS[0], 10**9))
    want = brute(rows)
    assert sum(x[2] for x in want.values()) > 200
    assert got == want


def test_long_lines_in_query_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from weightlake.llm import queries

    text = "x".join(str(i) for i in range(2000))
    docs = spark.createDataFrame([(1, text + "\nkept"), (2, text[:4000] + "#" + text[4001:] + "\nalso kept")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_near for r in queries.op9_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}[2] == "also kept"
