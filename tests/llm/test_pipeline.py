import test_decontam
import test_jaccard
import test_lines

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            assert docs.count() > 0
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            assert 0.7 * len(before) < len(after) < len(before) and all(before[d] == t for d, t in after.items())
        elif k == 1:
            rows = list(before.items())
            # equal lines by brute force; lines one edit apart are compared in the operator's own test
            first = {}
            for d, t in sorted(rows):
                for n, x in enumerate(t.split("\n")):
                    first.setdefault(x.strip(test_lines.BLANK), (d, n))
            for d, t in after.items():
                want = [x for n, x in enumerate(before[d].split("\n")) if not x.strip(test_lines.BLANK) or first[x.strip(test_lines.BLANK)] == (d, n)]
                assert set(t.split("\n")) <= set(want) and len(want) - len(t.split("\n")) <= 2
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif k == 2:
            least = {}
            for d, n, c in test_jaccard.brute(list(before.items())):
                least.setdefault((c, n == 0 and d), []).append(d)
            assert set(after) == {min(g) for g in least.values()}
        elif k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            vocabulary = {w for _, t in items for w in test_decontam.words(t)}
            # brute force on the documents that went and on some that stayed
            gone = sorted(set(before) - set(after))
            some = gone + [d for d in sorted(after) if len(set(test_decontam.words(before[d])) & vocabulary) > 0][:20]
            found = {d for d, _ in test_decontam.brute([(d, before[d][:4000] if d in after else before[d]) for d in some], items)}
            assert gone and found == set(gone)


def test_run(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


def test_stages_with_odd_rows(spark):
    """Nulls, empty texts, ties, repeated rows, an extra column and no rows at all, for every filtering stage."""
    long = " ".join(f"word{i % 70} thing{i}" for i in range(80))
    rows = [(1, long, "b"), (1, long, "a"), (2, long, "c"), (3, None, "d"), (4, "", "e"), (4, "", "e"), (4, "", "e"), (None, long, "f"), (None, None, "g"), (7, "short text", "h"), (8, "x " * 3000, "i")]
    schema = "doc_id long, text string, ref string"
    docs = spark.createDataFrame(rows, schema)

    def left(stage, df=docs):
        got = stage(spark, df, SF)
        assert got.columns == df.columns
        return sorted(map(tuple, got.collect()), key=str)

    # texts below 50 words or full of repeats fail the rules; equal rows get equal verdicts
    assert {r[:2] for r in left(corpus_pipeline.quality_rules)} == {(1, long), (2, long), (None, long)}
    # a null id comes first, so it keeps the line; texts without a word are left as they are, rows that repeat id and text are alike
    assert left(corpus_pipeline.line_dedup) == sorted([(None, long, "f"), *rows[3:7], *rows[8:]], key=str)
    # the null id is least of its group; all documents without words stay
    assert left(corpus_pipeline.near_duplicates) == sorted([(None, long, "f"), *rows[3:7], *rows[8:]], key=str)
    # of rows that repeat id and text the least stays, whatever else repeats
    assert left(corpus_pipeline.near_duplicates, docs.where("doc_id = 1 OR doc_id = 4")) == sorted([(1, long, "a"), *rows[4:7]], key=str)
    assert left(corpus_pipeline.decontamination) == sorted(rows, key=str)
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, SF).collect()} == {r[0] for r in rows}
