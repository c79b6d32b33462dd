"""Repeated rows, empty tables and columns with clashing names, for the operators that judge each row by itself and for packing."""

import pytest

from weightlake.llm import html, packing, pii, quality, urls
from weightlake.llm.queries import tokenizer_path

TEXTS = ["call bob on +44 20 7946 0958 or bob@home.org", "call bob on +44 20 7946 0958 or bob@home.org", "", None, "plain words"]
PAGES = ["<p>one<p>two", "<p>one<p>two", "", None, "<ul><li>x</ul>"]
URLS = ["http://A.com/en/7/x", "http://A.com/en/7/x", "", None, "no scheme"]
#: Names that operators use for columns of their own.
CLASH = "id string, t string, u string, row string, kept string, score string, words string, start string"


def frame(spark, key, column, values):
    rows = [(1 if i < 2 else i, v, *"abcdefgh") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{key} long, {column} string, {CLASH}")


CASES = {
    "pii": ("doc_id", "text", TEXTS, lambda df: pii.pii_spans(df, pii.train(60))),
    "html": ("page_id", "html", PAGES, html.extract_text),
    "counts": ("doc_id", "text", TEXTS, lambda df: quality.count_texts(df).withColumnRenamed("id", "doc_id")),
    "urls": ("page_id", "url", URLS, lambda df: urls.filter_urls(df, urls.UrlFilter(urls.PREFIX_RULES, urls.GLOB_RULES))),
}


@pytest.mark.parametrize("name", CASES)
def test_rows(spark, name):
    key, column, values, run = CASES[name]
    df = frame(spark, key, column, values)
    got = run(df).collect()
    assert sorted(r[key] for r in got) == [1, 1, 2, 3, 4]
    # repeated rows get equal results, and other columns change nothing
    first, second = (r for r in got if r[key] == 1)
    assert first == second
    plain = run(df.select(key, column)).collect()
    assert sorted(map(str, plain)) == sorted(map(str, got))
    assert run(df.where("false")).collect() == []


def test_conflicting_labels_take_the_least(spark):
    """A row that is labelled both good and bad counts as bad, so it moves no threshold."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(30)]
    counts = quality.count_texts(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    both = quality.fit_quality(counts, label([(i, 1) for i in range(30)] + [(i, 0) for i in range(30)]))
    assert both.threshold is None
    assert quality.fit_quality(counts, label([(i, 1) for i in range(30)])).threshold is not None


def test_packing(spark):
    df = frame(spark, "doc_id", "text", TEXTS)
    tokens = packing.WordTokenizer(tokenizer_path(), 2)
    got = packing.pack(df, tokens).collect()
    # both rows of the repeated id are packed, each once
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4]
    at = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert [a for _, a, _ in at] == [sum(n for *_, n in at[:k]) for k in range(5)]
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packing.pack(df.select("doc_id", "text"), tokens).collect())) == sorted(map(key, got))
