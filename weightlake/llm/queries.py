"""The registered queries: each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, jaccard, katz, lines, packing, pii, quality, substrings, urls
from .session import cut, table

#: The file of the tokenizer that packing uses; None for the public one that is installed.
TOKENIZER: str | None = None


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"), pii.train())
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(kinds, s.kind).alias("place"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line(order).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.with_component_ids(jaccard.jaccard_components(table(spark, sf_dir, "documents")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(quality.count_texts(table(spark, sf_dir, "documents")))
    model = quality.fit_quality(counts, table(spark, sf_dir, "labels"))
    return quality.judge_quality(counts, model).select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.UrlFilter(urls.PREFIX_RULES, urls.GLOB_RULES))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"), longest=None)
    return found.select("row.doc_id", "n_lines", "n_dropped", "n_near", F.sha2("row.text", 256).alias("kept_sha256"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.WordTokenizer(tokenizer_path(), 2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_decontam": op2_decontam,
    "op3_pii": op3_pii,
    "op4_jaccard": op4_jaccard,
    "op5_html_text": op5_html_text,
    "op6_katz": op6_katz,
    "op7_quality": op7_quality,
    "op8_urls": op8_urls,
    "op9_lines": op9_lines,
    "op10_pack": op10_pack,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_OP1 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(len(w) - 34)) AS i)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM win JOIN twice USING (h), (SELECT unnest(range(35)) AS k)),
word AS (SELECT r, p, w[p + 1] AS x FROM d, LATERAL (SELECT unnest(range(len(w))) AS p)),
marked AS (SELECT word.r, word.p, x, gone.p IS NOT NULL AS g FROM word LEFT JOIN gone ON gone.r = word.r AND gone.p = word.p),
runs AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY r ORDER BY p), false) AS before FROM marked),
kept AS (SELECT r, count(*) FILTER (WHERE g) AS n, count(*) FILTER (WHERE g AND NOT before) AS s, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT g) AS t FROM runs GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(s, 0)::BIGINT AS n_spans FROM d LEFT JOIN kept USING (r)"""

# any 13 words that differ in two have four equal ones in a row
_OP2 = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(len(w) - 3)) AS i)),
bg AS (SELECT item_id, j, array_to_string(v[j + 1 : j + 4], ' ') AS g FROM b, LATERAL (SELECT unnest(range(len(v) - 3)) AS j) WHERE len(v) >= 7),
diag AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM dg JOIN bg USING (g)),
eq AS (SELECT doc_id, item_id, shift, j, len(v) AS n, CASE WHEN j + shift >= 0 AND w[j + shift + 1] = v[j + 1] THEN 1 ELSE 0 END AS e FROM diag JOIN d USING (doc_id) JOIN b USING (item_id), LATERAL (SELECT unnest(range(len(v))) AS j)),
acc AS (SELECT doc_id, item_id, shift, n, j, least(n, 13) AS width, sum(e) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n_equal FROM eq),
fit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, j + shift, j) AS k FROM acc WHERE j + width <= n AND n_equal >= width - CASE WHEN width < 13 THEN 0 ELSE 2 END)
SELECT doc_id, item_id, (j + shift)::BIGINT AS start_word, j::BIGINT AS item_start, width::BIGINT AS n_words, n_equal::BIGINT AS n_equal FROM fit WHERE k = 1"""

_OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM d, LATERAL (SELECT unnest(range(greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""


def _op8() -> str:
    rules = sorted(urls.PREFIX_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules))

    def matches(kind: str) -> str:
        one = {"*": ".*", "~": "[^/]*", "?": "."}
        regex = ["^(?s:" + "".join(one.get(c, f"\\{c}" if c in ".-/" else c) for c in g) + ")$" for v, g in urls.GLOB_RULES if v == kind]
        return " OR ".join(f"regexp_matches(canonical, '{x}')" for x in regex)

    return f"""WITH u AS (SELECT page_id, coalesce({_LOWER.format(r"regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, CASE WHEN host = '' AND path = '' THEN '' ELSE '.' || host || path END AS canonical FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN ({matches("block")}) AND NOT ({matches("allow")}) THEN 'block' ELSE 'allow' END AS verdict FROM c"""


#: The other queries' models, tokenizers and edit distances are beyond SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_substrings": _OP1, "op2_decontam": _OP2, "op4_jaccard": _OP4, "op8_urls": _op8()}
