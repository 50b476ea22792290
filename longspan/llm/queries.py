"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from longspan.llm.binary_search import search_embeddings
from longspan.llm.bpe_codec import encode_digests
from longspan.llm.common import read
from longspan.llm.html_text import extract_text
from longspan.llm.language_id import identify_languages
from longspan.llm.lexical_search import lexical_search
from longspan.llm.license_scan import scan_licenses
from longspan.llm.mixing import mix
from longspan.llm.ngram_jaccard import jaccard_components
from longspan.llm.packing import pack
from longspan.llm.quality_rules import quality_rules
from longspan.llm.source_divergence import source_divergence
from longspan.llm.substring_dedup import remove_repeated_spans
from longspan.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_find_package(spark: SparkSession) -> None:
    """Python workers started by this session import this package too."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, known)))


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_substring_dedup",
    r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)
), starts AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id
), covered AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM starts) GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, s.w, c.js, coalesce(list_sort(c.js), []::BIGINT[]) AS gone FROM split s LEFT JOIN covered c USING (doc_id)
), pieces AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM split
), words_left AS (
  SELECT p.doc_id, string_agg(p.w[p.j], ' ' ORDER BY p.j) AS t
  FROM pieces p ANTI JOIN (SELECT doc_id, unnest(js) AS j FROM covered) g ON p.doc_id = g.doc_id AND p.j = g.j
  GROUP BY p.doc_id
)
SELECT k.doc_id, len(k.w)::BIGINT AS n_words, len(k.gone)::BIGINT AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256
FROM kept k LEFT JOIN words_left l USING (doc_id)
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


@query(
    "op6_ngram_jaccard_join",
    r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), reached AS (
  SELECT doc_id AS node, doc_id AS other FROM sizes
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other
), roots AS (
  SELECT node, min(other) AS root FROM reached GROUP BY node
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN roots r ON r.node = d.doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


@query(
    "op4_exact_top_k_search",
    """
WITH codes AS (
  SELECT vec_id AS id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))::HUGEINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code)) AS distance
  FROM codes q JOIN codes c ON q.id % 100 = 0 AND c.id <> q.id
)
SELECT query_id, CAST(n AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS n FROM pairs) WHERE n <= 10
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(read(spark, sf_dir, "embeddings"))


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


@query("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


@query(
    "op11_source_divergence",
    r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER () AS d FROM docs
), tallies AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT d) AS docs FROM (SELECT lang, source, d, unnest(w) AS term FROM numbered) GROUP BY ALL
), terms AS (
  SELECT lang, term, sum(n)::HUGEINT AS total FROM tallies GROUP BY ALL HAVING sum(docs) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM terms GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), held AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0)::HUGEINT AS n, t.total
  FROM groups g JOIN terms t USING (lang) LEFT JOIN tallies c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), sizes AS (
  SELECT lang, source, sum(n)::HUGEINT AS group_n FROM held GROUP BY ALL
), shares AS (
  SELECT h.lang, h.source, h.term, h.n, 1 + (1000000000 * (h.n + 5)) // (s.group_n + 5 * l.v) AS p, 1 + (1000000000 * (h.total + 5)) // (l.lang_n + 5 * l.v) AS q
  FROM held h JOIN sizes s USING (lang, source) JOIN langs l USING (lang)
), gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 50
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


@query("op12_bpe_codec")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"))


@query(
    "op13_lexical_search",
    r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), corpus AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words
), lengths AS (
  SELECT d, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM words, corpus WHERE len(w) > 0
), items AS (
  SELECT item_id, row_number() OVER () AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), asked AS (
  SELECT item_id, item, term, count(*) AS times FROM (SELECT item_id, item, unnest(w) AS term FROM items) GROUP BY ALL
), postings AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term, n_docs
), scores AS (
  SELECT a.item_id, a.item, l.doc_id, l.d, sum(a.times * x.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * l.m)))::BIGINT AS score
  FROM asked a JOIN weights x USING (term) JOIN postings p USING (term) JOIN lengths l USING (d) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))
