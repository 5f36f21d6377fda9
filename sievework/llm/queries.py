"""Queries opN_<name>: each operator over its whole table with production parameters, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import chat_tools, cotraining, decontaminate, exact_dedup, jaccard_join, license_scan, mixing, substring_dedup, suffix_tree, url_filter

Query = Callable[[SparkSession, str], DataFrame]

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LISTED = ("http://ads-track.example.org", "http://cheap-pills.example.com", "http://free-bets.example.com", "http://spam-farm.example.org")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Equal shares of the sources; set shares of languages and registers.
MIX: mixing.Targets = {"source": None, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"prose": 0.9, "tabular": 0.04, "": 0.06}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed, RULES).drop("on_list")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents"), MIX).withColumn("rate", F.round("rate", 6))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents"), PHRASES)
    return license_scan.digest(scanned, sorted(PHRASES.values())).withColumn("score", F.round("score", 9))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op10_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.formatted(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_url_filter, op2_exact_dedup, op3_suffix_tree, op4_mixing, op5_decontaminate, op6_substring_dedup, op7_quality, op8_license_scan, op9_jaccard_join, op10_chat_tools)
}

UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _rule(h: str, p: str) -> str:
    return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_TEMPLATE_WORDS = ", ".join(f"({n}, '{t.label}', {i}, '{w}')" for n, t in enumerate(license_scan.TEMPLATES) for i, w in enumerate(t.words))
_TEMPLATE_KEYS = ", ".join(f"({n}, {at + j}, '{w}')" for n, t in enumerate(license_scan.TEMPLATES) for at, phrase in t.keys for j, w in enumerate(phrase))
_BASE = ", ".join(f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for phrase, label in PHRASES.items())

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": rf"""
        WITH parsed AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {UP}, {LOW}) AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages)
        SELECT page_id, host, path,
               CASE {' '.join(f"WHEN {_rule(h, p)} THEN '{h + p}'" for h, p, _ in _LONGEST)} END AS rule,
               CASE {' '.join(f"WHEN {_rule(h, p)} THEN '{v}'" for h, p, v in _LONGEST)}
                    WHEN regexp_replace(host, '^((www|m)\.)+', '') IN ({', '.join(repr(u.split('://')[1]) for u in LISTED)}) THEN 'block'
                    ELSE 'allow' END AS verdict
        FROM parsed""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, {WORDS.format('text')} AS words FROM documents),
        spots AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM docs),
        wins AS (SELECT doc_id, i, words[i + 1] AS word,
                        CASE WHEN i + 50 <= len(words) THEN md5(array_to_string(words[i + 1 : i + 50], ' ')) END AS k FROM spots),
        firsts AS (SELECT k, min(doc_id) AS first_id FROM wins WHERE k IS NOT NULL GROUP BY k),
        flagged AS (SELECT w.doc_id, i, word, coalesce(first_id < w.doc_id, false) AS hit FROM wins w LEFT JOIN firsts USING (k)),
        cut AS (SELECT *, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM flagged),
        kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM cut GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op8_license_scan": rf"""
        WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {UP}, {LOW}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
        spots AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs),
        tw(t, label, pos, word) AS (VALUES {_TEMPLATE_WORDS}),
        tk(t, pos, word) AS (VALUES {_TEMPLATE_KEYS}),
        base(label, phrase) AS (VALUES {_BASE}),
        hit AS (SELECT * FROM spots WHERE w IN (SELECT word FROM tw)),
        n AS (SELECT count(*) AS n FROM docs),
        idf AS (SELECT word, ln((SELECT n + 1 FROM n)::DOUBLE / (count(DISTINCT doc_id) + 1)) + 1 AS idf
                FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN hit ON w = word GROUP BY word),
        weighted AS (SELECT t, label, pos, word, idf, sum(idf) OVER (PARTITION BY t) AS total FROM tw JOIN idf USING (word)),
        scored AS (SELECT doc_id, t, label, i - pos AS start, sum(idf) / any_value(total) AS score
                   FROM hit JOIN weighted ON w = word GROUP BY doc_id, t, label, i - pos HAVING sum(idf) / any_value(total) >= 0.8),
        need AS (SELECT t, count(*) AS keys FROM tk GROUP BY t),
        firm AS (SELECT s.doc_id, s.t, s.label, s.start, s.score
                 FROM scored s JOIN need USING (t) JOIN tk ON tk.t = s.t JOIN hit h ON h.doc_id = s.doc_id AND h.i = s.start + tk.pos AND h.w = tk.word
                 GROUP BY s.doc_id, s.t, s.label, s.start, s.score, keys HAVING count(*) = keys),
        places AS (SELECT a.doc_id, b.label, a.i FROM spots a JOIN base b ON a.w = b.phrase[1] JOIN docs d USING (doc_id)
                   WHERE d.words[a.i + 1 : a.i + len(b.phrase)] = b.phrase),
        pb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM places GROUP BY doc_id),
        best AS (SELECT doc_id, max(score) AS score FROM firm GROUP BY doc_id),
        lab AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM firm UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               round(CASE WHEN n_base > 0 THEN 1.0 ELSE least(coalesce(score, 0.0), 1.0) END, 9)::DOUBLE AS score
        FROM docs LEFT JOIN pb USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN lab USING (doc_id)""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(f'translate(text, {UP}, {LOW})')} AS words FROM documents),
        sh AS MATERIALIZED (
          SELECT DISTINCT doc_id, md5(CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i + 1 : i + 5], ' ') END) AS s
          FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM docs WHERE len(words) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        edges AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
        reach(x, y) AS (SELECT a, a FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id) AS component_id
        FROM docs LEFT JOIN sizes USING (doc_id)""",
}
