"""Texts of documents: cleaning, sentences, chunks, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as fx
from sieveline.operators import crawl, pages
from sieveline.operators import texts as op
from sieveline.plans.registry import query
from sieveline.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("t01_mojibake", "SELECT doc_id, md5(" + "".join("replace(" for _ in fx.MOJIBAKE) + "text" + "".join(f", '{a}', '{b}')" for a, b in fx.MOJIBAKE) + ") AS repaired_md5 FROM documents")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(fx.repair(F.col("text"))).alias("repaired_md5"))


@query("t03_repeated_lines_removed", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(line)) AS n FROM l) SELECT doc_id, md5(coalesce(string_agg(CASE WHEN n < 4 OR length(trim(line)) <= 4 THEN line END, chr(10) ORDER BY pos), '')) AS cleaned_md5 FROM c GROUP BY doc_id")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.without_repeated_lines(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id", F.md5("text").alias("cleaned_md5"))


@query("t05_dehyphenation", "SELECT doc_id, md5(regexp_replace(text, '-\\n([a-zäöüß])', '\\1', 'g')) AS joined_md5 FROM documents")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(fx.dehyphenate(F.col("text"))).alias("joined_md5"))


@query("t06_whitespace", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS collapsed_md5 FROM documents")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(fx.collapse(F.col("text"))).alias("collapsed_md5"))


@query("t13_slug_titles", "SELECT page_id, regexp_replace(regexp_replace(CASE WHEN len(p) = 0 THEN NULL ELSE p[-1] END, '\\.[a-z]+$', ''), '[-_]+', ' ', 'g') AS title FROM (SELECT page_id, [x FOR x IN string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/') IF x <> ''] AS p FROM pages)")
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.slug_title(F.col("url")).alias("title"))


_LINKS = ("/leistungen/a", "/Beratung/1", "/rechner", "/ministerium/x", "/telefon", "/über-uns", "/geld-kontakt", "", "/jobsuche?q=115")


@query("t18_link_domains", """WITH l AS (SELECT page_id, lower(regexp_replace(url, '[?].*$', '') || ['/leistungen/a', '/Beratung/1', '/rechner', '/ministerium/x', '/telefon', '/über-uns', '/geld-kontakt', '', '/jobsuche?q=115'][CAST(page_id % 9 AS INT) + 1]) AS u, page_id FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, 'leistung|benefit|kindergeld|buergergeld|zuschlag|geld') THEN 'benefits' WHEN regexp_matches(u, 'hilfe|aid|unterstützung|support|beratung') THEN 'aid'
WHEN regexp_matches(u, 'tool|rechner|calculator|service|antrag|formular|lotse|jobsuche') THEN 'tools' WHEN regexp_matches(u, 'ministerium|organisation|about|über-uns|institution') THEN 'organizations' WHEN regexp_matches(u, 'kontakt|contact|telefon|helpline|115|erreichen') THEN 'contacts'
ELSE CASE WHEN page_id % 2 = 0 THEN 'tools' ELSE 'benefits' END END AS domain FROM l""")
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain that a link's words say, one of nine ends after each page's URL; else the one asked for if it is one."""
    k = F.col("page_id")
    link = F.concat(F.regexp_replace("url", "[?].*$", ""), F.element_at(F.array(*map(F.lit, _LINKS)), (k % 9).cast("int") + 1))
    return table(spark, sf_dir, "pages").select("page_id", crawl.link_domain(link, F.when(k % 2 == 0, "tools").otherwise("other")).alias("domain"))


@query("t19_sentences", "SELECT doc_id, len([s FOR s IN regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(s) <> '']) AS sentences FROM documents")
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(fx.sentences(F.col("text"))).alias("sentences"))


@query("t22_grounding", "WITH s AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w, lag(list_distinct(string_split(lower(text), ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, round(len(list_intersect(w, before)) / len(w), 6) AS grounded FROM s WHERE before IS NOT NULL")
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    words = F.array_distinct(F.split(F.lower("text"), " "))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return s.where("before is not null").select("conv_id", "turn", F.round(F.size(F.array_intersect("w", "before")) / F.size("w"), 6).alias("grounded"))


@query("t24_simple_language_audit", "WITH s AS (SELECT doc_id, [len(string_split(trim(x), ' ')) FOR x IN regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS n, text FROM documents) SELECT doc_id, len([x FOR x IN n IF x > 24]) AS long_sentences, coalesce(list_avg(n), 0) > 16 AS long_average, regexp_matches(text, '[;()]') AS marks FROM s")
def t24(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.transform(fx.sentences(F.col("text")), lambda s: F.size(F.split(F.trim(s), " ")))
    d = _docs(spark, sf_dir).select("doc_id", "text", n.alias("n"))
    mean = F.when(F.size("n") > 0, F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n")).otherwise(0.0)
    return d.select("doc_id", F.size(F.filter("n", lambda x: x > 24)).alias("long_sentences"), (mean > 16).alias("long_average"), F.col("text").rlike("[;()]").alias("marks"))


@query("t26_numeric_citations", "SELECT conv_id, turn, len(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS citations FROM conversations")
def t26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("citations"))


@query("t28_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def t28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.ceil(F.length("text") / 4.0).cast("long").alias("tokens"))


@query("t29_truncations", "SELECT doc_id, md5(CASE WHEN n <= 400 THEN text ELSE left(text, 400) END) AS at_end, md5(CASE WHEN n <= 400 THEN text ELSE right(text, 400) END) AS at_start, md5(CASE WHEN n <= 400 THEN text ELSE left(text, 200) || '...' || right(text, 200) END) AS in_middle FROM (SELECT doc_id, text, length(text) AS n FROM documents)")
def t29(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda where: F.md5(op.truncated(F.col("text"), 400, where))
    return _docs(spark, sf_dir).select("doc_id", cut("end").alias("at_end"), cut("start").alias("at_start"), cut("middle").alias("in_middle"))


@query("t31_entities", "SELECT doc_id, len(regexp_extract_all(text, '\\d{4}-\\d{2}-\\d{2}')) AS iso_dates, len(regexp_extract_all(text, '\\d{1,2}\\.\\d{1,2}\\.\\d{4}')) AS german_dates, len(regexp_extract_all(text, '\\d+(?:[.,]\\d{2})? ?(?:€|EUR|Euro)')) AS amounts FROM documents")
def t31(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda p, name: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(name)
    return _docs(spark, sf_dir).select("doc_id", found(r"\d{4}-\d{2}-\d{2}", "iso_dates"), found(r"\d{1,2}\.\d{1,2}\.\d{4}", "german_dates"), found(r"\d+(?:[.,]\d{2})? ?(?:€|EUR|Euro)", "amounts"))


@query("t35_evidence_compaction", "SELECT conv_id, string_agg('- ' || left(text, 320), chr(10) ORDER BY turn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5 GROUP BY conv_id")
def t35(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.operators.ranking import first_of

    c = first_of(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 5)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("- "), F.substring("text", 1, 320)).alias("line"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


@query("t10_chunks")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chunks(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


@query("s14_html_text", """WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS art FROM pages),
l AS (SELECT page_id, unnest(string_split(regexp_replace(art, '<h1>|<p>', chr(1), 'g'), chr(1))[2:]) AS part, unnest(range(1, len(string_split(regexp_replace(art, '<h1>|<p>', chr(1), 'g'), chr(1))))) AS i FROM a),
t AS (SELECT page_id, i, list_filter(list_transform(string_split(regexp_replace(part, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(replace(replace(x, '&quot;', '"'), '&amp;', '&'), chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS pieces FROM l),
x AS (SELECT page_id, i, CASE WHEN i = 1 THEN chr(10) || '# ' || array_to_string(pieces, ' ') || chr(10) ELSE array_to_string(pieces, ' ') END AS line FROM t WHERE len(pieces) > 0)
SELECT p.page_id, coalesce(trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(10)), '') AS text FROM pages p LEFT JOIN x ON x.page_id = p.page_id GROUP BY p.page_id""")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.readable_text(F.col("html")).alias("text"))


@query("t17_links", """WITH l AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]+')) AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages)
SELECT DISTINCT page_id, origin || regexp_replace(replace(link, '&amp;', '&'), '/+$', '') AS target FROM l""")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query("t07_normalized")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.normalized(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
