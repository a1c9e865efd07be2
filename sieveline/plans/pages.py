"""Pages: title, summary, content, dates and fields of sections as queries; SQL beside each.

The pages of the tables have a title, an article and paragraphs, but no metadata and no sections; the queries put some in
by the page's number, the same for every page, before they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import pages as op
from sieveline.plans.registry import query
from sieveline.session import table


def _by(k: Column, *parts: str) -> Column:
    """The part for a page's number, with ``#`` as the number itself."""
    of = lambda p: F.replace(F.lit(p), F.lit("#"), F.col("page_id").cast("string"))
    out = F.lit("")
    for i, p in enumerate(parts):
        out = F.when(k == i, of(p)).otherwise(out)
    return out


_HEADS = (
    '<meta property="og:title" content="Familien # | Stadt"><meta name="description" content="Hilfe für Familien und Kinder  in jeder Lage, Seite # .">',
    '<meta property="article:published_time" content=" 2024-01-05 "><link rel="Canonical" href="/kanon/#?utm_source=x">',
    '<meta http-equiv="Last-Modified" content="2023-05-06"><meta name="Date" content="2022-02-#">',
)
_SECTIONS = (
    "<h2>Voraussetzungen</h2><p>Alter #</p><ul><li>Wohnsitz<li>Antrag #</ul><h3>Höhe der Leistung</h3><p># Euro</p><p>monatlich</p><h2>So stellen Sie den Antrag</h2><p>Hinweise</p><ol><li>Formular #</li><li>Abgeben<ul><li>online</li></ul></li></ol>",
    "<h3>Nötige Unterlagen</h3><div><ul><li>Ausweis #</li><li> </li></ul></div><p>Es gibt # Euro.</p>",
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    html = F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), _by(k % 4, *_HEADS))
    html = F.when(k % 4 == 2, F.regexp_replace(html, "<h1>[^<]*</h1>", "<h1>Startseite</h1>")).otherwise(html)
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(html, F.lit("</article>"), F.concat(_by(k % 3, *_SECTIONS), F.lit("</article>"))).alias("html"))


_UNESCAPED = lambda c: f"replace(replace({c}, '&quot;', '\"'), '&amp;', '&')"
_POOR = lambda c: f"(length({c}) < 40 OR regexp_matches(lower({c}), 'cookie|datenschutz|javascript|newsletter|anmelden|registrieren|suche|navigation|zum inhalt|barrierefreiheit|impressum|einwilligung|webverhalten|tracking|analyse-tool|matomo|einwilligen ablehnen'))"
_PARTS = f"""WITH cut AS (SELECT page_id, url, html, string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>') AS ps FROM pages),
placed AS (SELECT page_id, unnest(ps[2:]) AS p, unnest(range(1, len(ps))) AS i FROM cut),
texts AS (SELECT page_id, i, trim(regexp_replace({_UNESCAPED("regexp_replace(p, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS t FROM placed)
"""
_TITLED = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '([a-zäöüß])([A-ZÄÖÜ])', '\\1 \\2', 'g'), '([:;,.!?])(\\S)', '\\1 \\2', 'g'), '([:;,.!?])(\\S)', '\\1 \\2', 'g'), '\\s+', ' ', 'g')"
_CUT = lambda c: f"(SELECT CASE WHEN len(ms) > 0 THEN trim(string_split({c}, ms[1])[1]) ELSE {c} END FROM (SELECT list_filter([' | ', ' – ', ' — ', ' - '], lambda m: contains({c}, m) AND length(trim(string_split({c}, m)[1])) >= 12 AND trim(substring({c}, instr({c}, m) + length(m))) <> '') AS ms))"
_POOR_TITLE = lambda c: f"({c} = '' OR lower({c}) IN ('navigation', 'hauptnavigation', 'haupt-navigation', 'startseite', 'home', 'homepage', 'menu', 'hinweis zum datenschutz', 'datenschutzhinweis', 'cookie-hinweis') OR regexp_matches(lower({c}), 'jetzt|hier klicken|mehr erfahren|loslegen|starten|anmelden|datenschutz|cookie|impressum'))"


@query("t15_page_texts", _PARTS + f""", sections(k, t) AS (VALUES (1, 'Es gibt # Euro.')),
blocks AS (SELECT page_id, i, trim(regexp_replace(t, '\\s+([,.;:!?])', '\\1', 'g'), ' -|') AS t FROM texts),
long AS (SELECT page_id, t, min(i) AS i FROM blocks WHERE length(t) >= 50 GROUP BY page_id, t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM long),
summed AS (SELECT c.page_id, CASE WHEN c.page_id % 4 = 0 THEN 'Hilfe für Familien und Kinder in jeder Lage, Seite ' || c.page_id || '.' ELSE coalesce((SELECT arg_min(t, n) FROM ranked r WHERE r.page_id = c.page_id AND n <= 4 AND NOT {_POOR("t")}), '') END AS summary FROM cut c),
kept AS (SELECT r.page_id, t, row_number() OVER (PARTITION BY r.page_id ORDER BY n) AS m FROM ranked r JOIN summed s ON s.page_id = r.page_id WHERE n <= 8 AND t <> summary),
bodies AS (SELECT page_id, string_agg(t, ' ' ORDER BY m) AS content FROM kept WHERE m <= 6 GROUP BY page_id),
heads AS (SELECT page_id, url, {_TITLED(_UNESCAPED("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS h, {_TITLED(_UNESCAPED("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS t FROM cut),
told AS (SELECT page_id, url, CASE WHEN page_id % 4 = 2 THEN 'Startseite' ELSE {_CUT("h")} END AS h, {_CUT("t")} AS t FROM heads)
SELECT d.page_id, CASE WHEN NOT {_POOR_TITLE("d.h")} THEN d.h WHEN d.page_id % 4 = 0 THEN 'Familien ' || d.page_id || CASE WHEN length('Familien ' || d.page_id) >= 12 THEN '' ELSE ' | Stadt' END WHEN NOT {_POOR_TITLE("d.t")} THEN d.t ELSE '- ' || d.url END AS title, s.summary,
       coalesce(b.content, s.summary) AS content, CASE WHEN d.page_id % 4 = 1 THEN regexp_extract(d.url, '^https?://[^/]+') || '/kanon/' || d.page_id ELSE '' END AS canonical_url,
       CASE d.page_id % 4 WHEN 1 THEN '2024-01-05' WHEN 2 THEN '2022-02-' || d.page_id ELSE '' END AS published_at, CASE d.page_id % 4 WHEN 2 THEN '2023-05-06' ELSE '' END AS modified_at
FROM told d JOIN summed s ON s.page_id = d.page_id LEFT JOIN bodies b ON b.page_id = d.page_id""")
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.described(_pages(spark, sf_dir)).select("page_id", "title", "summary", "content", "canonical_url", "published_at", "modified_at")


@query("t16_page_fields", _PARTS + """, extra AS (SELECT page_id, 100000 AS i, 'Es gibt ' || page_id || ' Euro.' AS t FROM pages WHERE page_id % 3 = 1),
every AS (SELECT * FROM texts UNION ALL SELECT * FROM extra),
loose AS (SELECT page_id, arg_min(t, i) FILTER (regexp_matches(lower(t), 'regelbedarf|regelsatz|höhe|betrag|euro')) AS amount, arg_min(t, i) FILTER (regexp_matches(lower(t), 'voraussetzung|anspruch|berechtigt|bedingung')) AS eligibility FROM every GROUP BY page_id)
SELECT p.page_id, CASE p.page_id % 3 WHEN 0 THEN p.page_id || ' Euro monatlich' ELSE coalesce(l.amount, '') END AS amount, CASE p.page_id % 3 WHEN 0 THEN 'Alter ' || p.page_id || ' Wohnsitz Antrag ' || p.page_id ELSE coalesce(l.eligibility, '') END AS eligibility,
       CASE p.page_id % 3 WHEN 0 THEN ['Formular ' || p.page_id, 'Abgeben online', 'online'] ELSE []::VARCHAR[] END AS steps, CASE p.page_id % 3 WHEN 1 THEN ['Ausweis ' || p.page_id] ELSE []::VARCHAR[] END AS documents
FROM pages p LEFT JOIN loose l ON l.page_id = p.page_id""")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fields(op.described(_pages(spark, sf_dir))).select("page_id", "amount", "eligibility", "steps", "documents")
