"""Queries over texts, lines, statutes, chunks and questions, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regtext.functions import questions as q
from regtext.functions import text as t
from regtext.operators import chunk, lines, parse
from regtext.plans.catalog import ORACLES, query
from regtext.sources.tables import stored, table

_WS = f"'{t.SPACE}'"
_LINES = "lines AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_LEGAL = _LINES + """, legal AS (SELECT doc_id, pos, CASE WHEN pos % 12 = 0 THEN 'BAB ' || (pos // 12 + 1) WHEN pos % 4 = 1 THEN 'Pasal ' || (pos // 4 + 1)
    WHEN (pos - 1) // 4 % 3 = 1 AND pos % 4 <> 2 THEN CASE pos % 4 WHEN 3 THEN 'a. ' ELSE 'b. ' END || line WHEN (pos - 1) // 4 % 3 = 2 AND (pos - 1) // 4 % 2 = 1 THEN CASE pos % 4 WHEN 2 THEN 'a. ' WHEN 3 THEN 'b. ' ELSE 'c. ' END || line
    WHEN (pos - 1) // 4 % 3 = 2 THEN line ELSE '(' || (pos % 4) || ') ' || line END AS line FROM lines)"""
_LEVEL = r"CASE WHEN regexp_matches(trim(line, §), '(?i)^BAB\s+([IVXLCDM]+|\d+)(\s+.+)?$') THEN 'bab' WHEN regexp_matches(trim(line, §), '(?i)^Pasal\s+\d+[A-Za-z]?$') THEN 'pasal' WHEN regexp_matches(trim(line, §), '^\(\d+\)\s+') THEN 'ayat' ELSE 'other' END".replace("§", _WS)
_PARA, _POINT = r"'^\s*\((\d+)\)\s+(.+)$'", r"'^\s*([a-z])\.\s+(.+)$'"
_ARTICLES = rf"""c0 AS (SELECT *, {_LEVEL} AS level, regexp_extract(line, '(\d+)', 1) AS num, regexp_extract(trim(line, {_WS}), '(?i)^BAB\s+(?:[IVXLCDM]+|\d+)(?:\s+(.+))?$', 1) AS inline_title FROM legal),
    c AS (SELECT *, CASE WHEN level = 'bab' THEN coalesce(nullif(inline_title, ''), CASE WHEN lead(level) OVER w = 'other' THEN trim(lead(line) OVER w, {_WS}) END, '') END AS title, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM c0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    al AS (SELECT *, last_value(CASE WHEN level = 'bab' THEN num END IGNORE NULLS) OVER w AS bab_number, last_value(title IGNORE NULLS) OVER w AS bab_title, last_value(CASE WHEN level = 'pasal' THEN num END IGNORE NULLS) OVER w AS pasal_number, sum(CASE WHEN level = 'pasal' THEN 1 ELSE 0 END) OVER w AS pasal_seq FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
_PARAGRAPHS = rf"""p0 AS (SELECT doc_id, pasal_seq, pasal_number, pos, line, nullif(regexp_extract(line, {_PARA}, 1), '') AS n FROM al WHERE pasal_seq > 0 AND level NOT IN ('bab', 'pasal') AND trim(line, {_WS}) <> ''),
    p1 AS (SELECT *, CASE WHEN n IS NULL THEN trim(line, {_WS}) ELSE regexp_extract(line, {_PARA}, 2) END AS body, count(n) OVER w AS seq, last_value(n IGNORE NULLS) OVER w AS num FROM p0 WINDOW w AS (PARTITION BY doc_id, pasal_seq ORDER BY pos)),
    p2 AS (SELECT *, max(seq) OVER (PARTITION BY doc_id, pasal_seq) AS most FROM p1),
    p3 AS (SELECT *, regexp_matches(body, {_POINT}) AS is_point, count(CASE WHEN regexp_matches(body, {_POINT}) THEN 1 END) OVER (PARTITION BY doc_id, pasal_seq, seq ORDER BY pos) AS at_point FROM p2 WHERE seq > 0 OR most = 0),
    points AS (SELECT doc_id, pasal_seq, seq, at_point, min_by(regexp_extract(body, {_POINT}, 1), pos) AS huruf, string_agg(CASE WHEN is_point THEN trim(regexp_extract(body, {_POINT}, 2), {_WS}) ELSE trim(body, {_WS}) END, ' ' ORDER BY pos) AS text FROM p3 WHERE at_point > 0 GROUP BY ALL),
    ayat AS (SELECT doc_id, pasal_seq, min(pasal_number) AS pasal_number, seq, max(num::INT) AS ayat_number, string_agg(body, chr(10) ORDER BY pos) AS text, max(at_point) AS n_points FROM p3 GROUP BY doc_id, pasal_seq, seq)"""
_AT = f"{_LEGAL}, {_ARTICLES}"
_CHUNKS = rf"""heads AS (SELECT doc_id, pasal_seq, min(pasal_number) AS n, trim(string_agg(line, chr(10) ORDER BY pos), {_WS}) AS whole,
        min_by(CASE WHEN regexp_matches(trim(line, {_WS}), {_PARA}) THEN regexp_extract(trim(line, {_WS}), {_PARA}, 2) ELSE trim(line, {_WS}) END, pos) FILTER (WHERE level <> 'pasal' AND trim(line, {_WS}) <> '' AND (regexp_matches(trim(line, {_WS}), {_PARA}) OR (length(trim(line, {_WS})) < 80 AND NOT regexp_matches(trim(line, {_WS}), {_POINT})))) AS useful
        FROM al WHERE pasal_seq > 0 AND level <> 'bab' GROUP BY doc_id, pasal_seq),
    titled AS (SELECT *, 'Pasal ' || n || coalesce(' - ' || rtrim(left(useful, 60)), '') AS title FROM heads),
    kids AS (SELECT a.*, title, coalesce(nullif(trim(regexp_replace(title, '(?i)^Pasal\s+\S+\s*-?\s*', ''), {_WS}), ''), title) AS about, 'child_pasal_' || n || coalesce('_ayat_' || ayat_number, '') AS base, 'Pasal ' || n || coalesce(' Ayat (' || ayat_number || ')', '') AS label FROM ayat a JOIN titled USING (doc_id, pasal_seq)),
    children AS (
        SELECT doc_id, CASE WHEN ayat_number IS NULL THEN base || '_tunggal' ELSE base END AS chunk_id, 'parent_pasal_' || pasal_number AS parent_id, CASE WHEN ayat_number IS NULL THEN label || ': ' || trim(text, {_WS}) ELSE label || ' mengenai ' || about END AS text, pasal_number::INT AS pasal, ayat_number AS ayat, NULL AS huruf FROM kids WHERE ayat_number IS NOT NULL OR n_points = 0
        UNION ALL
        SELECT k.doc_id, CASE WHEN ayat_number IS NULL THEN base || '_poin_' ELSE base || '_huruf_' END || huruf, 'parent_pasal_' || pasal_number, label || CASE WHEN ayat_number IS NULL THEN ' Poin ' ELSE ' huruf ' END || huruf || ': ' || p.text, pasal_number::INT, ayat_number, huruf FROM kids k JOIN points p USING (doc_id, pasal_seq, seq)),
    chunks AS (SELECT doc_id, 'parent' AS type, whole AS text, 2 AS level FROM titled WHERE whole <> '' UNION ALL SELECT doc_id, 'child', text, CASE WHEN ayat IS NULL THEN 2 ELSE 3 END FROM children),
    counted AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM chunks)"""


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.explode_lines(table(spark, sf, "documents", "doc_id", "text"))


def legal_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A statute-like corpus from plain documents: chapters and articles by position; by turns articles have numbered paragraphs, a paragraph with letters, letters only or plain lines."""
    pos = F.col("pos")
    place, article = pos % 4, F.floor((pos - 1) / 4)
    n = lambda c: c.cast("int").cast("string")
    led = lambda head: F.concat(head, F.lit(" "), F.col("line"))
    line = F.when(pos % 12 == 0, F.concat(F.lit("BAB "), n(F.floor(pos / 12) + 1))).when(place == 1, F.concat(F.lit("Pasal "), n(F.floor(pos / 4) + 1)))
    line = line.when((article % 3 == 1) & (place != 2), led(F.when(place == 3, "a.").otherwise("b.")))
    line = line.when((article % 3 == 2) & (article % 2 == 1), led(F.when(place == 2, "a.").when(place == 3, "b.").otherwise("c.")))
    line = line.when(article % 3 == 2, F.col("line")).otherwise(led(F.concat(F.lit("("), n(place), F.lit(")"))))
    return doc_lines(spark, sf).withColumn("line", line)


@query("txt_artifacts", "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'e', 'ﬁ'), 'a', '’'), ' o', ' “'), 'ﬁ', 'fi'), '’', ''''), ' ', ' '), '“', '\"'), '…', '...'), '–', '-'), '​', '') AS fixed FROM documents")
def txt_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.replace(F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("ﬁ")), F.lit("a"), F.lit("’")), F.lit(" o"), F.lit(" “"))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", t.fix_artifacts(t.strip_invisible(dirty)).alias("fixed"))


@query("txt_nfc", "SELECT conv_id, turn, nfc_normalize(replace(text, 'e', 'e' || chr(769))) AS nfc FROM conversations")
def txt_nfc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", t.nfc(F.replace("text", F.lit("e"), F.lit("é"))).alias("nfc"))


@query("txt_whitespace", r"SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, ' ', '  '), '.' || chr(10), '.' || chr(10) || chr(10) || chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS clean FROM documents")
def txt_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit(".\n"), F.lit(".\n\n\n"))
    return table(spark, sf, "documents").select("doc_id", t.normalise_space(dirty).alias("clean"))


@query("txt_page_numbers", r"SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(10), chr(10) || '- 3 -' || chr(10) || ' 12 ' || chr(10)) || chr(10) || 'Halaman 5', chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\s*(-\s*\d+\s*-|\d+|Halaman\s+\d+|Page\s+\d+)\s*$')), chr(10)) AS clean FROM documents")
def txt_page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.concat(F.replace("text", F.lit("\n"), F.lit("\n- 3 -\n 12 \n")), F.lit("\nHalaman 5"))
    return table(spark, sf, "documents").select("doc_id", t.drop_page_numbers(dirty).alias("clean"))


@query("txt_hyphenation")  # doubled words need a back reference; tests hold it against Python's re
def txt_hyphenation(spark: SparkSession, sf: str) -> DataFrame:
    text, n = t.join_hyphens(F.replace("text", F.lit("er "), F.lit("er-\n")))
    return table(spark, sf, "documents").select("doc_id", text.alias("joined"), n.cast("long").alias("n"))


@query("txt_spaced_chars")  # look-behind
def txt_spaced_chars(spark: SparkSession, sf: str) -> DataFrame:
    text, n = t.close_spaced(F.concat(F.lit("P a s a l 5 a b "), "text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("closed"), n.cast("long").alias("n"))


_NOISY = "replace(replace(text, 'l', '1'), ',', ',,')"
for _bad, _good in ((r"([A-Za-z])1([A-Za-z])", r"\1l\2"), (r"([A-Za-z])\|([A-Za-z])", r"\1I\2")):
    _NOISY = f"regexp_replace(regexp_replace({_NOISY}, '{_bad}', '{_good}', 'g'), '{_bad}', '{_good}', 'g')"  # twice, as matches overlap
for _bad, _good in ((r"\.{3,}", "..."), (",{2,}", ","), (";{2,}", ";"), (r"[\x{FFFD}\x{25A1}\x{25A0}\x{25CF}]", ""), (r"[^\x09\x0A\x0D\x20-\x7E\x{0080}-\x{024F}]", "")):
    _NOISY = f"regexp_replace({_NOISY}, '{_bad}', '{_good}', 'g')"


@query("txt_ocr_noise", f"SELECT doc_id, {_NOISY} AS clean FROM documents")
def txt_ocr_noise(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.replace(F.replace("text", F.lit("l"), F.lit("1")), F.lit(","), F.lit(",,"))
    return table(spark, sf, "documents").select("doc_id", t.drop_noise(dirty)[0].alias("clean"))


@query("txt_repair_stats")
def txt_repair_stats(spark: SparkSession, sf: str) -> DataFrame:
    return t.repaired(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "r.hyphens", "r.spaced", "r.noise", "r.joined", "r.total", "r.was_repaired")


@query("txt_clean_pages")
def txt_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    clean = t.cleaned_pages(table(spark, sf, "documents", "doc_id", "text"))
    return clean.select("doc_id", "clean").withColumns({"word_count": t.token_count(F.col("clean")), "char_count": F.length("clean").cast("long")}).drop("clean")


@query("txt_token_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens, length(text) AS chars FROM documents")
def txt_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.token_count(F.col("text")).alias("tokens"), F.length("text").cast("long").alias("chars"))


_TAGGED = "text || CASE doc_id % 5 WHEN 0 THEN ' Hak adalah izin' WHEN 1 THEN ' denda dan pidana' WHEN 2 THEN ' wajib izin, dilarang' WHEN 3 THEN ' mulai berlaku' ELSE '' END"


@query("txt_type_keywords", f"SELECT doc_id, CASE WHEN x LIKE '%adalah%' THEN 'definisi' WHEN x LIKE '%pidana%' OR x LIKE '%denda%' THEN 'sanksi' WHEN x LIKE '%dilarang%' OR x LIKE '%wajib%' THEN 'kewajiban_larangan' WHEN x LIKE '%mulai berlaku%' THEN 'peralihan' ELSE 'umum' END AS kind FROM (SELECT doc_id, lower({_TAGGED}) AS x FROM documents)")
def txt_type_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.article_type(F.expr(_TAGGED)).alias("kind"))


_KIND = "CASE WHEN x LIKE '%adalah%' OR x LIKE '%dimaksud dengan%' OR x LIKE '%yang dimaksud%' THEN 'definisi' WHEN x LIKE '%pidana%' OR x LIKE '%denda%' OR x LIKE '%penjara%' OR x LIKE '%kurungan%' THEN 'sanksi' WHEN x LIKE '%dilarang%' OR x LIKE '%tidak boleh%' OR x LIKE '%wajib%' THEN 'kewajiban_larangan' ELSE 'other' END"
_TAG = lambda kind, has, tag: f"CASE WHEN {f'kind = {kind!r} AND ' if kind else ''}({' OR '.join(f'contains(x, {h!r})' for h in has)}) THEN '{tag}' END"
_TAGS = ", ".join([*(_TAG("sanksi", [k], k) for k in t.TYPES[1][1]), *(_TAG("kewajiban_larangan", has, tag) for tag, has in t.DUTIES), "CASE WHEN kind = 'definisi' THEN 'definisi' END", *(_TAG(None, [k], k) for k in t.TAGS)])


@query("txt_keyword_tags", rf"""WITH x AS (SELECT doc_id, {_TAGGED} AS y, lower({_TAGGED}) AS x FROM documents), k AS (SELECT *, {_KIND} AS kind FROM x)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([{_TAGS}], CASE WHEN kind = 'definisi' THEN list_transform(regexp_extract_all(y, '{t.TERM}', 1)[1:3], lambda z: lower(trim(z, {_WS}))) ELSE [] END))), ',') AS tags FROM k""")
def txt_keyword_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(_TAGGED).alias("x")).select("doc_id", F.array_join(t.keywords(F.col("x"), t.article_type(F.col("x"))), ",").alias("tags"))


@query("txt_html_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, CASE WHEN length(html) > 150 THEN left(html, 150) || '...' ELSE html END AS preview FROM pages")
def txt_html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.escape_html(F.col("html")).alias("escaped"), t.cut(F.col("html"), 150).alias("preview"))


@query("line_explode", f"WITH {_LINES} SELECT doc_id, pos, line FROM lines")
def line_explode(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lines(spark, sf)


_TITLE = r"title <> '' AND NOT regexp_matches(title, '[.,;:]$') AND NOT regexp_matches(title, '^\(?\d+\)?\.?$') AND NOT regexp_matches(title, '^\(?[a-zA-Z]\)?\.?$') AND NOT (length(title) < 4 AND regexp_matches(title, '\d'))"


@query("line_header_footer", f"""WITH s AS (SELECT source AS doc_id, doc_id AS page, string_split(source || ' header' || chr(10) || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || source || ' footer' ELSE '' END, chr(10)) AS l FROM documents),
    l AS (SELECT doc_id, page, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM s),
    e AS (SELECT doc_id, page, pos, trim(line, {_WS}) AS title, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS f, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS b FROM l WHERE trim(line, {_WS}) <> ''),
    heads AS (SELECT doc_id, title FROM e WHERE f <= 2 AND {_TITLE} GROUP BY ALL HAVING count(*) >= 3),
    feet AS (SELECT doc_id, title FROM e WHERE f > 2 AND b <= 2 AND {_TITLE} GROUP BY ALL HAVING count(*) >= 3),
    g AS (SELECT doc_id, page, pos FROM e SEMI JOIN heads USING (doc_id, title) WHERE f <= 2 UNION SELECT doc_id, page, pos FROM e SEMI JOIN feet USING (doc_id, title) WHERE b <= 2)
    SELECT doc_id AS source, page, pos, line FROM l ANTI JOIN g USING (doc_id, page, pos)""")
def line_header_footer(spark: SparkSession, sf: str) -> DataFrame:
    foot = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n"), "source", F.lit(" footer"))).otherwise("")
    docs = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split(F.concat("source", F.lit(" header\n"), "text", foot), "\n", -1)).alias("pos", "line"))
    return lines.drop_running_titles(docs).select(F.col("doc_id").alias("source"), "page", "pos", "line")


@query("line_join_wrapped", rf"""WITH {_LINES}, p AS (SELECT *, rtrim(lag(line) OVER w, {_WS}) AS a, ltrim(line, {_WS}) AS b, lead(line) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    j AS (SELECT *, coalesce(a <> '' AND b <> '' AND NOT regexp_matches(b, '(?i)^\s*(?:BAB\s|Pasal\s|\(\d+\)|[a-z]\.\s|Menimbang|Mengingat|MEMUTUSKAN|PENJELASAN|Bagian\s|Paragraf\s|\d+\.\s)') AND (regexp_matches(a, '[A-Za-z0-9,;(\[-]$') OR (regexp_matches(a, '[.?:!]$') AND regexp_matches(b, '^[a-z0-9]'))), false) AS joined FROM p),
    i AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM j)
    SELECT doc_id, min(pos) AS pos, count(*) AS parts, CASE WHEN count(*) = 1 THEN any_value(line) ELSE string_agg(CASE WHEN first = pos THEN rtrim(line, {_WS}) WHEN last = pos THEN ltrim(line, {_WS}) ELSE trim(line, {_WS}) END, ' ' ORDER BY pos) END AS line FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, island) AS first, max(pos) OVER (PARTITION BY doc_id, island) AS last FROM i) GROUP BY doc_id, island""")
def line_join_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    return lines.join_wrapped_lines(doc_lines(spark, sf)).withColumn("parts", F.col("parts").cast("long"))


@query("line_frequent", f"WITH {_LINES} SELECT doc_id, pos, line FROM lines QUALIFY count(*) OVER (PARTITION BY doc_id, trim(line, {_WS})) < 3 OR trim(line, {_WS}) = ''")
def line_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return lines.drop_frequent_lines(doc_lines(spark, sf))


@query("line_join_pages")  # repairs need look-behind
def line_join_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select(F.expr("doc_id div 4").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return lines.join_pages(pages).select("doc_id", "text", "repairs")


@query("line_zones", rf"""WITH {_LEGAL}, z AS (SELECT doc_id, pos, CASE WHEN pos = 20 THEN 'PENJELASAN' WHEN pos = 6 THEN 'MEMUTUSKAN :' WHEN pos = 2 AND doc_id % 2 = 0 THEN ' menimbang bahwa' ELSE line END AS line FROM legal),
    m AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\s*MEMUTUSKAN\s*:') THEN pos END AS decree, CASE WHEN regexp_matches(line, '(?i)^\s*(BAB\s+I\b|Pasal\s+\d+[A-Za-z]?\s*$)') THEN pos END AS start, CASE WHEN regexp_matches(line, '(?i)^\s*PENJELASAN\b') THEN pos END AS note FROM z),
    n AS (SELECT *, min(coalesce(decree, start)) OVER (PARTITION BY doc_id ORDER BY pos) AS opened FROM m),
    o AS (SELECT *, min(CASE WHEN opened IS NOT NULL THEN note END) OVER (PARTITION BY doc_id) AS notes FROM n)
    SELECT doc_id, min(CASE WHEN regexp_matches(line, '(?i)^\s*Menimbang\b') THEN pos END) AS considering, coalesce(max(CASE WHEN notes IS NULL OR pos < notes THEN decree END), min(CASE WHEN notes IS NULL OR pos < notes THEN start END)) AS body, max(notes) AS notes, count(*) AS n FROM o GROUP BY doc_id""")
def line_zones(spark: SparkSession, sf: str) -> DataFrame:
    return lines.zones(_zoned_lines(spark, sf))


def _zoned_lines(spark: SparkSession, sf: str) -> DataFrame:
    return legal_lines(spark, sf).withColumn("line", F.when(F.col("pos") == 20, "PENJELASAN").when(F.col("pos") == 6, "MEMUTUSKAN :").when((F.col("pos") == 2) & (F.col("doc_id") % 2 == 0), " menimbang bahwa").otherwise(F.col("line")))


@query("line_zone_of_each", f"WITH {_LEGAL}, s AS ({ORACLES['line_zones']}) SELECT doc_id, pos, CASE WHEN pos >= s.notes THEN 'notes' WHEN pos >= s.body THEN 'body' ELSE 'preamble' END AS zone FROM legal JOIN s USING (doc_id)")
def line_zone_of_each(spark: SparkSession, sf: str) -> DataFrame:
    return lines.zone_of_lines(_zoned_lines(spark, sf)).select("doc_id", "pos", "zone")


@query("law_line_classes", f"WITH {_LEGAL} SELECT {_LEVEL} AS level, count(*) AS n FROM legal GROUP BY 1")
def law_line_classes(spark: SparkSession, sf: str) -> DataFrame:
    return legal_lines(spark, sf).select(parse.classify(F.col("line"))["level"].alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("law_bab_pasal_ffill", f"WITH {_AT} SELECT doc_id, pos, level, bab_number, pasal_number, pasal_seq FROM al")
def law_bab_pasal_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return parse.chapters_and_articles(legal_lines(spark, sf)).select("doc_id", "pos", "level", "bab_number", "pasal_number", "pasal_seq")


@query("law_chapters", f"WITH {_AT}, b AS (SELECT *, sum(CASE WHEN level = 'bab' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS bab_seq FROM al) SELECT doc_id, bab_seq, min_by(bab_number, pos) AS number, min_by(bab_title, pos) AS title, min(pos) AS pos, min(CASE WHEN level = 'pasal' THEN pasal_seq END) AS pasal_start, max(CASE WHEN level = 'pasal' THEN pasal_seq END) AS pasal_end, count(CASE WHEN level = 'pasal' THEN 1 END) AS pasal_count FROM b WHERE bab_seq > 0 GROUP BY doc_id, bab_seq")
def law_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return parse.chapters(legal_lines(spark, sf))


@query("law_offsets", f"WITH {_LEGAL} SELECT doc_id, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM legal")
def law_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return lines.offsets(legal_lines(spark, sf)).select("doc_id", "pos", "char_start")


@query("law_articles", f"WITH {_AT} SELECT doc_id, pasal_seq, min(pasal_number) AS pasal_number, min_by(bab_number, pos) AS bab_number, min_by(bab_title, pos) AS bab_title, string_agg(line, chr(10) ORDER BY pos) AS text, min(char_start) AS char_start, count(CASE WHEN level = 'ayat' THEN 1 END) AS n_ayat FROM al WHERE pasal_seq > 0 AND level <> 'bab' GROUP BY doc_id, pasal_seq")
def law_articles(spark: SparkSession, sf: str) -> DataFrame:
    return parse.articles(legal_lines(spark, sf))


@query("law_ayat", f"WITH {_AT}, {_PARAGRAPHS} SELECT doc_id, pasal_seq, pasal_number, seq, ayat_number, text, n_points FROM ayat")
def law_ayat(spark: SparkSession, sf: str) -> DataFrame:
    return parse.paragraphs(parse.articles(legal_lines(spark, sf))).withColumn("n_points", F.size("points").cast("long")).drop("points")


@query("law_poin", f"WITH {_AT}, {_PARAGRAPHS} SELECT doc_id, pasal_seq, ayat_number, huruf, points.text AS text FROM points JOIN ayat USING (doc_id, pasal_seq, seq)")
def law_poin(spark: SparkSession, sf: str) -> DataFrame:
    return parse.paragraphs(parse.articles(legal_lines(spark, sf))).select("doc_id", "pasal_seq", "ayat_number", F.explode("points").alias("p")).select("doc_id", "pasal_seq", "ayat_number", "p.huruf", "p.text")


_HEAD = "'UNDANG-UNDANG REPUBLIK INDONESIA NOMOR ' || doc_id || ' TAHUN ' || (1945 + doc_id % 80) || chr(10) || 'TENTANG hak cipta' || chr(10) || text"


@query("law_metadata", rf"""WITH h AS (SELECT doc_id, left({_HEAD}, 3000) AS x FROM documents), m AS (SELECT doc_id, regexp_extract(x, '(?i)UNDANG-UNDANG(?:\s+REPUBLIK INDONESIA)?\s+NOMOR\s+(\d+)\s+TAHUN\s+(\d{{4}})', 1) AS nomor, regexp_extract(x, '(?i)UNDANG-UNDANG(?:\s+REPUBLIK INDONESIA)?\s+NOMOR\s+(\d+)\s+TAHUN\s+(\d{{4}})', 2) AS tahun, trim(regexp_extract(x, '(?i)TENTANG\s+(.+?)(?:\n|$)', 1), {_WS}) AS about FROM h)
    SELECT doc_id, 'Undang-Undang' AS jenis, nomor, tahun, array_to_string(list_transform(string_split(about, ' '), lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') AS tentang, 'Undang-Undang No ' || nomor || ' Tahun ' || tahun AS label FROM m""")
def law_metadata(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").select("doc_id", parse.law_metadata(F.expr(_HEAD)).alias("m"))
    return m.select("doc_id", "m.*", parse.source_label(F.col("m"), F.lit("uu_x.pdf")).alias("label"))


@query("law_konsiderans", rf"""WITH {_LINES}, k AS (SELECT doc_id, pos, trim(CASE WHEN pos = 0 THEN 'Menimbang :' WHEN pos = 4 THEN 'Mengingat :' WHEN pos = 1 THEN 'a. ' || line WHEN pos = 3 THEN 'b. ' || line ELSE line END, {_WS}) AS line FROM lines),
    o AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^Menimbang\b') THEN 'a' WHEN regexp_matches(line, '(?i)^Mengingat\b') THEN 'b' END AS opens FROM k WHERE line <> ''),
    z AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS zone FROM o)
    SELECT *, length(mengingat) AS view_chars, length(full_text) AS chars FROM (SELECT doc_id, count(CASE WHEN zone = 'a' AND opens IS NULL AND regexp_matches(line, {_POINT}) THEN 1 END) AS points, coalesce(string_agg(CASE WHEN zone = 'b' AND opens IS NULL THEN line END, ' ' ORDER BY pos), '') AS mengingat, string_agg(line, chr(10) ORDER BY pos) AS full_text FROM z GROUP BY doc_id)""")
def law_konsiderans(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("pos")
    marked = doc_lines(spark, sf).withColumn("line", F.when(pos == 0, "Menimbang :").when(pos == 4, "Mengingat :").when(pos.isin(1, 3), F.concat(F.when(pos == 1, "a. ").otherwise("b. "), F.col("line"))).otherwise(F.col("line")))
    return parse.preamble(marked).select("doc_id", F.size("menimbang").cast("long").alias("points"), "mengingat", "full_text", F.length("mengingat").alias("view_chars"), F.length("full_text").alias("chars"))


_MENTION = r"'(?i)\bPasal\s+(\d+[A-Za-z]*)\b'"


@query("law_penjelasan_split", rf"""WITH x AS (SELECT doc_id, regexp_replace(text, '\. ', '. Pasal 7 ', 'g') AS x FROM documents), m AS (SELECT doc_id, regexp_extract_all(x, {_MENTION}, 1) AS numbers, regexp_split_to_array(x, {_MENTION})[2:] AS parts FROM x),
    e AS (SELECT doc_id, unnest(numbers) AS pasal, trim(unnest(parts), {_WS}) AS text, generate_subscripts(numbers, 1) AS i FROM m)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, pasal, text FROM e WHERE text <> ''""")
def law_penjelasan_split(spark: SparkSession, sf: str) -> DataFrame:
    text = F.replace("text", F.lit(". "), F.lit(". Pasal 7 "))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(parse.split_notes(text)).alias("n", "x")).select("doc_id", F.col("n").cast("long").alias("n"), "x.pasal", "x.text")


@query("law_whole_text", rf"""WITH x AS (SELECT doc_id, 'MEMUTUSKAN : BAB I ' || regexp_replace(text, '\. ', '. Pasal 9 (1) a) satu b) ', 'g') || ' PENJELASAN ATAS' AS x FROM documents), m AS (SELECT doc_id, regexp_extract_all(x, '(?i)\bPasal\s+(\d+[A-Za-z]*)', 1) AS numbers, regexp_split_to_array(x, '(?i)\bPasal\s+(\d+[A-Za-z]*)')[2:] AS parts FROM x)
    SELECT doc_id, unnest(numbers) AS pasal, 'I' AS bab, generate_subscripts(numbers, 1) - 1 AS seq, trim(string_split(unnest(parts), 'PENJELASAN')[1], {_WS}) AS text FROM m""")
def law_whole_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("MEMUTUSKAN : BAB I "), F.regexp_replace("text", r"\. ", ". Pasal 9 (1) a) satu b) "), F.lit(" PENJELASAN ATAS")).alias("text"))
    return parse.whole_text(docs).withColumn("seq", F.col("seq").cast("long"))


@query("law_whole_parts")  # points need look-ahead; tests hold it against Python's re
def law_whole_parts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Pasal 1 "), F.regexp_replace("text", r"\. ", ". (1) a) satu b) ")).alias("text"))
    return parse.numbered_parts(parse.whole_text(docs)).select("doc_id", "seq", "place", "ayat", "text", F.to_json("points").alias("points"))


# whole laws: an opening, one chapter, articles wherever a sentence ends, and notes
def _laws(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    top = F.concat(F.when(d % 3 > 0, F.concat(F.lit("Undang-Undang NOMOR "), d.cast("string"), F.lit(" TAHUN 2020\n"))).otherwise(""), F.when(d % 4 > 0, F.concat(F.lit("TENTANG  "), "source", F.lit("\nDENGAN RAHMAT\n"))).otherwise(""))
    start = F.concat(F.when(d % 7 > 0, "MEMUTUSKAN :\nBAB II\n Umum \n").otherwise(""), F.lit("Pasal 1\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(top, start, F.regexp_replace("text", r"\. ", ". Pasal 9 "), F.when(d % 2 == 0, " PENJELASAN ATAS hal ").otherwise("")).alias("text"))


_LAW = r"""l AS (SELECT doc_id, source, CASE WHEN doc_id % 3 > 0 THEN 'Undang-Undang NOMOR ' || doc_id || ' TAHUN 2020' || chr(10) ELSE '' END || CASE WHEN doc_id % 4 > 0 THEN 'TENTANG  ' || source || chr(10) || 'DENGAN RAHMAT' || chr(10) ELSE '' END AS top,
    CASE WHEN doc_id % 7 > 0 THEN 'MEMUTUSKAN :' || chr(10) || 'BAB II' || chr(10) || ' Umum ' || chr(10) ELSE '' END AS start, 'Pasal 1' || chr(10) || regexp_replace(text, '\. ', '. Pasal 9 ', 'g') AS rest, CASE WHEN doc_id % 2 = 0 THEN ' PENJELASAN ATAS hal ' ELSE '' END AS notes FROM documents)"""


@query("law_whole_heads", f"""WITH {_LAW} SELECT doc_id, 'UNDANG-UNDANG' AS jenis, CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR ELSE '1' END AS nomor, CASE WHEN doc_id % 3 > 0 THEN '2020' ELSE '2024' END AS tahun, CASE WHEN doc_id % 3 > 0 THEN 'UU_' || doc_id || '_2020' ELSE 'UU_1_2024' END AS uu_id,
    CASE WHEN doc_id % 4 > 0 THEN source ELSE '{parse.LAW_ABOUT_DEFAULT}' END AS judul, trim(top, {_WS}) AS pembukaan, trim(notes, {_WS}) AS penjelasan FROM l""")
def law_whole_heads(spark: SparkSession, sf: str) -> DataFrame:
    return parse.law_heads(_laws(spark, sf))


@query("law_whole_articles", rf"""WITH {_LAW}, s AS (SELECT doc_id, start, regexp_split_to_array(rest || notes, 'Pasal (1|9)') AS parts FROM l),
    e AS (SELECT doc_id, start, unnest(range(0, len(parts) - 1)) AS seq, unnest(parts[2:]) AS part, len(start) AS ahead FROM s),
    p AS (SELECT *, CASE WHEN seq = 0 THEN '1' ELSE '9' END AS pasal, 1 + ahead + coalesce(sum(len(part) + 7) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM e)
    SELECT doc_id, seq::INT AS seq, pasal, CASE WHEN doc_id % 7 > 0 THEN 'II' ELSE 'N/A' END AS bab, CASE WHEN doc_id % 7 > 0 THEN 'UMUM' ELSE 'N/A' END AS bab_title, start_at::INT AS start, trim(string_split(part, 'PENJELASAN')[1], {_WS}) AS text FROM p""")
def law_whole_articles(spark: SparkSession, sf: str) -> DataFrame:
    return parse.law_articles(_laws(spark, sf))


@query("law_asof_chapter", f"WITH {_AT} SELECT p.doc_id, p.pos AS start, p.num AS pasal_number, b.num AS bab_number FROM (SELECT * FROM c WHERE level = 'pasal') p ASOF LEFT JOIN (SELECT * FROM c WHERE level = 'bab') b ON p.doc_id = b.doc_id AND p.pos >= b.pos")
def law_asof_chapter(spark: SparkSession, sf: str) -> DataFrame:
    c = legal_lines(spark, sf).select("doc_id", F.col("pos").alias("start"), parse.classify(F.col("line")).alias("c")).select("doc_id", "start", F.col("c.level").alias("kind"), F.col("c.number").alias("number"))
    return parse.as_of_chapters(c.where("kind in ('bab', 'pasal')"))


def _titled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Articles, stored, as parents and children are both made of them, and their paragraphs."""
    a = stored(chunk.titled(parse.articles(legal_lines(spark, sf))), "articles")
    return a, parse.paragraphs(a, ["title"])


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    a, p = _titled(spark, sf)
    return chunk.article_parents(a).unionByName(chunk.article_children(a, p))


@query("chunk_parents", f"WITH {_AT} SELECT doc_id, 'parent_pasal_' || min(pasal_number) AS chunk_id, trim(string_agg(line, chr(10) ORDER BY pos), {_WS}) AS text, min(pasal_number)::INT AS pasal FROM al WHERE pasal_seq > 0 AND level <> 'bab' GROUP BY doc_id, pasal_seq")
def chunk_parents(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.article_parents(parse.articles(legal_lines(spark, sf))).select("doc_id", "chunk_id", "text", "pasal")


@query("chunk_children", f"WITH {_AT}, {_PARAGRAPHS}, {_CHUNKS} SELECT doc_id, chunk_id, parent_id, text, pasal, ayat, huruf FROM children")
def chunk_children(spark: SparkSession, sf: str) -> DataFrame:
    a = chunk.titled(parse.articles(legal_lines(spark, sf)))
    return chunk.article_children(a, parse.paragraphs(a, ["title"])).select("doc_id", "chunk_id", "parent_id", "text", "pasal", "ayat", "huruf")


@query("chunk_levels", f"WITH {_AT}, {_PARAGRAPHS}, {_CHUNKS} SELECT level, type, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY level, type")
def chunk_levels(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.typed(_chunks(spark, sf)).groupBy("level", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query("chunk_report", f"WITH {_AT}, {_PARAGRAPHS}, {_CHUNKS} SELECT 'Batang Tubuh' AS section, count(*) FILTER (WHERE type = 'parent') AS parents, count(*) FILTER (WHERE type = 'child') AS children, 0::BIGINT AS level_0, 0::BIGINT AS level_1, count(*) FILTER (WHERE level = 2) AS level_2, count(*) FILTER (WHERE level = 3) AS level_3, sum(tokens)::BIGINT AS tokens FROM counted")
def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.report(_chunks(spark, sf))


def _all_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Preambles and bodies from all lines of a document, notes from its whole text."""
    pos = F.col("pos")
    head = doc_lines(spark, sf).withColumn("line", F.when(pos == 0, "Menimbang :").when(pos == 1, F.concat(F.lit("a. "), "line")).when(pos == 3, "Mengingat :").otherwise(F.col("line")))
    a, p = _titled(spark, sf)
    marked = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.replace("text", F.lit(". "), F.lit(". Pasal 7 ")))
    notes = table(spark, sf, "documents").select("doc_id", "text", parse.split_notes(marked).alias("parts"))
    return chunk.united(parse.preamble(head), a, p, notes)


_SECTIONS = rf"""pre AS (SELECT doc_id, pos, trim(CASE pos WHEN 0 THEN 'Menimbang :' WHEN 1 THEN 'a. ' || line WHEN 3 THEN 'Mengingat :' ELSE line END, {_WS}) AS l FROM lines),
    op AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS full_text, CASE WHEN max(CASE WHEN pos = 1 THEN l END) SIMILAR TO 'a\.\s+\S(.|\n)*' THEN string_agg(CASE WHEN pos = 1 THEN trim(substr(l, 3), {_WS}) WHEN pos = 2 THEN l END, ' ' ORDER BY pos) END AS a, coalesce(string_agg(CASE WHEN pos > 3 THEN l END, ' ' ORDER BY pos), '') AS b FROM pre WHERE l <> '' GROUP BY 1),
    x AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN text ELSE regexp_replace(text, '\. ', '. Pasal 7 ', 'g') END AS x FROM documents), m AS (SELECT doc_id, text, regexp_extract_all(x, {_MENTION}, 1) AS numbers, regexp_split_to_array(x, {_MENTION})[2:] AS parts FROM x),
    e AS (SELECT doc_id, unnest(numbers) AS n, trim(unnest(parts), {_WS}) AS said FROM m), noted AS (SELECT * FROM e WHERE said <> ''),
    whole AS (SELECT doc_id, trim(text, {_WS}) AS said FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM noted) AND trim(text, {_WS}) <> '')"""
_NONE = "NULL::INT AS pasal, NULL::INT AS ayat"


@query("chunk_sections", rf"""WITH {_AT}, {_PARAGRAPHS}, {_CHUNKS}, {_SECTIONS}
    SELECT doc_id, 0 AS section_place, 'Konsiderans' AS section, 'parent' AS type, 'parent_konsiderans' AS chunk_id, NULL AS parent_id, 'Menimbang dan Mengingat' AS title, full_text AS text, {_NONE}, NULL AS huruf, NULL::INT AS pasal_rujukan FROM op WHERE a IS NOT NULL OR b <> ''
    UNION ALL SELECT doc_id, 0, 'Konsiderans', 'child', 'child_konsiderans_menimbang_a', 'parent_konsiderans', NULL, 'Menimbang huruf a: ' || a, NULL, NULL, 'a', NULL FROM op WHERE a IS NOT NULL
    UNION ALL SELECT doc_id, 0, 'Konsiderans', 'child', 'child_konsiderans_mengingat', 'parent_konsiderans', NULL, 'Mengingat: ' || b, NULL, NULL, NULL, NULL FROM op WHERE b <> ''
    UNION ALL SELECT doc_id, 1, 'Batang Tubuh', 'parent', 'parent_pasal_' || n, NULL, title, whole, n::INT, NULL, NULL, NULL FROM titled WHERE whole <> ''
    UNION ALL SELECT doc_id, 1, 'Batang Tubuh', 'child', chunk_id, parent_id, NULL, text, pasal, ayat, huruf, NULL FROM children
    UNION ALL SELECT doc_id, 2, 'Penjelasan', 'parent', 'parent_penjelasan_umum', NULL, 'Penjelasan Umum', said, NULL, NULL, NULL, NULL FROM whole
    UNION ALL SELECT doc_id, 2, 'Penjelasan', 'child', 'child_penjelasan_umum_isi', 'parent_penjelasan_umum', NULL, said, NULL, NULL, NULL, NULL FROM whole
    UNION ALL SELECT doc_id, 2, 'Penjelasan', 'parent', 'parent_penjelasan_pasal_' || n, NULL, 'Penjelasan Pasal ' || n, 'II. PASAL DEMI PASAL' || chr(10) || 'Pasal ' || n || chr(10) || said, NULL, NULL, NULL, n::INT FROM noted
    UNION ALL SELECT doc_id, 2, 'Penjelasan', 'child', 'child_penjelasan_pasal_' || n || '_isi', 'parent_penjelasan_pasal_' || n, NULL, 'Tafsir Resmi Pasal ' || n || ': ' || said, NULL, NULL, NULL, n::INT FROM noted""")
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Whole chunks of all three sections."""
    return _all_sections(spark, sf).select("doc_id", "section_place", *chunk.COLUMNS[1:])


@query("chunk_totals", f"WITH {_AT}, {_PARAGRAPHS}, {_CHUNKS} SELECT (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS succeeded, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS failed, count(*) FILTER (WHERE type = 'parent') AS parents, count(*) FILTER (WHERE type = 'child') AS children FROM counted WHERE doc_id % 7 <> 0")
def chunk_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("success").alias("status"))
    return chunk.batch_totals(files, _chunks(spark, sf))


_ASKED = "CASE turn % 4 WHEN 0 THEN 'apakah isi Pasal 5, 8, dan 10 ayat (2) huruf B? ' WHEN 1 THEN 'ps. ' || (conv_id % 9 + 1) || ' ayat 3 ' WHEN 2 THEN 'hm... mungkin salah pasal 3 ' ELSE '' END || text"


_NUMBERS = "list_transform(flatten(list_transform(regexp_extract_all({x}, '{p}', 1), lambda y: regexp_extract_all(y, '(\\d+)', 1))), lambda n: n::BIGINT)".replace("{p}", q.REFERENCES)
_X = f"(SELECT *, {_ASKED} AS x FROM conversations)"


@query("q_refs", rf"SELECT conv_id, turn, array_to_string({_NUMBERS.format(x='x')}, ',') AS articles, regexp_extract_all(x, '{q.PARAGRAPH}', 1)[1]::BIGINT AS ayat, nullif(lower(regexp_extract(x, '{q.POINT}', 1)), '') AS huruf FROM {_X}")
def q_refs(spark: SparkSession, sf: str) -> DataFrame:
    x = F.expr(_ASKED)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(q.article_numbers(x).cast("array<string>"), ",").alias("articles"), q.paragraph_number(x).alias("ayat"), q.point_letter(x).alias("huruf"))


_FILLED = f"(regexp_matches(x, '{q.FILLER}') OR len(regexp_extract_all(x, '\\.\\.\\.')) >= 3)"


@query("q_flags", f"SELECT conv_id, turn, regexp_matches(x, '{q.DOUBT}') AS doubt, {_FILLED} AS filler, len(list_distinct({_NUMBERS.format(x='x')})) > 1 AS ambiguous FROM {_X}")
def q_flags(spark: SparkSession, sf: str) -> DataFrame:
    x = F.expr(_ASKED)
    return table(spark, sf, "conversations").select("conv_id", "turn", q.has_doubt(x).alias("doubt"), q.has_filler(x).alias("filler"), q.is_ambiguous(x).alias("ambiguous"))


_CLEANED = lambda x: rf"regexp_replace(trim(regexp_replace(regexp_replace(trim({x}, {_WS}), '\?+$', ''), '{q.LEADING}', ''), {_WS}), '\s+', ' ', 'g')"
_CUT = lambda c: f"CASE WHEN length({c}) > 300 THEN regexp_replace(left({c}, 300), ' [^ ]*$', '') ELSE {c} END"


@query("q_clean", f"SELECT conv_id, turn, {_CUT('c')} AS query FROM (SELECT conv_id, turn, {_CLEANED('x')} AS c FROM {_X})")
def q_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", q.search_query(F.expr(_ASKED)).alias("query"))


_LEGAL_WORD = " OR ".join(f"contains(low, '{k}')" for k in q.LEGAL)
_QUESTION = rf"(ends_with(s, '?') OR regexp_matches(low, '^(?:{'|'.join(q.STARTERS)})') OR (len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) < 20 AND NOT {_FILLED} AND NOT ({_LEGAL_WORD})))"
_S = f"(SELECT *, lower(s) AS low FROM (SELECT *, trim(x, {_WS}) AS s FROM {_X}))"


@query("q_is_question", f"SELECT conv_id, turn, {_QUESTION} AS question FROM {_S}")
def q_is_question(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", q.is_question(F.expr(_ASKED)).alias("question"))


_FLUENT = "s"
for _bad, _good in q.CLEANING:
    _FLUENT = f"regexp_replace({_FLUENT}, '{_bad}', '{_good.replace('$', chr(92))}', 'g')"
_FLUENT = rf"regexp_replace(trim({_FLUENT}, {_WS}), '^[,.\s]+', '')"


@query("q_understand", f"""WITH a AS (SELECT *, {_QUESTION} AS passes, CASE WHEN {_FILLED} THEN {_FLUENT} ELSE s END AS repaired FROM {_S}), b AS (SELECT *, CASE WHEN passes THEN repaired ELSE x END AS src FROM a),
    c AS (SELECT *, list_distinct({_NUMBERS.format(x='src')}) AS numbers, regexp_matches(x, '{q.DOUBT}') OR len(list_distinct({_NUMBERS.format(x='x')})) > 1 AS unsure, {_CLEANED('repaired')} AS cleaned FROM b)
    SELECT conv_id, turn, repaired AS repaired_text, {_CUT('cleaned')} AS search_query, CASE WHEN s = '' OR unsure OR len(numbers) <> 1 THEN NULL ELSE numbers[1] END AS pasal, CASE WHEN s = '' OR unsure THEN NULL ELSE regexp_extract_all(src, '{q.PARAGRAPH}', 1)[1]::BIGINT END AS ayat, CASE WHEN s = '' THEN NULL ELSE nullif(lower(regexp_extract(src, '{q.POINT}', 1)), '') END AS huruf, s <> '' AND passes AS is_passthrough FROM c""")
def q_understand(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", q.understand(F.expr(_ASKED)).alias("u")).select("conv_id", "turn", "u.*")


@query("q_mend", f"WITH a AS (SELECT *, {_QUESTION} AS passes, CASE WHEN {_FILLED} THEN {_FLUENT} ELSE s END AS own FROM {_S}) SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND NOT passes THEN s || ' mended' ELSE own END AS mended FROM a")
def q_mend(spark: SparkSession, sf: str) -> DataFrame:
    """A model that adds a word for one turn, drops all references in another, and fails for the rest."""
    x, turn = F.expr(_ASKED), F.col("turn") % 3
    candidate = F.when(turn == 0, F.concat(t.strip(x), F.lit(" mended"))).when((turn == 1) & (F.size(q.article_numbers(x)) > 0), F.lit("no reference"))
    return table(spark, sf, "conversations").select("conv_id", "turn", q.mend(x, candidate).alias("mended"))


@query("q_mend_tries", f"""WITH a AS (SELECT *, {_QUESTION} AS passes, CASE WHEN {_FILLED} THEN {_FLUENT} ELSE s END AS own, len({_NUMBERS.format(x='s')}) > 0 OR regexp_matches(s, '(?i)ayat') AS refers FROM {_S})
    SELECT conv_id, turn, CASE WHEN passes OR turn % 3 = 2 THEN own WHEN turn % 3 = 0 AND NOT refers THEN 'no reference' ELSE s || ' mended' END AS mended, CASE WHEN passes OR s = '' THEN 0 WHEN turn % 3 = 2 THEN 3 WHEN turn % 3 = 0 THEN CASE WHEN refers THEN 2 ELSE 1 END ELSE 3 END AS attempts FROM a""")
def q_mend_tries(spark: SparkSession, sf: str) -> DataFrame:
    """A model that first drops all references, then fails or mends: in some turns with its second answer, in some with its third, in others never (a fourth isn't looked at)."""
    x, turn = F.expr(_ASKED), F.col("turn") % 3
    good, bad, none = F.concat(t.strip(x), F.lit(" mended")), F.lit("no reference"), F.lit(None).cast("string")
    answers = F.when(turn == 0, F.array(bad, good)).when(turn == 1, F.array(none, none, good)).otherwise(F.array(none, none, none, good))
    return table(spark, sf, "conversations").select("conv_id", "turn", x.alias("x"), answers.alias("answers")).transform(q.mended, "x", "answers").select("conv_id", "turn", F.col("m.text").alias("mended"), "m.attempts")


@query("q_missing_refs", f"SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct({_NUMBERS.format(x='x')}), lambda n: n <> 8)), ',') AS missing FROM {_X}")
def q_missing_refs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(q.missing_references(F.expr(_ASKED), F.lit("Pasal 8")).cast("array<string>"), ",").alias("missing"))


@query("q_single_mention", rf"SELECT conv_id, turn, CASE WHEN len(m) = 1 THEN m[1] END AS pasal, left(x, 1000) AS text FROM (SELECT *, regexp_extract_all(x, '(?i)pasal\s+(\d+)', 1) AS m FROM {_X})")
def q_single_mention(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", q.single_mention(F.expr(_ASKED)).alias("pasal"), q.capped(F.expr(_ASKED)).alias("text"))
