"""Queries for retrieval, context, evaluation, histories, quotas, knowledge bases, streams and relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regtext.functions.text import SPACE
from regtext.operators import context as ctx
from regtext.operators import evaluate as ev
from regtext.operators import retrieve as rt
from regtext.plans.catalog import query
from regtext.sources import knowledge
from regtext.sources.tables import scratch_dir, table
from regtext.streaming import windows


# retrieval: labels stand for articles, vec_id % 3 for paragraphs, vec_id % 2 for sections
def points(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    child = table(spark, sf, "embeddings").select(F.lit("kb").alias("kb"), F.lit("child").alias("role"), v.alias("chunk_id"), F.col("label").cast("string").alias("parent_id"), (v % 2).cast("string").alias("section"), F.col("label").alias("pasal"), (v % 3).cast("int").alias("ayat"), F.lit(None).cast("int").alias("pasal_rujukan"), F.concat(F.lit("content "), v.cast("string")).alias("content"), "embedding")
    return child


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query: by turns with all filters, with an absent article, with none, with an absent paragraph, and with the article."""
    v = F.col("vec_id")
    turn = F.floor(v / 100) % 5
    one = lambda when, c: F.when(turn.isin(*when), c)
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(v.alias("query_id"), "embedding", one([0, 3], (v % 2).cast("string")).alias("section"), F.when(turn == 1, F.lit(99)).when(turn.isin(0, 3, 4), F.col("label")).cast("int").alias("pasal"), F.when(turn == 3, 9).otherwise(one([0], v % 3)).cast("int").alias("ayat"))


_PAIRS = """q AS (SELECT vec_id AS query_id, embedding AS qe, CASE WHEN turn IN (0, 3) THEN (vec_id % 2)::VARCHAR END AS q_section, CASE WHEN turn = 1 THEN 99 WHEN turn IN (0, 3, 4) THEN label END AS q_pasal, CASE WHEN turn = 0 THEN vec_id % 3 WHEN turn = 3 THEN 9 END AS q_ayat FROM (SELECT *, vec_id // 100 % 5 AS turn FROM embeddings WHERE vec_id % 100 = 0)),
    p AS (SELECT vec_id AS chunk_id, (vec_id % 2)::VARCHAR AS section, label AS pasal, vec_id % 3 AS ayat, embedding FROM embeddings),
    s AS (SELECT *, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * qe[i]::DOUBLE)) AS raw FROM p, q),
    pairs AS (SELECT * EXCLUDE (embedding, qe) FROM s WHERE raw >= 0.15)"""
_TIERS = _PAIRS + """, a AS (SELECT *, (q_section IS NULL OR section = q_section) AND (q_pasal IS NULL OR pasal = q_pasal) AND (q_ayat IS NULL OR ayat = q_ayat) AS in_a, q_pasal IS NOT NULL AND q_ayat IS NOT NULL AND (q_section IS NULL OR section = q_section) AND pasal = q_pasal AS in_b FROM pairs),
    m AS (SELECT *, max(CASE WHEN in_a THEN raw END) OVER w AS max_a, max(CASE WHEN in_b THEN raw END) OVER w AS max_b FROM a WINDOW w AS (PARTITION BY query_id)),
    t AS (SELECT *, CASE WHEN (q_pasal IS NOT NULL OR q_ayat IS NOT NULL) AND coalesce(max_a, max_b, -1) < 0.3 THEN 'C' WHEN max_a IS NOT NULL THEN 'A' ELSE 'B' END AS tier FROM m),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM t WHERE (tier = 'A' AND in_a) OR (tier = 'B' AND in_b) OR tier = 'C'),
    tiered AS (SELECT * FROM u WHERE rank <= 15)"""
_CUT = _TIERS + """, x AS (SELECT * EXCLUDE (rank), coalesce(pasal = q_pasal AND (q_ayat IS NULL OR ayat = q_ayat), false) AS exact, max(raw) OVER (PARTITION BY query_id) AS top FROM tiered),
    y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM x WHERE raw >= top * 0.7 OR exact),
    cut AS (SELECT * FROM y WHERE rank <= 5)"""
_BOOST = _CUT + """, b AS (SELECT *, floor(raw * 10000 + 0.5) / 10000 AS base, coalesce(pasal = q_pasal, false) AS exact_pasal, coalesce(pasal = q_pasal AND ayat = q_ayat, false) AS exact_ayat FROM cut),
    b1 AS (SELECT *, CASE WHEN exact_pasal THEN least(floor((base + 0.5) * 10000 + 0.5) / 10000, 1.0) ELSE base END AS one FROM b),
    b2 AS (SELECT * EXCLUDE (rank), rank AS prior, CASE WHEN exact_ayat THEN least(floor((one + 0.3) * 10000 + 0.5) / 10000, 1.0) ELSE one END AS score FROM b1),
    boosted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM b2)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rt.best_pairs(asked(spark, sf), points(spark, sf), 15, unit=True)


def _boosted(spark: SparkSession, sf: str) -> DataFrame:
    return rt.boosted(rt.cut_relative(rt.tiered(_pairs(spark, sf), 15), 5))


@query("vec_topk_filtered", f"WITH {_PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM pairs WHERE (q_section IS NULL OR section = q_section) AND (q_pasal IS NULL OR pasal = q_pasal)) SELECT query_id, chunk_id, floor(raw * 10000 + 0.5) / 10000 AS score, rank FROM f WHERE rank <= 15")
def vec_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    hits = rt.best_pairs(asked(spark, sf), points(spark, sf), 15, unit=True, tiers=[("section", "pasal")]).where("(q_section is null or section = q_section) and (q_pasal is null or pasal = q_pasal)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "chunk_id"))
    return hits.withColumn("rank", rank).where("rank <= 15").select("query_id", "chunk_id", rt.rounded(F.col("raw")).alias("score"), "rank")


@query("vec_tiered_fallback", f"WITH {_TIERS} SELECT query_id, chunk_id, tier, rank, tier = 'C' AS pasal_not_found FROM tiered")
def vec_tiered_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return rt.tiered(_pairs(spark, sf), 15).select("query_id", "chunk_id", "tier", "rank", "pasal_not_found")


@query("vec_relative_threshold", f"WITH {_CUT} SELECT query_id, chunk_id, exact, rank FROM cut")
def vec_relative_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rt.cut_relative(rt.tiered(_pairs(spark, sf), 15), 5).select("query_id", "chunk_id", "exact", "rank")


@query("vec_hybrid_boost", f"WITH {_BOOST} SELECT query_id, chunk_id, score, exact_pasal, exact_ayat, rank FROM boosted")
def vec_hybrid_boost(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted(spark, sf).select("query_id", "chunk_id", "score", "exact_pasal", "exact_ayat", "rank")


@query("vec_parent_join", f"WITH {_BOOST}, par AS (SELECT label::VARCHAR AS parent_id, 'parent ' || min(vec_id) AS parent_content FROM embeddings GROUP BY label) SELECT query_id, chunk_id, score, parent_content FROM boosted LEFT JOIN par ON par.parent_id = boosted.pasal::VARCHAR")
def vec_parent_join(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("v")).select(F.lit("kb").alias("kb"), F.lit("parent").alias("role"), F.col("label").cast("string").alias("chunk_id"), F.concat(F.lit("parent "), F.col("v").cast("string")).alias("content"), F.col("label").alias("pasal"), F.lit(None).cast("int").alias("pasal_rujukan"))
    return rt.with_parents(_boosted(spark, sf), parents).select("query_id", "chunk_id", "score", "parent_content")


@query("vec_rerank_sigmoid", f"WITH {_BOOST}, l AS (SELECT *, floor(1 / (1 + exp(-((chunk_id % 7) - 3.0))) * 10000 + 0.5) / 10000 AS rerank_score FROM boosted) SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rerank_score DESC, rank) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rerank_score DESC, l.rank) <= 3")
def vec_rerank_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return rt.reranked(_boosted(spark, sf), F.col("chunk_id") % 7 - F.lit(3.0), 3).select("query_id", "chunk_id", "rerank_score", "rank")


_SHAPED = """par AS (SELECT label::VARCHAR AS parent_id, 'parent ' || min(vec_id) AS parent_content FROM embeddings GROUP BY label)
    SELECT query_id, rank, score, exact_pasal, exact_ayat, tier = 'C' AS pasal_not_found, chunk_id, 'content ' || chunk_id AS content, parent_content FROM boosted LEFT JOIN par ON par.parent_id = boosted.pasal::VARCHAR"""


@query("vec_search", f"WITH {_BOOST}, {_SHAPED}")
def vec_search(spark: SparkSession, sf: str) -> DataFrame:
    """The public search with its shaped results, flattened."""
    parents = table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("v")).select(F.lit("kb").alias("kb"), F.lit("parent").alias("role"), F.col("v").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("section"), F.col("label").alias("pasal"), F.lit(None).cast("int").alias("ayat"), F.lit(None).cast("int").alias("pasal_rujukan"), F.concat(F.lit("parent "), F.col("v").cast("string")).alias("content"))
    own = points(spark, sf).drop("embedding")
    both = own.withColumn("chunk_id", F.col("chunk_id").cast("string")).unionByName(parents.withColumn("chunk_id", F.col("pasal").cast("string")))
    vectors = points(spark, sf).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.lit("child").alias("role"), "embedding")
    found = rt.search(asked(spark, sf), both.join(vectors, ["chunk_id", "role"], "left"), limit=5, unit=True)
    flat = rt.shaped(found)
    return flat.select("query_id", "rank", "score", "exact_pasal", "exact_ayat", "pasal_not_found", F.col("child.chunk_id").cast("long").alias("chunk_id"), "child.content", F.nullif(F.col("parent.content"), F.lit("")).alias("parent_content"))


_SECTION = "CASE page_id % 4 WHEN 0 THEN ' Semua' WHEN 1 THEN 'Batang Tubuh' WHEN 2 THEN '' END"


@query("vec_filters", f"SELECT page_id AS query_id, CASE WHEN lower(trim({_SECTION})) NOT IN ('semua', 'all', '') THEN {_SECTION} END AS section, try_cast(nullif(regexp_extract(html, '(\\d+)', 1), '') AS INT) AS pasal, try_cast(nullif(regexp_extract(url, '(\\d+)', 1), '') AS INT) AS ayat FROM pages")
def vec_filters(spark: SparkSession, sf: str) -> DataFrame:
    asked_for = table(spark, sf, "pages").select(F.col("page_id").alias("query_id"), F.expr(_SECTION).alias("section_type"), F.col("html").alias("pasal_type"), F.col("url").alias("ayat_type"))
    return rt.with_filters(asked_for)


# contexts: documents as hits of questions, twenty of each, ranked by id
def hits(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    none = F.lit(None).cast("string")
    number = lambda on, c: F.when(on, c).cast("int")
    rows = table(spark, sf, "documents").withColumn("query_id", F.expr("doc_id div 20")).withColumn("rank", rank)
    return rows.select("query_id", "rank", (d % 11 == 0).alias("exact"), ((d % 10) / 10.0).alias("score"), F.when(d % 3 == 0, none).otherwise((d % 4).cast("string")).alias("parent_id"), number(d % 2 == 0, d % 40).alias("pasal"), number(d % 4 == 1, d % 39).alias("pasal_rujukan"), number(d % 8 == 3, d % 38).alias("parent_pasal"), number(d % 8 == 7, d % 37).alias("parent_rujukan"), F.when(d % 5 == 0, F.concat(F.lit("parent of "), "source", F.lit(" that is long enough"))).alias("parent_content"), F.col("text").alias("content"), (d % 3).cast("int").alias("ayat"))


_HITS = f"""h AS (SELECT doc_id // 20 AS query_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS rank, doc_id % 11 = 0 AS exact, (doc_id % 10) / 10.0 AS score, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 4)::VARCHAR END AS parent_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 40 WHEN doc_id % 4 = 1 THEN doc_id % 39 WHEN doc_id % 8 = 3 THEN doc_id % 38 ELSE doc_id % 37 END AS article, (doc_id % 3)::INT AS ayat, CASE WHEN doc_id % 5 = 0 THEN 'parent of ' || source || ' that is long enough' END AS parent_content, text AS content FROM documents),
    c0 AS (SELECT *, CASE WHEN parent_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) END AS turn FROM h WHERE exact OR NOT (article BETWEEN 16 AND 25 OR article BETWEEN 27 AND 30)),
    c1 AS (SELECT *, CASE WHEN length(trim(parent_content, '{SPACE}')) > 30 THEN trim(parent_content, '{SPACE}') WHEN length(trim(content, '{SPACE}')) > 30 THEN trim(content, '{SPACE}') END AS text FROM c0 WHERE turn = 1),
    c AS (SELECT * FROM c1 WHERE text IS NOT NULL)"""


@query("ctx_filter_dedup", f"WITH {_HITS} SELECT query_id, rank, article, text FROM c")
def ctx_filter_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return ctx.candidates(hits(spark, sf)).select("query_id", "rank", "article", "text")


@query("ctx_narrow_gate", f"WITH {_HITS}, n AS (SELECT *, bool_or(exact) OVER w AS any_exact, max(score) OVER w AS known, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS best FROM c WINDOW w AS (PARTITION BY query_id)) SELECT query_id, rank FROM n WHERE (any_exact OR best = 1) AND (any_exact OR known >= 0.3)")
def ctx_narrow_gate(spark: SparkSession, sf: str) -> DataFrame:
    return ctx.narrowed(ctx.candidates(hits(spark, sf))).select("query_id", "rank")


_PACKED = _HITS + ", p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c), u AS (SELECT *, sum(length(text) + CASE WHEN place > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM p), packed AS (SELECT * FROM u WHERE used <= 1200 OR place = 1)"


@query("ctx_pack", f"WITH {_PACKED} SELECT query_id, rank, place, used FROM packed")
def ctx_pack(spark: SparkSession, sf: str) -> DataFrame:
    return ctx.packed(ctx.candidates(hits(spark, sf))).select("query_id", "rank", "place", "used")


@query("ctx_combined", f"WITH {_PACKED} SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'Pasal 99 tidak ditemukan; berikut ketentuan yang paling relevan.' || chr(10) ELSE '' END || string_agg(text, chr(10) || chr(10) ORDER BY place) AS context FROM packed GROUP BY query_id")
def ctx_combined(spark: SparkSession, sf: str) -> DataFrame:
    note = F.when(F.col("query_id") % 2 == 0, ctx.not_found_note(F.lit(99))).otherwise("")
    return ctx.combined(ctx.packed(ctx.candidates(hits(spark, sf))), note)


@query("ctx_fallback", f"WITH {_HITS}, a AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN query_id % 40 END AS asked FROM h GROUP BY ALL), k AS (SELECT query_id, count(*) AS n FROM c GROUP BY ALL) SELECT query_id, CASE WHEN asked IS NOT NULL THEN 'Pasal ' || asked || ' tidak ditemukan.' WHEN coalesce(n, 0) > 0 THEN 'Konteks kurang meyakinkan.' ELSE 'Tidak ada konteks.' END AS message FROM a LEFT JOIN k USING (query_id)")
def ctx_fallback(spark: SparkSession, sf: str) -> DataFrame:
    h = hits(spark, sf)
    asked_for = h.select("query_id").distinct().withColumn("asked", F.when(F.col("query_id") % 3 == 0, F.col("query_id") % 40))
    n = ctx.candidates(h).groupBy("query_id").count()
    return asked_for.join(n, "query_id", "left").select("query_id", ctx.fallback(F.col("asked"), F.coalesce("count", F.lit(0)) > 0).alias("message"))


_NOTE = """CASE WHEN asked_pasal IS NULL OR pasal IS NULL THEN '-' WHEN pasal <> asked_pasal THEN 'Anda menyebut Pasal ' || asked_pasal || ', namun berdasarkan pencarian di knowledge base, pasal yang paling relevan dengan pertanyaan Anda adalah Pasal ' || pasal || '.'
    WHEN asked_ayat IS NOT NULL AND ayat IS NOT NULL AND ayat <> asked_ayat THEN 'Anda menyebut ayat (' || asked_ayat || '), namun ayat yang relevan pada Pasal ' || pasal || ' adalah ayat (' || ayat || ').' ELSE '-' END"""


@query("ctx_reconcile", f"WITH {_HITS}, p AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS position, article AS pasal, ayat FROM c), n AS (SELECT query_id, rank - 1 AS position, 'law ' || rank AS name, CASE WHEN query_id % 3 > 0 THEN query_id * 20 % 40 END AS asked_pasal, CASE WHEN query_id % 2 = 0 THEN 1 END AS asked_ayat FROM h), j AS (SELECT n.*, pasal, ayat FROM n LEFT JOIN p USING (query_id, position)) SELECT query_id, position, name, pasal, ayat, {_NOTE} AS note FROM j")
def ctx_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query_id")
    names = hits(spark, sf).select(q, (F.col("rank") - 1).alias("position"), F.concat(F.lit("law "), F.col("rank").cast("string")).alias("name"), F.when(q % 3 > 0, q * 20 % 40).alias("asked_pasal"), F.when(q % 2 == 0, 1).alias("asked_ayat"))
    return ctx.reconciled(names, ctx.candidates(hits(spark, sf)))


@query("ctx_thin", f"SELECT doc_id, length(trim(text, '{SPACE}')) < 300 OR len(regexp_extract_all(lower(text), 'pasal')) < 2 AS thin FROM documents")
def ctx_thin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ctx.is_thin(F.col("text")).alias("thin"))


# evaluation
_LAW = """'{"dasar_hukum":[{"nama_peraturan":"UU","pasal":"Pasal ' || doc_id || '","ayat":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"(1)"' END || ',"catatan_validasi":"' || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE 'lain' END || '"}],"ringkasan":[{"poin":"p"},{"poin":"' || source || '"}],' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '"qa":[{"pertanyaan":"a","jawaban":"' || lang || '"},{"pertanyaan":"b","jawaban":""}],' END || '"ringkasan_pembuka":"","analisa_risiko":[{"skenario":"s","penjelasan":"t"}]}'"""
_REF = "'UU Pasal ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' (1)' END"


def materials(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source", F.from_json(F.expr(_LAW), ev.MATERIAL).alias("material"))


@query("eval_segments", f"SELECT doc_id, 'Dasar Hukum: ' || {_REF} || chr(10) || 'Ringkasan Pembuka: -' || chr(10) || 'Ringkasan: p | ' || source || chr(10) || 'Konteks Tambahan: -' AS faithfulness, CASE WHEN doc_id % 5 = 0 THEN '-' ELSE lang END AS qa, 'Skenario: s - Penjelasan: t' AS risk FROM documents")
def eval_segments(spark: SparkSession, sf: str) -> DataFrame:
    return materials(spark, sf).select("doc_id", ev.segments(F.col("material")).alias("s")).select("doc_id", "s.*")


_CITED = f"'- ' || {_REF} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END || ' (Catatan: lain)' END"
_FLAT = " || chr(10) || chr(10) || ".join(f"'    {name}:' || chr(10) || '    ' || {text}" for name, text in [
    ("Dasar Hukum", _CITED), ("Ringkasan", "'- p' || chr(10) || '- ' || source"), ("Konteks Tambahan", "'-'"), ("Analisa Risiko (Contoh Pelanggaran)", "'Skenario: s' || chr(10) || 'Penjelasan: t'"),
    ("Tanya Jawab (Q&A)", "CASE WHEN doc_id % 5 = 0 THEN '-' ELSE 'Pertanyaan: a' || chr(10) || 'Jawaban: ' || lang || chr(10) || chr(10) || 'Pertanyaan: b' || chr(10) || 'Jawaban: ' END"),
])


@query("eval_payload", f"SELECT doc_id AS process_id, chr(10) || {_FLAT} || chr(10) || '    ' AS answer, CASE WHEN doc_id % 5 = 0 THEN '-' ELSE lang END AS answer_qa, doc_id % 3 <> 0 AS corrected FROM documents")
def eval_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = materials(spark, sf).select(F.col("doc_id").alias("process_id"), F.lit("q").alias("question"), F.lit("c").alias("context"), F.lit("g").alias("ground_truth"), "material")
    marks = rows.select("process_id", ev.corrected(F.col("material")).alias("corrected"))
    return ev.payload(rows).select("process_id", "answer", "answer_qa").join(marks, "process_id")


@query("gen_fallback", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{ev.NO_CONTEXT}' WHEN length(trim(text, '{SPACE}')) < 300 OR len(regexp_extract_all(lower(text), 'pasal')) < 2 THEN '{ev.THIN}' ELSE '{ev.SYSTEM_ERROR}' END AS point, CASE WHEN doc_id % 4 = 0 THEN '{ev.NO_CONTEXT}' ELSE '-' END AS more FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Pasal 1 Pasal 2 ' || text END AS text FROM documents)")
def gen_fallback(spark: SparkSession, sf: str) -> DataFrame:
    context = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("Pasal 1 Pasal 2 "), "text"))
    m = table(spark, sf, "documents").select("doc_id", ev.fallback_material(context, F.col("doc_id") % 4 != 0).alias("m"))
    return m.select("doc_id", F.col("m.ringkasan")[0]["poin"].alias("point"), F.col("m.konteks_tambahan").alias("more"))


_MADE = "doc_id % 5 > 0 AND text <> ''"


@query("gen_material", f"SELECT doc_id, CASE WHEN {_MADE} THEN left(text, 20) WHEN length(trim(text, '{SPACE}')) < 300 OR len(regexp_extract_all(lower(text), 'pasal')) < 2 THEN '{ev.THIN}' ELSE '{ev.SYSTEM_ERROR}' END AS point, {_MADE} AND doc_id % 2 = 0 AND NOT regexp_matches(text, '(?i)(?:pasal|ps\\.?)\\s*7') AS corrected, CASE WHEN {_MADE} AND (doc_id % 2 = 1 OR regexp_matches(text, '(?i)(?:pasal|ps\\.?)\\s*7')) THEN 1 ELSE 2 END AS attempts FROM documents")
def gen_material(spark: SparkSession, sf: str) -> DataFrame:
    """A generator that fails for a fifth of the requests and corrects references when it is told to."""

    def generator(question: str, context: str, hint: bool) -> dict:
        if "fail" in question or not context:
            raise ValueError("nothing to say")
        return {"ringkasan": [{"poin": context[:20]}], "dasar_hukum": [{"nama_peraturan": "UU", "pasal": "7", "catatan_validasi": "lain" if hint else "-"}]}

    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(d.alias("request_id"), F.concat(F.when(d % 5 == 0, "fail ").otherwise(""), F.when(d % 2 == 0, "Pasal 7").otherwise("apa")).alias("question"), F.col("text").alias("context"))
    m = F.col("material")
    return ev.generated(rows, generator).select(F.col("request_id").alias("doc_id"), m["ringkasan"][0]["poin"].alias("point"), ev.corrected(m).alias("corrected"), "attempts")


_SAID = "CASE WHEN doc_id % 4 = 1 THEN ' None ' WHEN doc_id % 4 = 2 THEN lang ELSE text END"
_PLACEHOLDER = f"trim({_SAID}, '{SPACE}') IN ('-', '', 'None', 'none')"


@query("eval_guards", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'skipped' WHEN {_PLACEHOLDER} THEN 'error' ELSE 'ready' END AS status FROM documents")
def eval_guards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ev.status(F.when(F.col("doc_id") % 4 == 0, "-").otherwise("q"), F.expr(_SAID), F.lit("-")).alias("status"))


@query("eval_chunks", f"SELECT doc_id, CASE WHEN len(parts) = 0 THEN [text] ELSE parts END AS chunks FROM (SELECT doc_id, text, list_filter(list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, '{SPACE}')), lambda x: x <> '') AS parts FROM documents)")
def eval_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ev.context_chunks(F.replace("text", F.lit(".\n"), F.lit(".\n\n"))).alias("chunks"))


# verdicts of eight documents each
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("item", F.expr("doc_id div 8"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.col(c).alias("x")))), lambda s: s.x)
    return rows.groupBy("item").agg(in_order("quality").alias("v"), F.max("lang").alias("lang"))


_VERDICTS = "v AS (SELECT doc_id // 8 AS item, list(quality ORDER BY doc_id) AS v, max(lang) AS lang FROM documents JOIN labels USING (doc_id) GROUP BY 1)"
_SHARE = "list_sum(v)::DOUBLE / len(v)"
_PRECISION = "CASE WHEN list_sum(v) > 0 THEN list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN v[k] = 1 THEN list_sum(v[1:k])::DOUBLE / k ELSE 0 END)) / list_sum(v) END"
_ROUNDED = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"


@query("eval_metric_arith", f"WITH {_VERDICTS} SELECT item, {_SHARE} AS faithfulness, {_ROUNDED(_PRECISION)} AS context_precision, CASE WHEN lang = 'en' THEN 0.0 ELSE {_SHARE} END AS answer_relevancy FROM v")
def eval_metric_arith(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return verdicts(spark, sf).select("item", ev.share_true(v).alias("faithfulness"), ev.clean_score(ev.precision_at(v)).alias("context_precision"), ev.relevancy(v.cast("array<double>"), F.col("lang") == "en").alias("answer_relevancy"))


def judged_items(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item")
    v, none = verdicts(spark, sf), F.lit(None)
    dash = lambda on: F.when(on, "-").otherwise("said")
    rows = v.select(i, F.when(i % 17 == 0, "NONE").otherwise("q").alias("question"), dash(i % 4 == 0).alias("summary"), dash(i % 6 == 0).alias("qa"), dash(i % 5 == 0).alias("risk"), F.when(i % 3 > 0, "g").alias("ground_truth"), (i % 7 == 0).alias("is_reeval"), (i % 2 == 0).alias("reuse_relevancy"), F.when(i % 4 < 3, 0.25).alias("old_answer_relevancy"), F.lit(0.5).alias("old_faithfulness_summary"), none.cast("double").alias("old_faithfulness_qa"), F.lit(0.75).alias("old_risk_faithfulness"), F.array(F.lit("risk")).alias("old_segments"), *(F.col("v").alias(f"v_{k}") for k in ("summary", "qa", "risk", "precision", "recall")), F.col("v").cast("array<double>").alias("similarities"), (F.col("lang") == "en").alias("noncommittal"))
    return ev.judged(ev.guarded(rows))


_JUDGED = f"""{_VERDICTS}, i AS (SELECT *, item % 17 = 0 AS blank, item % 4 > 0 AS summary, item % 6 > 0 AS qa, item % 5 > 0 AS risk, item % 3 > 0 AS truth, item % 7 = 0 AS reeval, item % 2 = 0 AND item % 4 < 3 AS reuse, CASE WHEN item % 4 < 3 THEN 0.25::DOUBLE END AS old, {_SHARE} AS share, {_PRECISION} AS prec FROM v),
    g AS (SELECT *, CASE WHEN reeval AND NOT truth THEN 're-evaluation needs a ground truth' WHEN NOT reeval AND NOT summary AND NOT qa AND NOT risk THEN 'all segments are placeholders' END AS e, CASE WHEN truth AND qa THEN 'qa' WHEN truth AND summary THEN 'summary' END AS b FROM i),
    o AS (SELECT *, NOT blank AND e IS NULL AS ok FROM g)
    SELECT item, CASE WHEN blank THEN 'skipped' WHEN e IS NOT NULL THEN 'error' ELSE 'success' END AS status, CASE WHEN NOT blank THEN e END AS error, CASE WHEN ok THEN b END AS basis,
        CASE WHEN ok THEN CASE WHEN reeval THEN 0.5 WHEN summary THEN {_ROUNDED('share')} END END AS faithfulness_summary, CASE WHEN ok AND NOT reeval AND qa THEN {_ROUNDED('share')} END AS faithfulness_qa,
        CASE WHEN ok THEN CASE WHEN reeval THEN old WHEN qa THEN CASE WHEN reuse THEN old WHEN lang = 'en' THEN 0.0 ELSE {_ROUNDED('share')} END END END AS answer_relevancy,
        CASE WHEN ok AND b IS NOT NULL THEN {_ROUNDED('prec')} END AS context_precision, CASE WHEN ok AND b IS NOT NULL THEN {_ROUNDED('share')} END AS context_recall,
        CASE WHEN ok THEN CASE WHEN reeval THEN 0.75 WHEN risk THEN {_ROUNDED('share')} END END AS risk_faithfulness,
        coalesce(CASE WHEN ok AND NOT reeval AND risk THEN {_ROUNDED('share')} END < 0.6, false) AS low_risk_score,
        CASE WHEN ok THEN CASE WHEN reeval THEN array_to_string(list_sort(list_distinct(list_filter(['risk', b], lambda x: x IS NOT NULL))), ',') ELSE concat_ws(',', CASE WHEN summary THEN 'faithfulness' END, CASE WHEN qa THEN 'qa' END, CASE WHEN risk THEN 'risk' END) END END AS segments FROM o"""


@query("eval_modes", f"WITH {_JUDGED}")
def eval_modes(spark: SparkSession, sf: str) -> DataFrame:
    return judged_items(spark, sf).select("item", "status", "error", "basis", *ev.METRICS, "low_risk_score", F.array_join("segments", ",").alias("segments"))


def outcomes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("item_id")
    items = table(spark, sf, "benchmark").select(i, F.col("text").alias("question"), F.col("text").alias("reference_context"))
    done = items.where(i % 9 > 0).select("item_id", F.when(i % 7 > 0, i + 1000).alias("process_id"), F.when(i % 5 == 0, ev.SYSTEM_ERROR).otherwise("p").alias("first_point"), F.lit("found").alias("context"))
    return items, done


_GOOD = "item_id % 9 > 0 AND item_id % 7 > 0 AND item_id % 5 > 0"


@query("eval_golden_run", f"SELECT 1 AS run_id, item_id, CASE WHEN {_GOOD} THEN item_id + 1000 END AS process_id, CASE WHEN {_GOOD} THEN 'success' ELSE 'failed' END AS status, (SELECT count(*) FROM benchmark) AS total_items, (SELECT count(*) FROM benchmark WHERE {_GOOD}) AS success_count FROM benchmark")
def eval_golden_run(spark: SparkSession, sf: str) -> DataFrame:
    results, counts = ev.golden_run(*outcomes(spark, sf), run_id=1)
    return results.join(F.broadcast(counts.select("run_id", "total_items", "success_count")), "run_id")


@query("eval_two_contexts", f"SELECT item_id, 'dataset_eval_live' AS evaluation_type, ['found'] AS chunks FROM benchmark WHERE {_GOOD} UNION ALL SELECT item_id, 'dataset_eval_reference', CASE WHEN len(p) = 0 THEN [text] ELSE p END FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, '{SPACE}')), lambda x: x <> '') AS p FROM benchmark WHERE {_GOOD})")
def eval_two_contexts(spark: SparkSession, sf: str) -> DataFrame:
    items, done = outcomes(spark, sf)
    results, _ = ev.golden_run(items, done, run_id=1)
    return ev.two_evaluations(items.join(done.select("item_id", "context"), "item_id", "left"), results).select("item_id", "evaluation_type", "chunks")


@query("eval_datasets", "SELECT id, name, n_items, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM (SELECT label AS id, 'set ' || label AS name, count(*) FILTER (WHERE vec_id % 3 = 0) AS n_items, max(vec_id) AS created_at FROM embeddings GROUP BY label)")
def eval_datasets(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    sets = e.groupBy(F.col("label").alias("id")).agg(F.max("vec_id").alias("created_at")).withColumn("name", F.concat(F.lit("set "), F.col("id").cast("string")))
    return ev.with_item_counts(sets, e.where("vec_id % 3 = 0").select(F.col("label").alias("dataset_id"))).select("id", "name", "n_items", "place")


@query("eval_add_datasets", "WITH n AS (SELECT doc_id AS id, source || ' ' || lang || doc_id % 50 AS name FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM n) SELECT id, name, k = 1 AND name NOT IN (SELECT source || ' ' || lang || '7' FROM documents) AS added FROM f")
def eval_add_datasets(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    new = d.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), "lang", (F.col("doc_id") % 50).cast("string")).alias("name"))
    old = d.select(F.concat("source", F.lit(" "), "lang", F.lit("7")).alias("name")).distinct()
    free, taken = ev.add_datasets(new, old)
    return free.withColumn("added", F.lit(True)).unionByName(taken.withColumn("added", F.lit(False)))


_METRIC = {m: f"CASE WHEN doc_id % {k + 3} = 0 THEN NULL WHEN doc_id % 13 = {k} THEN 'NaN'::DOUBLE ELSE (quality * 2 + doc_id % {k + 5}) / {k + 7}.0 END" for k, m in enumerate(ev.METRICS)}
_EVAL = "r AS (SELECT doc_id % 19 = 0 AS failed, doc_id % 3 AS run_id, CASE WHEN doc_id % 2 = 0 THEN 'dataset_eval_live' ELSE 'dataset_eval_reference' END AS evaluation_type, CASE WHEN doc_id % 17 = 0 THEN '' ELSE lang END AS category, " + ", ".join(f"{x} AS {m}" for m, x in _METRIC.items()) + " FROM documents JOIN labels USING (doc_id))"
_UNITS = lambda m: f"floor(CASE WHEN isnan({m}) THEN NULL ELSE {m} END * 1e9 + 0.5)::BIGINT"
_MEANS = ", ".join(f"floor(sum({_UNITS(m)})::DOUBLE / count({_UNITS(m)}) / 1e9 * 10000 + 0.5) / 10000 AS {m}" for m in ev.METRICS)


@query("eval_report", f"WITH {_EVAL}, t AS (SELECT run_id, count(*) AS total_items FROM (SELECT doc_id % 3 AS run_id FROM documents JOIN labels USING (doc_id)) GROUP BY 1) SELECT run_id, 'type' AS kind, evaluation_type AS name, count(*) AS n, {_MEANS}, any_value(total_items) AS total_items FROM r JOIN t USING (run_id) WHERE NOT failed GROUP BY run_id, evaluation_type UNION ALL SELECT run_id, 'category', category, count(*), {_MEANS}, any_value(total_items) FROM r JOIN t USING (run_id) WHERE category <> '' AND NOT failed GROUP BY run_id, category")
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    metrics = [F.expr(x.replace("'NaN'::DOUBLE", "double('NaN')").replace(".0 END", "D END")).alias(m) for m, x in _METRIC.items()]
    base = rows.select((F.col("doc_id") % 3).alias("run_id"), F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 19 > 0, F.col("doc_id")).alias("process_id"), F.when(F.col("doc_id") % 2 == 0, "dataset_eval_live").otherwise("dataset_eval_reference").alias("evaluation_type"), F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("lang")).alias("category"), *metrics)
    return ev.report(base.select("run_id", "item_id", "process_id"), base.where("process_id is not null").select("process_id", "evaluation_type", *ev.METRICS), base.select("item_id", "category"))


@query("eval_bands", "SELECT vec_id, CASE WHEN x >= 0.85 THEN 'very good' WHEN x >= 0.7 THEN 'good' WHEN x >= 0.5 THEN 'fair' ELSE 'weak' END AS band FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS x FROM embeddings)")
def eval_bands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", ev.band((F.col("vec_id") % 100) / 100.0).alias("band"))


@query("eval_csv_validate", "SELECT row_number() OVER (ORDER BY item_id) + 1 AS row_number, CASE WHEN item_id % 5 = 0 THEN 'question is empty' WHEN item_id % 7 = 0 THEN 'unknown knowledge base' END AS reason FROM benchmark")
def eval_csv_validate(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(i, F.when(i % 5 == 0, " ").otherwise(F.col("text")).alias("question"), F.lit("g").alias("ground_truth"), F.lit("c").alias("reference_context"), F.when(i % 7 == 0, "nowhere").otherwise("KB").alias("knowledge_base"))
    bases = spark.createDataFrame([("kb",)], "kb string")
    return knowledge.validate_rows(rows, bases, order="item_id").select("row_number", "reason")


# histories: conversations as sessions, turns as processes
@query("hist_latest_by_id", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id")
def hist_latest_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latest(table(spark, sf, "conversations"), "conv_id", F.desc("turn"), "turn").select("conv_id", "turn")


@query("hist_latest_by_time", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def hist_latest_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latest(table(spark, sf, "events"), "user_id", F.desc_nulls_last("ts"), "event_id").select("user_id", "event_id")


@query("hist_serialized", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 't' || doc_id END AS title, CASE WHEN l.doc_id IS NULL THEN 'skipped' WHEN quality = 1 THEN 'done' ELSE 'error' END AS evaluation_status FROM documents LEFT JOIN labels l USING (doc_id)")
def hist_serialized(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    processes = docs.select(d.alias("id"), F.col("source").alias("session_id"), F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("t"), d.cast("string"))).alias("title"))
    sessions = docs.select(F.col("source").alias("id"), F.col("source").alias("session_title"), F.lit("kb").alias("knowledge_base")).distinct()
    evaluations = table(spark, sf, "labels").select(d.alias("id"), d.alias("process_id"), F.when(F.col("quality") == 1, "done").alias("status"), F.lit(None).cast("timestamp").alias("created_at"))
    return ev.serialised(processes, sessions, evaluations).select("id", "title", "evaluation_status")


@query("hist_buckets", "SELECT event_id, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n < 7 THEN 'Previous 7 Days' ELSE 'Older' END AS bucket, strftime(ts, '%H:%M') AS clock FROM (SELECT *, date_diff('day', ts::DATE, DATE '2024-01-20') AS n FROM events)")
def hist_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", ev.time_bucket(F.col("ts"), F.lit("2024-01-20").cast("date")).alias("bucket"), F.date_format("ts", "HH:mm").alias("clock"))


@query("hist_delete_cascade", "WITH kept AS (SELECT * FROM conversations WHERE turn > 1) SELECT 'process' AS kind, conv_id * 1000 + turn AS id FROM kept UNION ALL SELECT 'evaluation', conv_id * 1000 + turn FROM kept UNION ALL SELECT DISTINCT 'session', conv_id FROM kept")
def hist_delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "turn")
    processes, sessions, evaluations = ev.delete_processes(p.where("turn <= 1"), p, p.select(F.col("session_id").alias("id")).distinct(), p.select(F.col("id").alias("process_id")))
    kind = lambda df, name, c: df.select(F.lit(name).alias("kind"), F.col(c).alias("id"))
    return kind(processes, "process", "id").unionByName(kind(sessions, "session", "id")).unionByName(kind(evaluations, "evaluation", "process_id"))


@query("hist_sessions", "WITH k AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0) SELECT c.conv_id * 1000 + turn AS request_id, CASE WHEN turn % 2 = 0 AND k.conv_id IS NOT NULL THEN c.conv_id::VARCHAR ELSE 's-' || (c.conv_id * 1000 + turn) END AS session FROM conversations c LEFT JOIN k USING (conv_id)")
def hist_sessions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    asked_for = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.when(F.col("turn") % 2 == 0, F.col("conv_id")).alias("session_id"), F.lit("t").alias("session_title"), F.lit("kb").alias("knowledge_base"), F.lit("p").alias("provider"))
    known = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("id")).distinct()
    return ev.get_or_create_sessions(asked_for, known)[0]


@query("hist_append_evaluations", "SELECT doc_id AS process_id, CASE WHEN doc_id % 4 = 0 THEN 'live' WHEN doc_id % 4 = 1 THEN 'manual_with_ground_truth' ELSE 'auto_evaluation' END AS evaluation_type, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, doc_id % 4 = 1 AS truth FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def hist_append_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    results = table(spark, sf, "documents").select(d.alias("process_id"), F.when(d % 4 == 0, "live").when(d % 4 == 2, "").alias("source_label"), F.when(d % 4 == 1, "g").alias("ground_truth"), F.when(d % 5 > 0, "success").alias("status"))
    return ev.new_evaluations(results, table(spark, sf, "labels").select(d.alias("process_id"))).select("process_id", "evaluation_type", "status", F.col("ground_truth").isNotNull().alias("truth"))


@query("hist_nested", "SELECT conv_id AS id, string_agg(turn || ':' || length(text), ',' ORDER BY turn) AS evaluations FROM conversations WHERE conv_id % 3 > 0 GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, '' FROM conversations WHERE conv_id % 3 = 0")
def hist_nested(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    evaluations = c.where("conv_id % 3 > 0").select(F.col("turn").alias("id"), F.col("conv_id").alias("process_id"), F.length("text").alias("chars"))
    out = ev.with_evaluations(c.select(F.col("conv_id").alias("id")).distinct(), evaluations)
    return out.select("id", F.array_join(F.transform("evaluations", lambda e: F.concat(e["id"].cast("string"), F.lit(":"), e["chars"].cast("string"))), ",").alias("evaluations"))


@query("hist_retitled", f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND length(trim(split_part(text, '.', 1), '{SPACE}')) BETWEEN 1 AND 255 THEN trim(split_part(text, '.', 1), '{SPACE}') ELSE source END AS title, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' ELSE lang END AS label FROM documents")
def hist_retitled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    out = ev.retitled(d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "lang"), d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.substring_index("text", ".", 1).alias("new_title")))
    return out.select("id", "title", ev.label_of(F.col("lang"), {"en": "English", "de": "Deutsch"}).alias("label"))


@query("hist_page", "SELECT event_id, (SELECT count(*) FROM events) AS total FROM (SELECT * FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50 OFFSET 10)")
def hist_page(spark: SparkSession, sf: str) -> DataFrame:
    page, total = ev.newest_page(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at")), 50, 10)
    return page.select(F.col("id").alias("event_id")).join(F.broadcast(total))


@query("hist_json", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events""")
def hist_json(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 10 == 0, "{oops").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.from_json(broken, "k long")["k"].alias("k"))


# quotas: users as models, values as tokens
def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.round("value").cast("long").alias("tokens"))


_REQ = "r AS (SELECT event_id AS request_id, user_id AS model, ts, epoch_us(ts) AS us, round(value)::BIGINT AS tokens FROM events)"


@query("quota_minute", f"WITH {_REQ} SELECT request_id, sum(tokens) OVER w AS tokens_minute, count(*) OVER w AS requests_minute FROM r WINDOW w AS (PARTITION BY model ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def quota_minute(spark: SparkSession, sf: str) -> DataFrame:
    return ev.windowed_usage(requests(spark, sf)).select("request_id", "tokens_minute", "requests_minute")


@query("quota_day", f"WITH {_REQ}, u AS (SELECT request_id, model, sum(tokens) OVER w AS tokens_day, count(*) OVER w AS requests_day FROM r WINDOW w AS (PARTITION BY model ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)) SELECT request_id, tokens_day, requests_day, tokens_day > CASE WHEN model % 2 = 0 THEN 100 ELSE 90000 END AS over_day FROM u")
def quota_day(spark: SparkSession, sf: str) -> DataFrame:
    limits = requests(spark, sf).where("model % 2 = 0").select("model").distinct().withColumns({"tpm": F.lit(50), "tpd": F.lit(100)})
    return ev.with_limits(ev.windowed_usage(requests(spark, sf)), limits).select("request_id", "tokens_day", "requests_day", "over_day")


@query("quota_gap", f"WITH {_REQ} SELECT request_id, (us - lag(us) OVER (PARTITION BY model ORDER BY us, request_id)) / 1e6 AS gap_seconds FROM r")
def quota_gap(spark: SparkSession, sf: str) -> DataFrame:
    return ev.windowed_usage(requests(spark, sf)).select("request_id", "gap_seconds")


@query("quota_tokens", "SELECT doc_id, greatest(floor(length(text) / 4 * 1.2)::BIGINT, 150) AS estimate FROM documents")
def quota_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ev.token_estimate(F.length("text")).alias("estimate"))


@query("quota_limits", "SELECT model, requests, tokens, tokens > CASE WHEN model % 2 = 0 THEN 50 ELSE 4500 END AS over_minute FROM (SELECT user_id AS model, count(*) AS requests, sum(round(value)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1)")
def quota_limits(spark: SparkSession, sf: str) -> DataFrame:
    used = requests(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens_minute")).withColumn("tokens_day", F.lit(0))
    limits = requests(spark, sf).where("model % 2 = 0").select("model").distinct().withColumns({"tpm": F.lit(50), "tpd": F.lit(100)})
    return ev.with_limits(used, limits).select("model", "requests", F.col("tokens_minute").alias("tokens"), "over_minute")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(round(value)::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return windows.run_tumbling(spark, sf).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "tokens")


@query("stream_session", "WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)), 9e18) >= 1800000000 AS opens FROM events), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    ntz = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    return windows.run_sessions(spark, sf).select("user_id", ntz("start", "start"), ntz("end", "stop"), "n")


@query("stream_admissions")
def stream_admissions(spark: SparkSession, sf: str) -> DataFrame:
    stream = windows.event_stream(spark, sf).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("model"), "ts", F.round("value").cast("long").alias("tokens"))
    return windows.run_to_table(windows.admissions(stream, tokens=200, number=3), None, "admissions")


# knowledge bases
@query("kb_stats", "SELECT 'kb' || (label % 3) AS kb, count(*) FILTER (WHERE vec_id % 4 = 0) AS parents, count(*) FILTER (WHERE vec_id % 4 <> 0) AS children FROM embeddings GROUP BY 1")
def kb_stats(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.stats(_bases(spark, sf))


@query("kb_monitor", "WITH p AS (SELECT 'kb' || (label % 3) AS kb, vec_id % 4 = 0 AS parent, vec_id FROM embeddings), a AS (SELECT DISTINCT kb FROM p UNION ALL SELECT 'nowhere'), r AS (SELECT *, row_number() OVER (PARTITION BY kb, parent ORDER BY vec_id) AS n FROM p), f AS (SELECT kb, list(vec_id ORDER BY vec_id) FILTER (WHERE parent AND n <= 5) AS pp, list(vec_id ORDER BY vec_id) FILTER (WHERE NOT parent AND n <= 5) AS cp, count(*) FILTER (WHERE parent) AS parents, count(*) FILTER (WHERE NOT parent) AS children FROM r GROUP BY kb) SELECT kb, CASE WHEN parents > 0 AND children > 0 THEN 'active' WHEN parents + children > 0 THEN 'partial_error' ELSE 'not_found' END AS status, coalesce(parents, 0) AS parents, coalesce(children, 0) AS children, pp AS parent_preview, cp AS child_preview FROM a LEFT JOIN f USING (kb)")
def kb_monitor(spark: SparkSession, sf: str) -> DataFrame:
    bases = _bases(spark, sf)
    return knowledge.monitor(bases, bases.select("kb").distinct().unionByName(spark.createDataFrame([("nowhere",)], "kb string")))


@query("kb_list", "SELECT DISTINCT 'kb' || (label % 3) AS kb, 'kb' || (label % 3) || '_' || CASE WHEN vec_id % 4 = 0 THEN 'parent' ELSE 'child' END AS name, count(*) OVER (PARTITION BY label % 3, vec_id % 4 = 0) AS points FROM embeddings")
def kb_list(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.list_bases(_bases(spark, sf)).join(knowledge.detailed(_bases(spark, sf)), "kb").select("kb", "name", "points")


@query("kb_resolve", "WITH b AS (SELECT DISTINCT 'kb' || (label % 3) AS kb FROM embeddings), a AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'Kb' ELSE 'kb' END || page_id % 5 AS asked FROM pages) SELECT asked, kb FROM a LEFT JOIN b ON lower(asked) = lower(kb)")
def kb_resolve(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    asked_for = table(spark, sf, "pages").select(F.concat(F.when(i % 2 == 0, "Kb").otherwise("kb"), (i % 5).cast("string")).alias("asked")).distinct()
    return knowledge.resolve(asked_for, _bases(spark, sf).select("kb").distinct())


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, read by an extractor that takes lines for pages and can't read texts that begin with a vowel."""

    def lines(content: bytes) -> list[str]:
        text = content.decode()
        if text[:1] in ("A", "E", "I", "O", "U"):
            raise ValueError("unreadable")
        return text.split("\n") if text else []

    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return knowledge.extract_pages(files, lines)


_PAGES = "p AS (SELECT doc_id::VARCHAR AS path, text, left(text, 1) IN ('A', 'E', 'I', 'O', 'U') AS bad FROM documents)"


@query("src_pages", f"WITH {_PAGES} SELECT path, unnest(range(1, len(l) + 1))::INT AS page, unnest(l) AS text, NULL AS issue FROM (SELECT path, string_split(text, chr(10)) AS l FROM p WHERE NOT bad AND text <> '') UNION ALL SELECT path, NULL, NULL, CASE WHEN bad THEN 'ValueError: unreadable' ELSE 'no pages' END FROM p WHERE bad OR text = ''")
def src_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_of(spark, sf)


@query("src_status", f"WITH {_PAGES} SELECT path, CASE WHEN bad OR text = '' THEN 'failed' ELSE 'success' END AS status, CASE WHEN bad OR text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS pages, CASE WHEN bad THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) END AS words, CASE WHEN bad THEN '' ELSE text END AS text FROM p")
def src_status(spark: SparkSession, sf: str) -> DataFrame:
    pages = pages_of(spark, sf)
    return knowledge.file_status(pages).select("path", "status", "pages", "words").join(knowledge.plain_text(pages), "path")


@query("kb_names", "SELECT doc_id, replace(lower(trim(' ' || source || ' X ')), ' ', '_') AS base, 'jdbc:postgresql://host' || doc_id || ':' || CASE WHEN doc_id % 2 = 0 THEN '5432' ELSE '6000' END || '/base' AS url FROM documents")
def kb_names(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    loose = F.concat(F.lit("postgres+x://u:p@s@host"), d, F.when(F.col("doc_id") % 2 == 0, "").otherwise(":6000"), F.lit("/base?ssl=1"))
    return table(spark, sf, "documents").select("doc_id", knowledge.base_name(F.concat(F.lit(" "), "source", F.lit(" X "))).alias("base"), knowledge.jdbc_url(loose).alias("url"))


@query("kb_store", "SELECT kb, count(*) FILTER (WHERE role = 'parent' AND has) AS parents, count(*) FILTER (WHERE role = 'child' AND has) AS children, count(*) FILTER (WHERE NOT has) AS skipped, CASE WHEN bool_and(has) THEN 'success' ELSE 'partial_error' END AS status FROM (SELECT 'kb' || (label % 3) AS kb, CASE WHEN vec_id % 4 = 0 THEN 'parent' ELSE 'child' END AS role, NOT (label % 3 = 1 AND vec_id % 5 = 0) AS has FROM embeddings) GROUP BY kb")
def kb_store(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of three bases into a new table; a part of one base has no embedding."""
    v = F.col("vec_id")
    chunks = _bases(spark, sf).join(table(spark, sf, "embeddings").select(v.alias("chunk_id"), F.when(~((F.col("label") % 3 == 1) & (v % 5 == 0)), F.col("embedding")).alias("embedding")), "chunk_id")
    return knowledge.store_chunks(chunks.withColumns({"doc_id": F.lit(0), "content": F.lit("")}), scratch_dir(spark, "points"))


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(F.concat(F.lit("kb"), (F.col("label") % 3).cast("string")).alias("kb"), F.when(v % 4 == 0, "parent").otherwise("child").alias("role"), v.alias("chunk_id"))


# relational operators over the star tables
@query("rel_inner", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def rel_inner(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_custkey", "o_totalprice").join(table(spark, sf, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rel_left_anti_semi", "SELECT count(*) FILTER (WHERE o IS NULL) AS without_orders, count(o) AS with_orders FROM (SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o FROM customer)")
def rel_left_anti_semi(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    both = c.join(o, on, "left_semi").select(F.lit(1).alias("x")).unionByName(c.join(o, on, "left_anti").select(F.lit(0).alias("x")))
    return both.agg(F.count_if(F.col("x") == 0).alias("without_orders"), F.count_if(F.col("x") == 1).alias("with_orders"))


@query("rel_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def rel_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("rel_topk", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def rel_topk(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", rank.alias("rank")).where("rank <= 3").drop("o_totalprice")


@query("rel_union_except", "SELECT c_nationkey AS k, 'customer' AS side FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT DISTINCT s_nationkey, 'supplier' FROM supplier")
def rel_union_except(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, sf, "supplier")
    left = c.join(s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k", "left_anti").withColumn("side", F.lit("customer"))
    return left.unionByName(s.select(F.col("s_nationkey").alias("k")).distinct().withColumn("side", F.lit("supplier")))


@query("rel_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rel_left(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, sf, "customer", "c_custkey").join(n, "c_custkey", "left").na.fill(0, ["orders"])


@query("rel_running_sum", "SELECT o_custkey, o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM orders")
def rel_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w).alias("cents"))


@query("rel_asof", "SELECT a.event_id, b.event_id AS before FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def rel_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with the last click of its user up to its time: both sides in one window, so no pairs are made."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click"))
    both = e.select("user_id", "ts", "event_id", F.lit(None).cast("long").alias("click"), F.lit(1).alias("side")).unionByName(clicks.select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), "click", F.lit(0).alias("side")))
    w = Window.partitionBy("user_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("before", F.last("click", True).over(w)).where("side = 1").select("event_id", "before")
