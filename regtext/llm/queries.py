"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regtext.llm import brown, decontaminate, exact_dedup, impact_index, license_templates, ngram_join, periodic_runs, quality, sign_hash, stages, surrogates, url_trees, warc
from regtext.llm import sentencepiece_viterbi as pieces
from regtext.llm.support import materialise, shared_dir

#: Key of the surrogates; a deployment passes its own secret to the operator.
SURROGATE_KEY = "regtext-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    warc.write_archives(warc.resolve_revisits(pages), path)
    read = warc.resolved_records(materialise(warc.read_archives(spark, path, with_payload=False), "records"))
    return read.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_page").cast("long").alias("refers_to"), "intact")


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_templates.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p.kind == "base")
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")
    starts = F.transform(base, lambda p: p.first_word)
    share = F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names("places").alias("labels"), share.alias("score"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.filter_urls(_table(spark, sf_dir, "pages"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replace_entities(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return found.select("doc_id", "n_entities", F.array_join("kinds", ",").alias("kinds"), "text")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r.last_word - r.first_word + 1)
    found = found.withColumn("n_hit", hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Pieces.load()
    decoded = pieces.encode(_table(spark, sf_dir, "documents"), vocabulary, decoded=True)
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.col("text") == F.col("decoded")).alias("round_trip"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", first).withColumn("length", -F.col("best.shorter"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"), F.floor(1000 * F.col("length") / F.col("best.period")).alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_hash.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_revisits, op2_license_templates, op3_brown_lm, op4_quality, op5_url_trees, op6_pii_surrogates, op7_ngram_jaccard, op8_grace_dedup, op9_decontaminate, op10_sentencepiece, op11_impact_search, op12_periodic_runs, op13_embedding_near_dup, pipeline)
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
               CASE WHEN original IS NULL OR original = page_id OR payload_bytes < 1000 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN original IS NULL OR original = page_id OR payload_bytes < 1000 THEN NULL ELSE original END AS refers_to, true AS intact
        FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest""",
    "op8_grace_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op9_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        pat AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS p FROM b WHERE len(w) > 0),
        ks AS (SELECT DISTINCT k FROM pat),
        win AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 'p': array_to_string(w[i:i + k - 1], ' ')}})) AS x FROM d, ks WHERE len(w) >= k),
        hit AS (SELECT DISTINCT doc_id, x.i AS i, win.k AS k, item_id FROM win JOIN pat ON x.p = pat.p AND win.k = pat.k),
        c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op11_impact_search": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
        stat AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        post AS (SELECT doc_id, any_value(len(w)) AS n, t.term AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) t WHERE t.term IN (SELECT term FROM q) GROUP BY doc_id, t.term),
        df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, stat),
        imp AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS impact FROM post, stat),
        s AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM q JOIN imp ON q.term = imp.term JOIN weighed ON weighed.term = q.term GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_embedding_near_dup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE list_dot_product(x, x) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
if stages.ORACLE_SQL:
    ORACLES["pipeline"] = stages.ORACLE_SQL
