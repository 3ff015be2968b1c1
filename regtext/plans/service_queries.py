"""Queries for the services around retrieval: vector index, merged points, lexical scores, judges, quotas, late events, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regtext.operators import changes, lexical
from regtext.operators import evaluate as ev
from regtext.operators import retrieve as rt
from regtext.operators import vector_index
from regtext.plans.catalog import ORACLES, query
from regtext.plans.engine_queries import asked, hits, points
from regtext.sources import knowledge, pages
from regtext.sources.tables import scratch_dir, table
from regtext.streaming import quotas, windows

# the vector index
_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


def _built(spark: SparkSession, sf: str) -> tuple[vector_index.Index, int]:
    """An index over all vectors, and the lists to read for a recall of 0.97, tuned on other queries than the asked ones."""
    index = vector_index.build(points(spark, sf), scratch_dir(spark, "index"))
    sample = table(spark, sf, "embeddings").where("vec_id % 100 = 50").select(F.col("vec_id").alias("query_id"), "embedding")
    return index, vector_index.tuned(sample, index, 10, 0.97)


@query("vec_index_recall", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COSINE} AS raw FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM s)
    SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS exact_top, true AS recalled FROM r WHERE rank <= 10 GROUP BY query_id""")
def vec_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100: its ten nearest from all lists, and whether the lists that a search reads hold 9 of 10 of these over all queries."""
    index, probes = _built(spark, sf)
    queries = asked(spark, sf)
    top = vector_index.nearest(queries, index, 10, len(index.centres))
    found = vector_index.nearest(queries, index, 10, probes).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = top.join(found, ["query_id", "chunk_id"], "left")
    share = both.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x.chunk_id)
    return top.groupBy("query_id").agg(F.array_join(ordered, ",").alias("exact_top")).join(F.broadcast(share))


@query("vec_index_search")
def vec_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search (tiers, cut, boosts) over candidates of the index: only the lists near a query are read."""
    index, probes = _built(spark, sf)
    pairs = vector_index.candidate_pairs(asked(spark, sf), index, probes, rt.THRESHOLD, fetch=15)
    return rt.boosted(rt.cut_relative(rt.tiered(pairs, 15), 5)).select("query_id", "chunk_id", "tier", "score", "exact_pasal", "rank")


# merged points: all vectors as points, then a second write that replaces a third of them and adds some
@query("kb_merge", """WITH e AS (SELECT 'kb' || (label % 3) AS kb, CASE WHEN vec_id % 4 = 0 THEN 'parent' ELSE 'child' END AS role, vec_id FROM embeddings)
    SELECT kb, role, vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS content FROM e
    UNION ALL SELECT kb, role, 'n' || vec_id, 'second' FROM e WHERE vec_id % 3 = 0 AND vec_id % 2 = 0""")
def kb_merge(spark: SparkSession, sf: str) -> DataFrame:
    path, v = scratch_dir(spark, "points"), F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("kb"), (F.col("label") % 3).cast("string")).alias("kb"), F.when(v % 4 == 0, "parent").otherwise("child").alias("role"), F.lit(0).alias("doc_id"), v, v.cast("string").alias("chunk_id"), "embedding")
    knowledge.store_chunks(rows.drop("vec_id").withColumn("content", F.lit("first")), path)
    again = rows.where("vec_id % 3 = 0")
    more = again.where("vec_id % 2 = 0").withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))
    knowledge.store_chunks(again.unionByName(more).drop("vec_id").withColumn("content", F.lit("second")), path)
    return knowledge.read_points(spark, path).select("kb", "role", "chunk_id", "content")


# words: candidates of questions are documents by twenties, as for contexts; question n is test item n
_TOKENS = lambda x: f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("vec_rerank_lexical", f"""WITH d AS (SELECT doc_id, doc_id // 20 AS query_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS rank, doc_id % 11 = 0 AS exact, {_TOKENS("text")} AS w FROM documents),
    c AS (SELECT doc_id, query_id, rank, exact, CASE WHEN doc_id % 5 = 0 THEN {_TOKENS("'parent of ' || source || ' that is long enough'")} ELSE w END AS w FROM d JOIN documents USING (doc_id)),
    s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
    q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS("text")})) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM d) GROUP BY term),
    i AS (SELECT query_id, term, ln(1 + (docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM q LEFT JOIN df USING (term), s),
    m AS (SELECT query_id, sum(idf) * 2.2 AS most FROM i GROUP BY 1),
    tf AS (SELECT query_id, doc_id, term, len(w) AS n, len(list_filter(w, lambda x: x = term)) AS tf FROM c JOIN i USING (query_id)),
    b AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM tf JOIN i USING (query_id, term), s WHERE tf > 0 GROUP BY ALL),
    l AS (SELECT c.query_id, rank AS prior, exact, floor(1 / (1 + exp(-4.0 * (2 * coalesce(bm25, 0) / most - 1))) * 10000 + 0.5) / 10000 AS rerank_score FROM c JOIN m USING (query_id) LEFT JOIN b USING (query_id, doc_id)),
    r AS (SELECT query_id, prior, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, rerank_score DESC, prior) AS rank FROM l)
    SELECT query_id, prior, rerank_score, rank FROM r WHERE rank <= 5""")
def vec_rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates reranked by what their texts say: the logit is a BM25 score of the parent's text, or of their own."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = hits(spark, sf).join(questions.select("query_id"), "query_id", "left_semi").withColumn("prior", F.col("rank"))
    texts = rows.withColumn("text", rt.rerank_text(F.col("content"), F.col("parent_content"))).select("query_id", "prior", "rank", "exact", "text")
    scored = lexical.bm25(texts, questions, table(spark, sf, "documents", "text"), ["prior"])
    return rt.reranked(scored, F.col("logit"), 5).select("query_id", "prior", "rerank_score", "rank")


_HASHED = f"""t AS (SELECT doc_id, unnest({_TOKENS('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS docs FROM documents),
    h AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 384)::INT AS bucket, CASE WHEN ('0x' || substr(md5(term), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END * tf * (ln((docs + 1) / (df + 1)) + 1) AS x FROM tf JOIN df USING (term), n),
    b AS (SELECT doc_id, bucket, sum(x) AS weight FROM h GROUP BY ALL)"""


@query("vec_hashed_counts", f"WITH {_HASHED} SELECT doc_id, bucket, floor(weight * 10000 + 0.5) / 10000 AS weight FROM b")
def vec_hashed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.hashed_counts(table(spark, sf, "documents", "doc_id", "text"), ["doc_id"]).select("doc_id", "bucket", rt.rounded(F.col("weight")).alias("weight"))


# the default embedder in place of a model: components (but what rounding leaves of zeros) of every document's vector
ORACLES["vec_embed"] = f"""WITH {_HASHED}, l AS (SELECT doc_id, sqrt(sum(weight * weight)) AS size FROM b GROUP BY 1)
    SELECT doc_id, bucket, floor((weight / size)::FLOAT::DOUBLE * 1000 + 0.5) / 1000 AS component FROM b JOIN l USING (doc_id) WHERE size > 0 AND abs(weight / size) > 1e-6"""


@query("vec_embed", ORACLES["vec_embed"])
def vec_embed(spark: SparkSession, sf: str) -> DataFrame:
    dense = lexical.hashed_embeddings(table(spark, sf, "documents", "doc_id", "text"), ["doc_id"])
    return dense.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where("abs(x) > 1e-6").select("doc_id", "bucket", rt.rounded(F.col("x").cast("double"), 3).alias("component"))


# a judge of words over conversations: the first turn asks, the second answers, all others are the context, the last is the truth
_STATED = lambda x: f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[.!?;\\n]+'), lambda s: list_distinct({_TOKENS('s')})), lambda w: len(w) > 0)"
_HELD = "len(list_intersect({0}, {1}))::DOUBLE / len({0}) >= 0.6"


@query("eval_judge", f"""WITH v AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS question, max(CASE WHEN turn = 1 THEN text END) AS answer, list(text ORDER BY turn) FILTER (WHERE turn <> 1) AS chunks, max_by(text, turn) AS truth FROM conversations GROUP BY 1),
    w AS (SELECT conv_id, list_distinct({_TOKENS('question')}) AS asked, {_STATED('answer')} AS said, {_STATED('truth')} AS stated, list_transform(coalesce(chunks, []), lambda c: list_distinct({_TOKENS('c')})) AS chunks FROM v),
    j AS (SELECT conv_id, list_transform(said, lambda s: (len(list_filter(chunks, lambda c: {_HELD.format('s', 'c')})) > 0)::INT) AS f, list_transform(stated, lambda s: (len(list_filter(chunks, lambda c: {_HELD.format('s', 'c')})) > 0)::INT) AS r,
        list_transform(chunks, lambda c: (len(list_filter(stated, lambda s: {_HELD.format('s', 'c')})) > 0)::INT) AS p, list_transform(said, lambda s: CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, s))::DOUBLE / len(asked) END) AS sim FROM w)
    SELECT conv_id, floor(list_sum(f)::DOUBLE / nullif(len(f), 0) * 10000 + 0.5) / 10000 AS faithfulness, floor(list_sum(r)::DOUBLE / nullif(len(r), 0) * 10000 + 0.5) / 10000 AS context_recall,
        floor(CASE WHEN list_sum(p) > 0 THEN list_sum(list_transform(range(1, len(p) + 1), lambda k: CASE WHEN p[k] = 1 THEN list_sum(p[1:k])::DOUBLE / k ELSE 0 END)) / list_sum(p) END * 10000 + 0.5) / 10000 AS context_precision,
        floor(CASE WHEN len(sim) = 0 THEN 0.0 ELSE list_sum(sim) / len(sim) END * 10000 + 0.5) / 10000 AS answer_relevancy FROM j""")
def eval_judge(spark: SparkSession, sf: str) -> DataFrame:
    """From texts to the four metrics."""
    turn, text = F.col("turn"), F.col("text")
    chunks = F.transform(F.array_sort(F.collect_list(F.when(turn != 1, F.struct("turn", "text")))), lambda x: x.text)
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(turn == 0, text)).alias("question"), F.max(F.when(turn == 1, text)).alias("answer"), chunks.alias("chunks"), F.max_by("text", "turn").alias("ground_truth"))
    v = lexical.verdicts(rows)
    metrics = {"faithfulness": ev.share_true(F.col("v_faithful")), "context_recall": ev.share_true(F.col("v_recall")), "context_precision": ev.precision_at(F.col("v_precision")), "answer_relevancy": ev.relevancy(F.col("similarities"), F.col("noncommittal"))}
    return v.select("conv_id", *(ev.clean_score(c).alias(name) for name, c in metrics.items()))


# histories as a log: turns are saved, renamed, judged and deleted; the log comes in two parts that overlap, the later one first
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    process = F.concat_ws("-", conv.cast("string"), turn.cast("string"))
    step = lambda on, op, late: F.when(on, F.struct(F.lit(op).alias("op"), F.lit(late).alias("late")))
    steps = F.array_compact(F.array(step(F.lit(True), "save", 0), step(turn % 3 == 1, "retitle", 1), step(turn % 2 == 0, "evaluate", 2), step((turn % 4 == 3) | (conv % 10 == 0), "delete", 3), step(conv % 20 == 0, "save", 4)))
    rows = table(spark, sf, "conversations").withColumn("s", F.explode(steps))
    seq = ((conv * 1000 + turn) * 10 + F.col("s.late")).alias("seq")
    named = F.when(F.col("s.op") == "retitle", F.concat(F.lit(" new "), "role")).otherwise(F.col("role"))
    return rows.select(seq, "s.op", process.alias("process_id"), conv.cast("string").alias("session_id"), F.concat(F.lit("session "), conv.cast("string")).alias("session_title"), named.alias("title"), F.to_json(F.struct(F.length("text").alias("n"))).alias("material"), F.concat(F.lit("e"), process).alias("evaluation_id"), F.lit("{}").alias("evaluation"))


@query("hist_changes", """WITH c AS (SELECT *, conv_id || '-' || turn AS p, conv_id % 20 = 0 AS again, conv_id % 20 = 0 OR NOT (turn % 4 = 3 OR conv_id % 10 = 0) AS live FROM conversations),
    p AS (SELECT p AS id, conv_id::VARCHAR AS session_id, CASE WHEN turn % 3 = 1 AND NOT again THEN 'new ' || role ELSE role END AS title, turn, again FROM c WHERE live)
    SELECT 'process' AS kind, id, session_id AS owner, title AS value FROM p UNION ALL SELECT DISTINCT 'session', session_id, NULL, 'session ' || session_id FROM p UNION ALL SELECT 'evaluation', 'e' || id, id, '{}' FROM p WHERE turn % 2 = 0 AND NOT again""")
def hist_changes(spark: SparkSession, sf: str) -> DataFrame:
    log = change_log(spark, sf)
    parts = log.where("seq % 3 > 0"), log.where("seq % 3 < 2")
    facts = changes.merged(changes.facts_of(parts[1]), changes.facts_of(parts[0]), changes.facts_of(parts[1]))
    p, s, e = changes.processes(facts), changes.sessions(facts), changes.evaluations(facts)
    out = p.select(F.lit("process").alias("kind"), "id", F.col("session_id").alias("owner"), F.col("title").alias("value"))
    out = out.unionByName(s.select(F.lit("session").alias("kind"), "id", F.lit(None).cast("string").alias("owner"), F.col("session_title").alias("value")))
    return out.unionByName(e.select(F.lit("evaluation").alias("kind"), "id", F.col("process_id").alias("owner"), F.col("evaluation").alias("value")))


@query("quota_daily_stream")  # an admission depends on all earlier ones; tests hold it against a loop
def quota_daily_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a request of its user, within the user's daily limits."""
    requests = windows.event_stream(spark, sf).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("model"), "ts", F.round("value").cast("long").alias("tokens"))
    path = scratch_dir(spark, "quota")
    quotas.run(quotas.daily_quota(requests, 500, 20), path)
    return spark.read.parquet(f"{path}/rows").drop("batch")


# late events: the first half by time without every tenth, then the second half, then what was left out, then repeats
_HALF = "(SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS half, max(epoch_us(ts)) AS last FROM events)"


@query("stream_late", f"""WITH e AS (SELECT event_id, epoch_us(ts) AS us, half, last FROM events, {_HALF}), a AS (SELECT *, us < half AND event_id % 10 = 0 AS held FROM e), w AS (SELECT max(us) // 1000 - 864000000 AS mark FROM a WHERE us < half AND NOT held)
    SELECT event_id, CASE WHEN held AND us // 1000 <= mark THEN 'late' ELSE 'on_time' END AS status FROM a, w UNION ALL SELECT event_id, 'repeated' FROM a WHERE event_id % 7 = 0 AND NOT held""")
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    low, high = events.agg(F.min(us), F.max(us)).first()
    half = low + (high - low) // 2
    held = (us < half) & (F.col("event_id") % 10 == 0)
    folder = scratch_dir(spark, "arrivals")
    for k, rows in enumerate((events.where((us < half) & ~held), events.where(us >= half), events.where(held), events.where((F.col("event_id") % 7 == 0) & ~held))):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return quotas.split_late(spark, f"{folder}/*", events.schema, late="10 days").select("event_id", "status")


# bulk adding of golden items: every third row lacks a value, by white space of three kinds
@query("golden_items_added", """SELECT item_id, 1 AS dataset_id, text AS question FROM benchmark WHERE item_id % 2 = 0
    UNION ALL SELECT item_id, 2, text FROM benchmark WHERE item_id % 3 <> 0 AND trim(text, chr(9) || chr(10) || chr(13) || ' ') <> ''""")
def golden_items_added(spark: SparkSession, sf: str) -> DataFrame:
    """The items of a dataset with all rows of a sheet added as items of a second one; rows with a blank value stay out."""
    sheet = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.when(F.col("item_id") % 3 != 0, "truth").when(F.col("item_id") % 2 == 0, " \t\n").alias("ground_truth"), F.lit("context").alias("reference_context"))
    first = sheet.where("item_id % 2 = 0").withColumn("dataset_id", F.lit(1))
    return ev.add_items(first, 2, sheet).select("item_id", "dataset_id", "question")


# files of pages: every document is a page, files are read by ranges of bytes
@query("src_page_files", """SELECT sha256(t) AS page_hash, count(*) AS copies, count(*) FILTER (WHERE t = '') AS empty_pages, 0::BIGINT AS issues
    FROM (SELECT replace(coalesce(text, ''), chr(12), ' ') AS t FROM documents) GROUP BY 1""")
def src_page_files(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as files of pages, cut into ranges, and read by the source of pages."""
    path, index = scratch_dir(spark, "paged"), scratch_dir(spark, "page_index")
    table(spark, sf, "documents").select(F.translate(F.coalesce("text", F.lit("")), "\f", " ").alias("text")).write.option("lineSep", "\f").text(path)
    pages.index_pages(spark, [path], index, pattern="*.txt")
    read = pages.read_pages(spark, index)
    empty, issues = F.count_if(F.col("text") == ""), F.count_if(F.col("issue").isNotNull() & (F.col("issue") != "no pages"))
    return read.where("page is not null or issue <> 'no pages'").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("page_hash")).agg(F.count(F.lit(1)).alias("copies"), empty.alias("empty_pages"), issues.alias("issues"))
