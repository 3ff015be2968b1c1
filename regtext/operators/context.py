"""From search hits to a context: exclusion, one hit per parent, narrowing, gate, packing, citations.

hits: query_id, rank, exact, score (confidence, may be null), parent_id, pasal, pasal_rujukan, parent_pasal,
parent_rujukan, parent_content, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regtext.functions.text import strip

# Articles about internal matters, least length of a content, confidence gate, budget.
INTERNAL = [*range(16, 26), *range(27, 31)]
LEAST_LENGTH, GATE, BUDGET = 30, 0.3, 1200


def _query():
    return Window.partitionBy("query_id")


def candidates(hits: DataFrame, internal: list[int] = INTERNAL) -> DataFrame:
    """Article resolved, internal ones out unless exact, first hit of each parent, and a content long enough."""
    h = hits.withColumn("article", F.coalesce("pasal", "pasal_rujukan", "parent_pasal", "parent_rujukan"))
    h = h.where(F.col("exact") | ~F.coalesce(F.col("article").isin(internal), F.lit(False)))
    blank = F.coalesce(F.col("parent_id"), F.lit("")) == ""
    turn = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))
    h = h.withColumn("turn", F.when(blank, 1).otherwise(turn)).where("turn = 1").drop("turn")
    # the parent's content, else the hit's, else its raw text: the first that is long enough, stripped
    text = None
    for c in ("parent_content", "content", "raw_text"):
        if c in h.columns:
            long = F.length(strip(c)) > LEAST_LENGTH
            text = F.when(long, strip(c)) if text is None else text.when(long, strip(c))
    return h.withColumn("text", text).where("text is not null")


def narrowed(contexts: DataFrame) -> DataFrame:
    """Without an exact match, the hit with the best known confidence only (the first on ties); then the gate."""
    confidence = F.coalesce("score", F.lit(-1.0))
    best = F.row_number().over(_query().orderBy(F.desc(confidence), "rank"))
    c = contexts.withColumns({"any_exact": F.bool_or("exact").over(_query()), "known": F.max("score").over(_query()), "best": best})
    c = c.where(F.col("any_exact") | F.col("known").isNull() | (F.col("best") == 1))
    return c.where(F.col("any_exact") | F.coalesce(F.col("known") >= GATE, F.lit(True))).drop("best", "known")


def packed(contexts: DataFrame, budget: int = BUDGET, prefix: int = 0) -> DataFrame:
    """Whole contexts in order while they fit, the first in any case; two characters stand between them."""
    order = _query().orderBy("rank")
    place = F.row_number().over(order)
    size = F.length("text") + F.when(F.col("place") > 1, 2).otherwise(0)
    c = contexts.withColumn("place", place).withColumn("size", size)
    c = c.withColumn("used", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return c.where((F.col("used") <= budget - prefix) | (F.col("place") == 1)).drop("size")


def combined(packed_contexts: DataFrame, note: Column | None = None) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text), "\n\n")
    return packed_contexts.groupBy("query_id").agg((text if note is None else F.concat(note, text)).alias("context"))


def not_found_note(pasal: Column) -> Column:
    return F.concat(F.lit("Pasal "), pasal.cast("string"), F.lit(" tidak ditemukan; berikut ketentuan yang paling relevan.\n"))


def validation_note(asked_pasal: Column, asked_ayat: Column, got_pasal: Column, got_ayat: Column) -> Column:
    """What a citation says about an article or paragraph that isn't the one asked for; '-' where nothing is."""
    t = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    s = lambda c: c.cast("string")
    same = s(got_pasal) == s(asked_pasal)
    ayat = t("Anda menyebut ayat (", s(asked_ayat), "), namun ayat yang relevan pada Pasal ", s(got_pasal), " adalah ayat (", s(got_ayat), ").")
    pasal = t("Anda menyebut Pasal ", s(asked_pasal), ", namun berdasarkan pencarian di knowledge base, pasal yang paling relevan dengan pertanyaan Anda adalah Pasal ", s(got_pasal), ".")
    return F.when(asked_pasal.isNull() | got_pasal.isNull(), "-").when(~same, pasal).when(asked_ayat.isNotNull() & got_ayat.isNotNull() & (s(asked_ayat) != s(got_ayat)), ayat).otherwise("-")


def reconciled(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """citations: query_id, position, name, and asked_pasal and asked_ayat. Article, paragraph and note come from the context at the same position."""
    at = contexts.withColumn("position", F.row_number().over(_query().orderBy("rank")) - 1).select("query_id", "position", F.col("article").alias("pasal"), "ayat")
    out = citations.select("query_id", "position", "name", "asked_pasal", "asked_ayat").join(at, ["query_id", "position"], "left")
    return out.withColumn("note", validation_note(F.col("asked_pasal"), F.col("asked_ayat"), F.col("pasal"), F.col("ayat"))).drop("asked_pasal", "asked_ayat")


def is_thin(text: Column) -> Column:
    return (F.length(strip(text)) < 300) | (F.regexp_count(F.lower(text), F.lit("pasal")) < 2)


def fallback(asked: Column, any_hits: Column) -> Column:
    """The message where no context is left."""
    return F.when(asked.isNotNull(), F.concat(F.lit("Pasal "), asked.cast("string"), F.lit(" tidak ditemukan."))).when(any_hits, "Konteks kurang meyakinkan.").otherwise("Tidak ada konteks.")
