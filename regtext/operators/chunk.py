"""Parent and child chunks from parsed statutes. Chunk ids are unique in a document as long as its articles are; a note that is mentioned again repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regtext.functions.text import strip, token_count
from regtext.operators.parse import ARTICLE, article_title

PREAMBLE, BODY, NOTES = "Konsiderans", "Batang Tubuh", "Penjelasan"
COLUMNS = ["doc_id", "chunk_id", "type", "section", "parent_id", "title", "text", "pasal", "ayat", "huruf", "pasal_rujukan"]


def _chunk(kind: str, section: str, chunk_id: Column, text: Column, parent: Column | None = None, title: Column | None = None, pasal: Column | None = None, ayat: Column | None = None, huruf: Column | None = None, about: Column | None = None) -> list[Column]:
    none = F.lit(None)
    pick = lambda c, t: (none if c is None else c).cast(t)
    return ["doc_id", chunk_id.alias("chunk_id"), F.lit(kind).alias("type"), F.lit(section).alias("section"), pick(parent, "string").alias("parent_id"), pick(title, "string").alias("title"), text.alias("text"), pick(pasal, "int").alias("pasal"), pick(ayat, "int").alias("ayat"), pick(huruf, "string").alias("huruf"), pick(about, "int").alias("pasal_rujukan")]


def first_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def plain_title(title: Column, number: Column) -> Column:
    rest = strip(F.regexp_replace(title, r"(?i)^Pasal\s+\S+\s*-?\s*", ""))
    return F.when(rest == "", title).otherwise(rest)


def _rows(df: DataFrame, chunks: Column) -> DataFrame:
    """The chunks of an array, so that what they are made of is made once."""
    return df.select("doc_id", F.explode(chunks).alias("c")).select("doc_id", "c.*")


def titled(articles: DataFrame) -> DataFrame:
    """articles with their title; with it among the columns that paragraphs keep, children need no join."""
    return articles.withColumn("title", article_title(F.col("text"), F.col("pasal_number")))


def article_parents(articles: DataFrame) -> DataFrame:
    n = F.col("pasal_number")
    articles = articles if "title" in articles.columns else titled(articles)
    return articles.where(strip("text") != "").select(*_chunk("parent", BODY, F.concat(F.lit("parent_pasal_"), n), strip("text"), title=F.col("title"), pasal=first_int(n)))


def article_children(articles: DataFrame, paragraphs: DataFrame, child_text: str = "title") -> DataFrame:
    """Children of paragraphs and points. child_text 'title' names the article only, 'full' adds the paragraph's text."""
    keys = ["doc_id", "pasal_seq", "pasal_number"]
    p = paragraphs if "title" in paragraphs.columns else paragraphs.join(titled(articles).select(*keys, "title"), keys)
    n, a = F.col("pasal_number"), F.col("ayat_number")
    parent, base = F.concat(F.lit("parent_pasal_"), n), F.concat(F.lit("child_pasal_"), n)
    numbered = a.isNotNull()
    body = strip(F.regexp_replace(F.col("text"), ARTICLE, ""))
    label = F.concat(F.lit("Pasal "), n, F.lit(" Ayat ("), a.cast("string"), F.lit(")"))
    about = F.concat(label, F.lit(" mengenai "), plain_title(F.col("title"), n))
    about = about if child_text == "title" else F.concat(about, F.lit(": "), F.col("text"))
    one = lambda cid, text, huruf: F.struct(cid.alias("cid"), text.alias("body"), huruf.cast("string").alias("h"))
    none = F.lit(None)
    # one array of children for each paragraph, so the paragraphs are made once
    alone = F.array(one(F.concat(base, F.lit("_tunggal")), F.concat(F.lit("Pasal "), n, F.lit(": "), body), none))
    pointed = F.transform("points", lambda x: one(F.concat(base, F.lit("_poin_"), x["huruf"]), F.concat(F.lit("Pasal "), n, F.lit(" Poin "), x["huruf"], F.lit(": "), x["text"]), x["huruf"]))
    ayat = F.concat(base, F.lit("_ayat_"), a.cast("string"))
    letters = F.transform("points", lambda x: one(F.concat(ayat, F.lit("_huruf_"), x["huruf"]), F.concat(label, F.lit(" huruf "), x["huruf"], F.lit(": "), x["text"]), x["huruf"]))
    children = F.when(numbered, F.concat(F.array(one(ayat, about, none)), letters)).when(F.size("points") == 0, alone).otherwise(pointed)
    x = p.withColumn("x", F.explode(children))
    return x.select(*_chunk("child", BODY, F.col("x.cid"), F.col("x.body"), parent, pasal=first_int(n), ayat=a, huruf=F.col("x.h")))


def preamble_chunks(preambles: DataFrame) -> DataFrame:
    parent = F.lit("parent_konsiderans")
    some = preambles.where((F.size("menimbang") > 0) | (F.col("mengingat") != ""))
    one = lambda *a, **b: F.struct(*_chunk(*a, **b)[1:])
    own = one("parent", PREAMBLE, parent, F.col("full_text"), title=F.lit("Menimbang dan Mengingat"))
    points = F.transform("menimbang", lambda x: one("child", PREAMBLE, F.concat(F.lit("child_konsiderans_menimbang_"), x["huruf"]), F.concat(F.lit("Menimbang huruf "), x["huruf"], F.lit(": "), x["text"]), parent, huruf=x["huruf"]))
    view = one("child", PREAMBLE, F.lit("child_konsiderans_mengingat"), F.concat(F.lit("Mengingat: "), F.col("mengingat")), parent)
    return _rows(some, F.when(F.col("mengingat") != "", F.concat(F.array(own), points, F.array(view))).otherwise(F.concat(F.array(own), points)))


def note_chunks(notes: DataFrame) -> DataFrame:
    """notes: doc_id, text, parts (of split_notes). One pair for each article that is mentioned; one for the whole, where none is."""

    def pair(name: Column, title: Column, whole: Column, own: Column, about: Column | None = None) -> Column:
        parent = F.concat(F.lit("parent_penjelasan_"), name)
        child = _chunk("child", NOTES, F.concat(F.lit("child_penjelasan_"), name, F.lit("_isi")), own, parent, about=about)
        return F.array(F.struct(*_chunk("parent", NOTES, parent, whole, title=title, about=about)[1:]), F.struct(*child[1:]))

    def each(x: Column) -> Column:
        n, said = x["pasal"], strip(x["text"])
        heading = F.concat(F.lit("II. PASAL DEMI PASAL\nPasal "), n, F.lit("\n"), said)
        about = F.concat(F.lit("Tafsir Resmi Pasal "), n, F.lit(": "), said)
        return pair(F.concat(F.lit("pasal_"), n), F.concat(F.lit("Penjelasan Pasal "), n), heading, about, first_int(n))

    text = strip("text")
    whole = pair(F.lit("umum"), F.lit("Penjelasan Umum"), text, text)
    return _rows(notes, F.when(F.size("parts") > 0, F.flatten(F.transform("parts", each))).when((F.size("parts") == 0) & (text != ""), whole))


def level(section: Column, kind: Column, ayat: Column) -> Column:
    parent = kind == "parent"
    return F.when(section == PREAMBLE, F.when(parent, 0).otherwise(1)).when(section == BODY, F.when(parent | ayat.isNull(), 2).otherwise(3)).when(section == NOTES, F.when(parent, 2).otherwise(3)).otherwise(1)


def typed(chunks: DataFrame) -> DataFrame:
    """With level and number of words."""
    return chunks.withColumn("level", level(F.col("section"), F.col("type"), F.col("ayat"))).withColumn("tokens", token_count(F.col("text")))


def report(chunks: DataFrame) -> DataFrame:
    """Counts by section."""
    t = typed(chunks)
    return t.groupBy("section").agg(F.count_if(F.col("type") == "parent").alias("parents"), F.count_if(F.col("type") == "child").alias("children"), *(F.count_if(F.col("level") == k).alias(f"level_{k}") for k in range(4)), F.sum("tokens").alias("tokens"))


def split_long(chunks: DataFrame, limit: int, overlap: int = 0) -> DataFrame:
    """Optional: pieces of at most so many words, each beginning so many words before the last one's end."""
    step = max(1, limit - overlap)
    from regtext.functions.text import words

    w = chunks.withColumn("w", words(F.col("text")))
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - overlap, F.lit(0)), F.lit(step))
    return w.select("*", F.posexplode(at).alias("piece", "start")).withColumn("text", F.array_join(F.slice("w", F.col("start") + 1, F.lit(limit)), " ")).drop("w", "start")


# Sections in the order of a statute.
ORDER = {PREAMBLE: 0, BODY: 1, NOTES: 2}


def united(preambles: DataFrame, articles: DataFrame, paragraphs: DataFrame, notes: DataFrame, child_text: str = "title") -> DataFrame:
    """All chunks of documents, with the place of their section: preamble, body, notes."""
    all_of = preamble_chunks(preambles).unionByName(article_parents(articles)).unionByName(article_children(articles, paragraphs, child_text)).unionByName(note_chunks(notes))
    place = F.when(F.col("section") == PREAMBLE, 0).when(F.col("section") == BODY, 1).otherwise(2)
    return all_of.withColumn("section_place", place)


def filtered(chunks: DataFrame, section: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks of a section and type, the first so many in order (a listing's page); None filters nothing."""
    out = chunks if section is None else chunks.where(F.col("section") == section)
    out = out if kind is None else out.where(F.col("type") == kind)
    return out if limit is None else out.orderBy("doc_id", "chunk_id").limit(limit)


def section_names(chunks: DataFrame) -> DataFrame:
    return chunks.select("section").where("section is not null").distinct().orderBy("section")


def batch_totals(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over a batch: files that succeeded and failed (files: doc_id, status), and parents and children of the first."""
    good = files.where("status = 'success'").select("doc_id")
    t = chunks.join(good, "doc_id", "left_semi").agg(F.count_if(F.col("type") == "parent").alias("parents"), F.count_if(F.col("type") == "child").alias("children"))
    return files.agg(F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") != "success").alias("failed")).join(F.broadcast(t))
