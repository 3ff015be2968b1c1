"""Structure of statutes from their lines: chapters, articles, paragraphs, points, preamble, notes, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regtext.functions.text import SPACE, once, strip

# Patterns of structural lines.
CHAPTER = r"(?i)^\s*BAB\s+([IVXLCDM]+|\d+)(?:\s+(.+))?$"
ARTICLE = r"(?i)^\s*Pasal\s+(\d+[A-Za-z]?)\s*$"
PARAGRAPH = r"(?d)^\s*\((\d+)\)\s+(.+)$"
POINT = r"(?d)^\s*([a-z])\.\s+(.+)$"
PART = r"(?i)^\s*Bagian\s+(Kesatu|Kedua|Ketiga|Keempat|Kelima|Keenam|Ketujuh|Kedelapan|Kesembilan|Kesepuluh|Pertama|[IVXLCDM]+|\d+)\b"
LAW = r"(?i)(UNDANG-UNDANG|PERATURAN PEMERINTAH|PERATURAN PRESIDEN|PERATURAN MENTERI)(?:\s+REPUBLIK INDONESIA)?\s+NOMOR\s+(\d+)\s+TAHUN\s+(\d{4})"
ABOUT = r"(?i)TENTANG\s+(.+?)(?:\n|$)"


def _doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def classify(line: Column) -> Column:
    """Struct of level (bab, pasal, ayat, bagian, other), number and title."""
    s = strip(line)
    row = lambda level, number, title: F.struct(F.lit(level).alias("level"), number.cast("string").alias("number"), title.cast("string").alias("title"))
    article, paragraph = F.regexp_extract(s, ARTICLE, 1), F.regexp_extract(s, r"^\s*\((\d+)\)\s+", 1)
    return (
        F.when(s.rlike(CHAPTER), row("bab", F.regexp_extract(s, CHAPTER, 1), F.coalesce(F.regexp_extract(s, CHAPTER, 2), F.lit(""))))
        .when(s.rlike(ARTICLE), row("pasal", article, F.concat(F.lit("Pasal "), article)))
        .when(s.rlike(r"^\s*\((\d+)\)\s+"), row("ayat", paragraph, F.concat(F.lit("("), paragraph, F.lit(")"))))
        .when(s.rlike(PART), row("bagian", F.regexp_extract(s, PART, 1), s))
        .otherwise(row("other", F.lit(None), F.lit(None)))
    )


def title_case(text: Column) -> Column:
    """Capital after anything but a letter."""
    return F.array_join(F.transform(F.split(F.lower(text), "-"), F.initcap), "-")


def law_metadata(text: Column) -> Column:
    """Struct of jenis, nomor, tahun, tentang from a document's opening; null where nothing is found."""
    head = F.left(text, F.lit(3000))
    got = lambda pattern, i: F.nullif(F.regexp_extract(head, pattern, i), F.lit(""))
    return F.struct(title_case(got(LAW, 1)).alias("jenis"), got(LAW, 2).alias("nomor"), got(LAW, 3).alias("tahun"), title_case(strip(got(ABOUT, 1))).alias("tentang"))


def source_label(meta: Column, filename: Column) -> Column:
    name = F.replace(F.regexp_replace(filename, r"(?i)\.pdf$", ""), F.lit("_"), F.lit(" "))
    label = F.concat(F.coalesce(meta["jenis"], F.lit("UU")), F.lit(" No "), meta["nomor"], F.lit(" Tahun "), meta["tahun"])
    return F.coalesce(label, name)


def chapters_and_articles(lines: DataFrame) -> DataFrame:
    """Every line with its class, the chapter and article it stands in, and the article's ordinal (as-of within the document)."""
    c = lines.withColumn("c", classify(F.col("line"))).select("doc_id", "pos", "line", "c.level", "c.number", "c.title")
    follows = F.lead("level").over(_doc())
    inline = F.nullif(F.col("title"), F.lit(""))
    own = F.when(F.col("level") == "bab", F.coalesce(inline, F.when(follows == "other", strip(F.lead("line").over(_doc()))), F.lit("")))
    c = c.withColumn("chapter_title", own)
    filled = lambda column, level: F.last(F.when(F.col("level") == level, F.col(column)), True).over(_so_far())
    return c.select("doc_id", "pos", "line", "level", "number", filled("number", "bab").alias("bab_number"), F.last("chapter_title", True).over(_so_far()).alias("bab_title"), filled("number", "pasal").alias("pasal_number"), F.sum(F.when(F.col("level") == "pasal", 1).otherwise(0)).over(_so_far()).alias("pasal_seq"))


def chapters(lines: DataFrame) -> DataFrame:
    """One row per chapter with the range and number of its articles."""
    at = chapters_and_articles(lines).withColumn("bab_seq", F.sum(F.when(F.col("level") == "bab", 1).otherwise(0)).over(_so_far())).where("bab_seq > 0")
    first = lambda c: F.min_by(c, "pos")
    return at.groupBy("doc_id", "bab_seq").agg(first("bab_number").alias("number"), first("bab_title").alias("title"), F.min("pos").alias("pos"), F.min(F.when(F.col("level") == "pasal", F.col("pasal_seq"))).alias("pasal_start"), F.max(F.when(F.col("level") == "pasal", F.col("pasal_seq"))).alias("pasal_end"), F.count(F.when(F.col("level") == "pasal", 1)).alias("pasal_count"))


def articles(lines: DataFrame) -> DataFrame:
    """One row per article: number, chapter, text (all its lines), char_start, n_ayat."""
    before = F.sum(F.length("line") + 1).over(_doc().rowsBetween(Window.unboundedPreceding, -1))
    at = chapters_and_articles(lines).withColumn("char_start", F.coalesce(before, F.lit(0)).cast("long"))
    body = at.where("pasal_seq > 0 and level <> 'bab'")
    first = lambda c: F.min_by(c, "pos")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    return body.groupBy("doc_id", "pasal_seq").agg(first("pasal_number").alias("pasal_number"), first("bab_number").alias("bab_number"), first("bab_title").alias("bab_title"), text.alias("text"), first("char_start").alias("char_start"), F.count(F.when(F.col("level") == "ayat", 1)).alias("n_ayat"))


def paragraphs(articles: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per paragraph: ayat_number (null: the article has no numbered ones), text, points; keep: further columns of the articles."""
    keys = ["doc_id", "pasal_seq", "pasal_number"]
    lines = articles.select(*keys, *keep, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(~F.col("line").rlike(ARTICLE) & (strip("line") != ""))
    w = Window.partitionBy(*keys).orderBy("pos")
    number = F.nullif(F.regexp_extract("line", PARAGRAPH, 1), F.lit(""))
    at = lines.withColumn("ayat_number", F.last(number.try_cast("int"), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("seq", F.sum(F.when(number.isNull(), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    most = F.max("seq").over(Window.partitionBy(*keys))
    kept = at.withColumn("most", most).where("seq > 0 or most = 0")
    body = F.when(number.isNotNull(), F.regexp_extract("line", PARAGRAPH, 2)).otherwise(strip("line"))
    listed = F.array_sort(F.collect_list(F.struct("pos", body.alias("line"))))
    out = kept.groupBy(*keys, "seq").agg(F.max("ayat_number").alias("ayat_number"), F.transform(listed, lambda x: x.line).alias("l"), *(F.first(c).alias(c) for c in keep))
    return out.select(*keys, *keep, "seq", "ayat_number", F.array_join("l", "\n").alias("text"), points(F.col("l")).alias("points"))


def points(lines: Column) -> Column:
    """Array of (huruf, text) from an array of lines; following lines continue a point."""
    empty = F.array().cast("array<struct<huruf:string,text:string>>")

    def step(acc: Column, line: Column) -> Column:
        new = F.struct(F.regexp_extract(line, POINT, 1).alias("huruf"), strip(F.regexp_extract(line, POINT, 2)).alias("text"))
        last = F.element_at(acc, -1)
        more = F.struct(last["huruf"].alias("huruf"), F.concat_ws(" ", last["text"], strip(line)).alias("text"))
        return F.when(line.rlike(POINT), F.concat(acc, F.array(new))).when(F.size(acc) > 0, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(acc)

    return F.when(F.size(lines) > 0, F.aggregate(lines, empty, step)).otherwise(empty)


def article_title(text: Column, number: Column) -> Column:
    """'Pasal n - ' and the first useful line, cut to 60 characters."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: (x != "") & ~x.rlike(ARTICLE))
    first = F.filter(lines, lambda x: x.rlike(PARAGRAPH) | ((F.length(x) < 80) & ~x.rlike(POINT)))
    picked = F.get(first, F.lit(0))
    useful = F.when(picked.rlike(PARAGRAPH), F.regexp_extract(picked, PARAGRAPH, 2)).otherwise(picked)
    head = F.concat(F.lit("Pasal "), number)
    return F.when(useful.isNull(), head).otherwise(F.concat(head, F.lit(" - "), F.rtrim(F.left(useful, F.lit(60)))))


def preamble(lines: DataFrame) -> DataFrame:
    """doc_id, menimbang (points), mengingat, full_text of the lines before the body."""
    s = lines.withColumn("line", strip("line")).where("line <> ''")
    opens = F.when(F.col("line").rlike(r"(?i)^Menimbang\b"), "menimbang").when(F.col("line").rlike(r"(?i)^Mengingat\b"), "mengingat")
    at = s.withColumn("opens", opens).withColumn("zone", F.last("opens", True).over(_so_far()))
    inside = lambda zone: F.transform(F.array_sort(F.collect_list(F.when((F.col("zone") == zone) & F.col("opens").isNull(), F.struct("pos", "line")))), lambda x: x.line)
    out = at.groupBy("doc_id").agg(inside("menimbang").alias("a"), inside("mengingat").alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("full_text"))
    return out.select("doc_id", points(F.col("a")).alias("menimbang"), F.array_join("b", " ").alias("mengingat"), "full_text")


def split_notes(text: Column) -> Column:
    """Array of (pasal, text): what stands between mentions of articles; empty stretches are left out."""
    mention = r"(?i)\bPasal\s+(\d+[A-Za-z]*)\b"
    numbers = F.regexp_extract_all(text, F.lit(mention), 1)
    # the text is cut once: a split inside the lambda would be worked out again for every mention
    pairs = once(F.split(text, mention, -1), lambda between: F.transform(numbers, lambda n, i: F.struct(n.alias("pasal"), strip(F.get(between, i + 1)).alias("text"))))
    return F.filter(pairs, lambda p: p["text"] != "")


def slice_articles(text: Column, starts: Column) -> Column:
    """Articles cut from a text by their offsets (for documents that come without parsed articles)."""
    return F.transform(starts, lambda s, i: text.substr(s.cast("int") + 1, (F.coalesce(F.get(starts, i + 1), F.length(text).cast("long")) - s).cast("int")))


def as_of_chapters(heads: DataFrame) -> DataFrame:
    """heads: doc_id, start, kind ('bab' or 'pasal'), number. Every article with the latest chapter before it."""
    w = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return heads.withColumn("bab_number", F.last(F.when(F.col("kind") == "bab", F.col("number")), True).over(w)).where("kind = 'pasal'").select("doc_id", "start", F.col("number").alias("pasal_number"), "bab_number")


# Patterns of the parser of whole texts.
OPENING = r"(?i)MEMUTUSKAN\s*:|MENETAPKAN\s*:|\bBAB\s+I\b|\bPasal\s+1\b"
MENTION = r"(?i)\bPasal\s+(\d+[A-Za-z]*)"
LETTER = r"(?s)(?:^|[\s,\"]+)([a-z])[.)]\s+(.*?)(?=[\s,\"]+[a-z][.)]|$)"


def whole_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per article of texts that are not cut into lines: doc_id, seq, pasal, bab (the last chapter before it), text without its own header.

    The body begins with the decree or the first chapter or article; each mention of an article begins one, and what
    follows PENJELASAN is cut off.
    """
    plain = F.replace(F.regexp_replace(text, r"--- PAGE \d+ ---", ""), F.lit("\\"), F.lit(""))
    opening = F.regexp_substr("plain", F.lit(OPENING))
    start = F.when(opening.isNull(), F.lit(1)).otherwise(F.instr("plain", F.regexp_substr("plain", F.lit(OPENING))))
    body = docs.select("doc_id", plain.alias("plain")).withColumn("body", F.col("plain").substr(start, F.length("plain")))
    cut = F.split("body", MENTION, -1)
    rows = body.select("doc_id", F.regexp_extract_all("body", F.lit(MENTION), 1).alias("numbers"), cut.alias("parts"))
    chapters = lambda c: F.regexp_extract_all(c, F.lit(r"(?i)\bBAB\s+([IVXLCDM]+)"), 1)
    # the chapters that each stretch before an article names, filled forward over the articles
    at = rows.select("doc_id", F.posexplode(F.transform("numbers", lambda n, i: F.struct(n.alias("pasal"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), chapters(F.get("parts", i))), -1).alias("bab"), F.get("parts", i + 1).alias("text")))).alias("seq", "x"))
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    text_of = strip(F.substring_index(F.col("x.text"), "PENJELASAN", 1))
    return at.select("doc_id", "seq", "x.pasal", F.coalesce(F.last("x.bab", True).over(w), F.lit("N/A")).alias("bab"), text_of.alias("text"))


def numbered_parts(articles: DataFrame) -> DataFrame:
    """One row per paragraph of articles (doc_id, seq, pasal, text): ayat ('1' where none is numbered), text, and points by letter with a dot or bracket."""
    numbers = F.regexp_extract_all("text", F.lit(r"\((\d+)\)"), 1)
    parts = F.split("text", r"(?=\(\d+\))", -1)
    some = F.zip_with(numbers, F.filter(parts, lambda p: p.rlike(r"^\(\d+\)")), lambda n, p: F.struct(n.alias("ayat"), strip(p).alias("text")))
    listed = F.when(F.size(numbers) > 0, some).otherwise(F.array(F.struct(F.lit("1").alias("ayat"), F.col("text").alias("text"))))
    rows = articles.select("doc_id", "seq", "pasal", F.posexplode(listed).alias("place", "a")).select("doc_id", "seq", "pasal", "place", "a.ayat", "a.text")
    letters, texts = F.regexp_extract_all("text", F.lit(LETTER), 1), F.regexp_extract_all("text", F.lit(LETTER), 2)
    return rows.withColumn("points", F.zip_with(letters, texts, lambda h, t: F.struct(h.alias("huruf"), strip(F.regexp_replace(t, r"\s+", " ")).alias("text"))))


# Patterns and defaults of whole laws.
LAW_TITLE = r"(?id)(UNDANG[- ]UNDANG|PERATURAN BERSAMA|PERATURAN MENTERI).*?NOMOR[:\s]+(\d+)\s+TAHUN\s+(\d{4})"
LAW_ABOUT = r"(?is)TENTANG\s+(.*?)(?=\nDENGAN|\n\s*DENGAN|\nMenimbang|\nMengingat|bahwa|MEMUTUSKAN)"
LAW_NOTES = r"(?is)PENJELASAN\s+ATAS.*"
LAW_HEADER = r"(?i)\bPasal\s+\d+[A-Za-z]*|\bBAB\s+[IVXLCDM]+"
LAW_KIND, LAW_NUMBER, LAW_YEAR = "UNDANG-UNDANG", "1", "2024"
LAW_ABOUT_DEFAULT = "PERUBAHAN KEDUA ATAS UNDANG-UNDANG NOMOR 11 TAHUN 2008 TENTANG INFORMASI DAN TRANSAKSI ELEKTRONIK"


def _plain(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"--- PAGE \d+ ---", ""), F.lit("\\"), F.lit(""))


def _body_start(plain: Column) -> Column:
    """Where the body begins, from 1: the decree, the first chapter or the first article; the text's start without any."""
    found = F.regexp_substr(plain, F.lit(OPENING))
    return F.when(found.isNull(), F.lit(1)).otherwise(F.instr(plain, found))


def law_heads(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per law that comes as one text: kind, number, year and id (defaults where the first 1000 characters name none), title, opening and notes."""
    plain = docs.select("doc_id", _plain(F.coalesce(F.col(text), F.lit(""))).alias("plain"))
    top = F.left("plain", F.lit(1000))
    named = top.rlike(LAW_TITLE)
    got = lambda i, default: F.when(named, F.regexp_extract(top, LAW_TITLE, i)).otherwise(default)
    number, year = got(2, LAW_NUMBER), got(3, LAW_YEAR)
    title = F.when(F.col("plain").rlike(LAW_ABOUT), strip(F.regexp_replace(F.regexp_extract("plain", LAW_ABOUT, 1), r"\s+", " "))).otherwise(LAW_ABOUT_DEFAULT)
    opening = F.left("plain", _body_start(F.col("plain")) - 1)
    return plain.select("doc_id", F.upper(strip(got(1, LAW_KIND))).alias("jenis"), number.alias("nomor"), year.alias("tahun"), F.concat(F.lit("UU_"), number, F.lit("_"), year).alias("uu_id"), title.alias("judul"), strip(opening).alias("pembukaan"), strip(F.coalesce(F.regexp_substr("plain", F.lit(LAW_NOTES)), F.lit(""))).alias("penjelasan"))


def law_headers(docs: DataFrame, text: str = "text") -> DataFrame:
    """The headers of chapters and articles in whole texts: doc_id, seq, kind, number, start (from 1 in the body), chapter and chapter_start (of the last chapter so far), article (how many so far), piece (the header and what follows it up to the next one)."""
    plain = docs.select("doc_id", _plain(F.coalesce(F.col(text), F.lit(""))).alias("plain"))
    body = plain.select("doc_id", F.col("plain").substr(_body_start(F.col("plain")), F.length("plain")).alias("body"))
    heads, between = F.regexp_extract_all("body", F.lit(LAW_HEADER), 0), F.split("body", LAW_HEADER, -1)
    first = F.length(F.get("between", F.lit(0)))
    cut = body.select("doc_id", heads.alias("heads"), between.alias("between")).withColumn("first", first)
    rows = cut.select("doc_id", "first", F.posexplode(F.zip_with("heads", F.slice("between", F.lit(2), F.greatest(F.size("heads"), F.lit(1))), lambda h, p: F.struct(h.alias("head"), F.concat(h, p).alias("piece")))).alias("seq", "x"))
    before = Window.partitionBy("doc_id").orderBy("seq")
    passed = F.sum(F.length("x.piece")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    article = F.lower(F.substring("x.head", 1, 1)) == "p"
    at = rows.select("doc_id", "seq", F.when(article, "pasal").otherwise("bab").alias("kind"), F.regexp_extract("x.head", r"\s(\S+)$", 1).alias("number"), (F.col("first") + passed - F.length("x.piece") + 1).cast("int").alias("start"), F.col("x.piece").alias("piece"))
    so_far = before.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("kind") == "bab", F.col(c)), True).over(so_far)
    return at.withColumns({"chapter": last("number"), "chapter_start": last("start"), "article": F.sum(F.when(F.col("kind") == "pasal", 1).otherwise(0)).over(so_far)})


#: Pieces of a chapter in which its title is looked for first.
LEAD = 8


def first_lines(text: Column) -> Column:
    """A text up to the end of its second line that isn't blank."""
    return F.regexp_extract(text, f"^(?:[{SPACE}]*+[^{SPACE}][^\n]*+\n?+){{0,2}}", 0)


def law_articles(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per article of whole laws: doc_id, seq (from 0), pasal, bab, bab_title, start (from 1, in the body) and text without its header.

    Each mention of an article begins one. Its chapter is the last one named before it; the title is the second line from there, or the first one, if
    that names an article; only what stands before the article counts. What follows PENJELASAN is cut off.
    """
    heads = law_headers(docs, text)
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x.piece), "")
    own = lambda c: F.max(F.when(F.col("kind") == "pasal", F.col(c))).alias(c)
    rows = heads.where("article > 0").groupBy("doc_id", "article").agg(own("number"), own("start"), own("chapter"), own("chapter_start"), joined().alias("own"))
    # a chapter's first pieces nearly always hold its first two lines; all of them are joined where they don't
    inside = heads.where("chapter_start is not null")
    place = F.row_number().over(Window.partitionBy("doc_id", "chapter_start").orderBy("seq"))
    lead = inside.withColumn("place", place).where(F.col("place") <= LEAD).groupBy("doc_id", "chapter_start").agg(joined().alias("lead"), F.max("place").alias("places"))
    useful = lambda c: F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")
    # articles meet the first two lines of their chapter and no more of it
    lead = lead.withColumn("open", (F.size(useful(F.col("lead"))) < 3) & (F.col("places") == LEAD)).withColumn("lead", first_lines(F.col("lead")))
    more = inside.join(lead.where("open").select("doc_id", "chapter_start"), ["doc_id", "chapter_start"], "left_semi").groupBy("doc_id", "chapter_start").agg(first_lines(joined()).alias("more"))
    rows = rows.join(lead.drop("places", "open"), ["doc_id", "chapter_start"], "left").join(more, ["doc_id", "chapter_start"], "left")
    lines = useful(F.left(F.coalesce("more", "lead"), F.col("start") - F.col("chapter_start")))
    second = F.get(lines, F.lit(1))
    title = F.when(F.lower(second).contains("pasal"), F.get(lines, F.lit(0))).otherwise(F.coalesce(second, F.lit("N/A")))
    title = F.when(F.col("chapter_start").isNull(), "N/A").otherwise(F.upper(title))
    body = strip(F.regexp_replace(strip(F.substring_index("own", "PENJELASAN", 1)), r"(?i)^Pasal\s+\d+[A-Za-z]*(?![\p{L}\p{N}_])", ""))
    return rows.select("doc_id", (F.col("article") - 1).cast("int").alias("seq"), F.col("number").alias("pasal"), F.coalesce("chapter", F.lit("N/A")).alias("bab"), title.alias("bab_title"), "start", body.alias("text"))
