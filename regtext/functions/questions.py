"""Understanding of questions as column expressions: references, doubt, disfluency, cleaning, detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regtext.functions.text import strip, token_count
from regtext.sources.tables import fresh

# Patterns and word lists of the question language.
DOUBT = r"(?i)\b(ragu|kurang\s*yakin|tidak\s*yakin|ga\s*yakin|nggak\s*yakin|gak\s*yakin|mungkin\s*salah|entah\s*pasal|lupa\s*pasal|tidak\s*ingat\s*pasal)\b"
FILLER = r"(?i)\b(?:hm+|e+m+|eh+|anu|apa\s*ya|gimana\s*ya)\b"
REFERENCES = r"(?i)(?:pasal|ps\.?)\s*(\d+(?:\s*(?:,\s*(?:dan|atau|serta|&|/)?|(?:dan|atau|serta|&|/))\s*\d+)*)"
PARAGRAPH = r"(?i)ayat\s*\(?(\d+)\)?"
POINT = r"(?i)huruf\s*\(?([a-zA-Z])\)?"
LEADING = r"(?i)^(apa|apakah|bagaimana|siapa|kapan|mengapa|kenapa|dimana|di mana|berapa|jelaskan|sebutkan|tolong|mohon|cari|temukan|bandingkan|analisis|ringkas)\s+"
CLEANING = [(FILLER, " "), (r"\.{2,}", " "), (r"\s+([,.;:!?])", "$1"), (r"\s+", " ")]
STARTERS = ["apa", "apakah", "bagaimana", "siapa", "kapan", "mengapa", "kenapa", "dimana", "di mana", "berapa", "jelaskan", "sebutkan", "tolong", "mohon", "cari", "temukan", "bandingkan", "analisis", "analisa", "ringkas", "saya ingin", "saya mau", "coba", "bisa", "boleh", "minta"]
LEGAL = ["pasal", "ayat", "huruf", "undang-undang", "peraturan", "pemerintah", "republik", "menimbang", "mengingat", "menetapkan", "memutuskan", "jo.", "uud", "pp", "perpres"]


def article_numbers(text: Column) -> Column:
    """All article numbers, also of lists such as 'Pasal 5, 8, dan 10'."""
    lists = F.regexp_extract_all(text, F.lit(REFERENCES), 1)
    return F.transform(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), 1))), lambda n: n.try_cast("long"))


def paragraph_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), 1), lambda n: n.try_cast("long"))


def has_doubt(text: Column) -> Column:
    return text.rlike(DOUBT)


def has_filler(text: Column) -> Column:
    return text.rlike(FILLER) | (F.regexp_count(text, F.lit(r"\.\.\.")) >= 3)


def without_filler(text: Column) -> Column:
    for pattern, good in CLEANING:
        text = F.regexp_replace(text, pattern, good)
    return F.regexp_replace(strip(text), r"^[,.\s]+", "")


def is_ambiguous(text: Column) -> Column:
    return F.size(F.array_distinct(article_numbers(text))) > 1


def article_number(text: Column) -> Column:
    """The number, if there is exactly one distinct one."""
    distinct = F.array_distinct(article_numbers(text))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def paragraph_number(text: Column) -> Column:
    return F.get(paragraph_numbers(text), F.lit(0))


def point_letter(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, POINT, 1)), F.lit(""))


def search_query(text: Column, limit: int = 300) -> Column:
    out = F.regexp_replace(F.regexp_replace(strip(text), r"\?+$", ""), LEADING, "")
    out = F.regexp_replace(strip(out), r"\s+", " ")
    return F.when(F.length(out) > limit, F.regexp_replace(F.left(out, F.lit(limit)), " [^ ]*$", "")).otherwise(out)


def is_question(text: Column) -> Column:
    clean = strip(text)
    low = F.lower(clean)
    starts = low.rlike(f"^(?:{'|'.join(STARTERS)})")
    legal = F.lit(False)
    for k in LEGAL:
        legal = legal | low.contains(k)
    return clean.endswith("?") | starts | ((token_count(clean) < 20) & ~has_filler(clean) & ~legal)


def understand(text: Column) -> Column:
    """Struct of the repaired text, the query, the references, and whether the text is a question that passes as it stands.

    Texts with filler are cleaned. The references of a question are those of its cleaned text, of other texts
    those of the text; doubtful or ambiguous ones give none.
    """
    drop = has_doubt(text) | is_ambiguous(text)
    plain, none = strip(text), F.lit(None)
    empty, question = plain == "", is_question(text)
    repaired = F.when(has_filler(plain), without_filler(plain)).otherwise(plain)
    source = F.when(question, repaired).otherwise(text)
    return F.struct(
        F.when(empty, F.lit("")).otherwise(repaired).alias("repaired_text"),
        F.when(empty, F.lit("")).otherwise(search_query(repaired)).alias("search_query"),
        F.when(empty | drop, none).otherwise(article_number(source)).cast("long").alias("pasal"),
        F.when(empty | drop, none).otherwise(paragraph_number(source)).cast("long").alias("ayat"),
        F.when(empty, none).otherwise(point_letter(source)).cast("string").alias("huruf"),
        (~empty & question).alias("is_passthrough"),
    )


def mend(text: Column, candidate: Column) -> Column:
    """A model's repair, where it keeps the references and isn't much longer than the text; else the text without filler."""
    plain = strip(text)
    own = F.when(has_filler(plain), without_filler(plain)).otherwise(plain)
    return F.when(candidate.isNotNull() & ~is_question(text) & keeps_references(text, candidate), candidate).otherwise(own)


#: Answers of a model that are looked at.
TRIES = 3


def mended(rows: DataFrame, text_col: str, answers_col: str, tries: int = TRIES) -> DataFrame:
    """rows with a struct m: the text mended by the first of a model's answers (an array, null where one failed) that keeps the references, the attempts that took (all answers that were looked at, where none did), and the references of the mended text.

    Questions that pass as they stand need no answer. Doubtful or ambiguous texts give no article and paragraph. Each step is a projection of its own, so it is worked out once.
    """
    text = F.col(text_col)
    own = {c: fresh(rows.columns, f"mend_{c}") for c in ("tried", "at", "asks", "text")}
    tried = F.slice(F.coalesce(F.col(answers_col), F.array().cast("array<string>")), F.lit(1), F.lit(tries))
    good = F.transform(own["tried"], lambda c: F.coalesce(keeps_references(text, c), F.lit(False)))
    out = rows.withColumn(own["tried"], tried).withColumn(own["asks"], ~is_question(text) & (strip(text) != ""))
    out = out.withColumn(own["at"], F.when(F.col(own["asks"]), F.array_position(good, F.lit(True)).cast("int")).otherwise(0))
    plain = strip(text)
    without = F.when(has_filler(plain), without_filler(plain)).otherwise(plain)
    at, fixed = F.col(own["at"]), F.col(own["text"])
    out = out.withColumn(own["text"], F.when(at > 0, F.try_element_at(own["tried"], at)).otherwise(without))
    drop = has_doubt(text) | is_ambiguous(text)
    number = lambda c: F.when(~drop, c).cast("long")
    used = F.when(~F.col(own["asks"]), 0).when(at > 0, at).otherwise(F.size(own["tried"]))
    m = F.struct(fixed.alias("text"), used.alias("attempts"), number(article_number(fixed)).alias("pasal"), number(paragraph_number(fixed)).alias("ayat"))
    return out.withColumn("m", m).drop(*own.values())


def keeps_references(raw: Column, repaired: Column) -> Column:
    """Whether a model's repair keeps all references and isn't much longer than its input."""
    return (F.size(F.array_except(article_numbers(raw), article_numbers(repaired))) == 0) & (F.size(F.array_except(paragraph_numbers(raw), paragraph_numbers(repaired))) == 0) & (token_count(repaired) <= token_count(raw) * 2.5)


def missing_references(asked: Column, context: Column) -> Column:
    """Article numbers that a question names and a context doesn't, sorted."""
    return F.array_sort(F.array_except(article_numbers(asked), article_numbers(context)))


def single_mention(text: Column) -> Column:
    """The number, if an article is mentioned exactly once (a repeated mention counts twice)."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)pasal\s+(\d+)"), 1)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def capped(text: Column, limit: int = 1000) -> Column:
    """The longest text that a question may have."""
    return F.left(text, F.lit(limit))
