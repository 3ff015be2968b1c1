"""Text repair and counting as column expressions.

Every function takes and returns columns, so a chain of them stays in one projection. NFC has no built-in and is
the one Arrow UDF here.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regtext.sources.tables import fresh
from pyspark.sql import types as T

# Characters that page extraction leaves behind, and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "…": "..."}
SINGLES = {" ": " ", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
INVISIBLE = "​‌‍﻿­"

# White space at the ends of texts and lines.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Noise of optical recognition, in order: pattern and replacement.
NOISE = [
    (r"(?<=[A-Za-z])1(?=[A-Za-z])", "l"),
    (r"(?<=[A-Za-z])\|(?=[A-Za-z])", "I"),
    (r"\.{3,}", "..."),
    (r",{2,}", ","),
    (r";{2,}", ";"),
    (r"[�□■●]", ""),
    (r"[^\x09\x0A\x0D\x20-\x7E\u0080-ɏ]", ""),
]

# Lines that hold a page number only; starts of structural lines.
PAGE_NUMBER = r"(?i)^\s*(-\s*\d+\s*-|\d+|Halaman\s+\d+|Page\s+\d+)\s*$"
STRUCTURE = r"(?i)^\s*(?:BAB\s|Pasal\s|\(\d+\)|[a-z]\.\s|Menimbang|Mengingat|MEMUTUSKAN|PENJELASAN|Bagian\s|Paragraf\s|\d+\.\s)"
PAGE_MARKER = r"(?i)---\s*PAGE\s*\d+\s*---"

_SPACED = r"(?<=\b[A-Za-z] [A-Za-z]) (?=[A-Za-z]\b)|(?<=\b[A-Za-z]) (?=[A-Za-z] [A-Za-z]\b)"
_SPACED_RUN = r"\b[A-Za-z](?: [A-Za-z]){2,}\b"
_DOUBLED = r"(?i)\b([A-Za-z]{2,}+)-\n(\1)\b"
# a match starts at a word's first letter or where the last match ended, so long words are read once
_BROKEN = r"(?:\G|(?<![A-Za-z]))([A-Za-z]{2,}+)-\n([a-z])"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACE))


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def fix_artifacts(text: Column) -> Column:
    out = F.translate(text, "".join(SINGLES), "".join(SINGLES.values()))
    for bad, good in LIGATURES.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.replace(out, F.lit("­"), F.lit(""))


def normalise_space(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n", -1), lambda line: strip(F.regexp_replace(line, r"[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def drop_page_numbers(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(PAGE_NUMBER)), "\n")


def drop_page_markers(text: Column) -> Column:
    return F.regexp_replace(text, PAGE_MARKER, "")


def join_hyphens(text: Column) -> tuple[Column, Column]:
    """Text with words joined that a line end had cut, and how many. Doubled words keep their hyphen; a half has two letters at least, and the next one begins small."""
    doubled = F.regexp_replace(text, _DOUBLED, "$1-$2")
    return F.regexp_replace(doubled, _BROKEN, "$1$2"), F.regexp_count(text, F.lit(_DOUBLED)) + F.regexp_count(doubled, F.lit(_BROKEN))


def close_spaced(text: Column) -> tuple[Column, Column]:
    """Runs of three or more single letters between blanks become words."""
    return F.regexp_replace(text, _SPACED, ""), F.regexp_count(text, F.lit(_SPACED_RUN))


#: What a text has to hold for each rule to have work (by a plain search; None: the pattern itself says so).
_NOISE_NEEDS = ["1", "|", "...", ",,", ";;", None, None]
#: Whether any rule for noise has work: most texts have none.
_ANY_NOISE = "|".join(p for p, _ in NOISE)


def drop_noise(text: Column) -> tuple[Column, Column]:
    count, out = F.lit(0), text
    for pattern, good in NOISE:
        count = count + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, good)
    noisy = text.rlike(_ANY_NOISE)
    return F.when(noisy, out).otherwise(text), F.when(noisy, count).otherwise(F.when(text.isNotNull(), 0))


def joins(line: Column, following: Column, fixed: bool = False) -> Column:
    """Whether a line and the next one are halves of a wrapped line. fixed: a header of an article never is the first half."""
    a, b = F.rtrim(line, F.lit(SPACE)), F.ltrim(following, F.lit(SPACE))
    closed = a.rlike(r"[.?:!]$")
    out = (a != "") & (b != "") & ~b.rlike(STRUCTURE) & ((a.rlike(r"[A-Za-z0-9,;(\[-]$") & ~closed) | (closed & b.rlike("^[a-z0-9]")))
    if fixed:
        out = out & ~a.rlike(r"(?i)^\s*(Pasal\s+\d+[A-Za-z]?|BAB\s+\S+)\s*$")
    return F.coalesce(out, F.lit(False))


def once(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_wrapped(text: Column, fixed: bool = False) -> Column:
    """The same over a whole text, as a struct of text and count: whether two lines join depends on these two only."""

    def put(x: Column) -> Column:
        lines, marks = x["lines"], x["marks"]
        ends = F.transform(F.arrays_zip(lines.alias("line"), marks.alias("m")), lambda z, i: F.concat(
            F.when(i == 0, F.lit("")).when(z["m"] == 1, F.lit(" ")).otherwise(F.lit("\n")),
            F.when(F.coalesce(F.get(marks, i + 1), F.lit(0)) == 1, F.rtrim(F.when(z["m"] == 1, F.ltrim(z["line"], F.lit(SPACE))).otherwise(z["line"]), F.lit(SPACE))).otherwise(F.when(z["m"] == 1, F.ltrim(z["line"], F.lit(SPACE))).otherwise(z["line"])),
        ))
        return F.struct(F.array_join(ends, "").alias("text"), F.aggregate(marks, F.lit(0), lambda a, m: a + m).alias("n"))

    pairs = lambda lines: F.zip_with(F.concat(F.array(F.lit("")), F.slice(lines, F.lit(1), F.size(lines) - 1)), lines, lambda a, b: F.when(joins(a, b, fixed), 1).otherwise(0))
    return once(F.split(text, "\n", -1), lambda lines: once(F.struct(lines.alias("lines"), pairs(lines).alias("marks")), put))


def repair(text: Column, fixed: bool = False) -> Column:
    """Struct of the repaired text, the four counters, their sum and a flag."""
    pair = lambda f: lambda x: F.struct(f(x)[0].alias("text"), f(x)[1].alias("n"))

    def finish(h: Column, s: Column, o: Column) -> Column:
        def done(j: Column) -> Column:
            total = h["n"] + s["n"] + o["n"] + j["n"]
            return F.struct(j["text"].alias("text"), h["n"].alias("hyphens"), s["n"].alias("spaced"), o["n"].alias("noise"), j["n"].alias("joined"), total.alias("total"), (total > 0).alias("was_repaired"))

        return once(join_wrapped(o["text"], fixed), done)

    def noise(x: Column) -> Column:
        """drop_noise with each stage worked out once."""
        out = F.struct(x.alias("text"), F.lit(0).alias("n"))
        for pattern, good in NOISE:
            out = once(out, step(pattern, good))
        return out

    def step(pattern: str, good: str):
        return lambda v: F.struct(F.regexp_replace(v["text"], pattern, good).alias("text"), (v["n"] + F.regexp_count(v["text"], F.lit(pattern))).alias("n"))

    return once(once(text, pair(join_hyphens)), lambda h: once(once(h["text"], pair(close_spaced)), lambda s: once(noise(s["text"]), lambda o: finish(h, s, o))))


def repaired(rows: DataFrame, column: str = "text", fixed: bool = False) -> DataFrame:
    """rows with the struct of repair() of a column as r. Each stage is a projection of its own, so its text is worked out once and in generated code."""
    own = {c: fresh(rows.columns, f"repair_{c}") for c in ("t", "n", "hit", "hyphens", "spaced", "noisy", "noise", "j")}
    col = {c: F.col(name) for c, name in own.items()}
    n, t = col["n"], col["t"]
    out = rows.withColumn(own["t"], F.col(column))

    def stage(df: DataFrame, pattern: str, good: str, counted: str | None = None, only: Column | None = None) -> DataFrame:
        hit = t.rlike(counted or pattern) if only is None else only & t.rlike(counted or pattern)
        marked = df.withColumn(own["hit"], hit)
        return marked.withColumns({own["n"]: n + F.when(col["hit"], F.regexp_count(t, F.lit(counted or pattern))).otherwise(0), own["t"]: F.when(col["hit"], F.regexp_replace(t, pattern, good)).otherwise(t)})

    zero = lambda df: df.withColumn(own["n"], F.when(t.isNotNull(), 0))
    broken = t.contains("-\n")
    out = stage(stage(zero(out), _DOUBLED, "$1-$2", only=broken), _BROKEN, "$1$2", only=broken).withColumn(own["hyphens"], n)
    out = stage(zero(out), _SPACED, "", _SPACED_RUN).withColumn(own["spaced"], n)
    # most texts hold nothing odd, which plain searches and one class of characters tell
    out = zero(out).withColumn(own["noisy"], t.rlike(NOISE[-1][0]))
    for (pattern, good), need in zip(NOISE, _NOISE_NEEDS, strict=True):
        out = stage(out, pattern, good, only=col["noisy"] if need is None else t.contains(need))
    out = out.withColumn(own["noise"], n).withColumn(own["j"], join_wrapped(t, fixed))
    joined = F.col(f"{own['j']}.n")
    total = col["hyphens"] + col["spaced"] + col["noise"] + joined
    r = F.struct(F.col(f"{own['j']}.text").alias("text"), col["hyphens"].alias("hyphens"), col["spaced"].alias("spaced"), col["noise"].alias("noise"), joined.alias("joined"), total.alias("total"), (total > 0).alias("was_repaired"))
    return out.withColumn("r", r).select(*(c for c in rows.columns if c != "r"), "r")


def clean_page(text: Column, fixed: bool = False) -> Column:
    """The chain for one page. In the compatible order lines are repaired before page numbers go."""
    text = fix_artifacts(strip_invisible(nfc(text)))
    if fixed:
        text = drop_page_numbers(text)
    return normalise_space(drop_page_numbers(repair(text, fixed)["text"]))


def cleaned_pages(rows: DataFrame, column: str = "text", fixed: bool = False) -> DataFrame:
    """rows with clean_page() of a column as clean, in projections of their own as repaired() does it."""
    own = fresh([*rows.columns, "r", "clean"], "page")
    text = fix_artifacts(strip_invisible(nfc(F.col(column))))
    out = repaired(rows.withColumn(own, drop_page_numbers(text) if fixed else text), own, fixed)
    return out.withColumn("clean", normalise_space(drop_page_numbers(F.col("r.text")))).select(*(c for c in rows.columns if c != "clean"), "clean")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def escape_html(text: Column) -> Column:
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def cut(text: Column, size: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(mark))).otherwise(text)


# Signal words of article types, in order of precedence, and general tags.
TYPES = [
    ("definisi", ["adalah", "dimaksud dengan", "yang dimaksud"]),
    ("sanksi", ["pidana", "denda", "penjara", "kurungan"]),
    ("kewajiban_larangan", ["dilarang", "tidak boleh", "wajib"]),
    ("peralihan", ["ketentuan peralihan", "mulai berlaku"]),
]
DUTIES = [("kewajiban", ["wajib"]), ("larangan", ["dilarang", "tidak boleh"]), ("perizinan", ["izin"])]
TERM = r"([A-Z][a-zA-Z\s]+)\s+adalah"
TAGS = ["prosedur", "tata cara", "persyaratan", "hak", "kewenangan"]


def _any(lower: Column, signals: list[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | lower.contains(s)
    return out


def article_type(text: Column) -> Column:
    def named(lower: Column) -> Column:
        out = None
        for name, signals in TYPES:
            out = F.when(_any(lower, signals), name) if out is None else out.when(_any(lower, signals), name)
        return out.otherwise("umum")

    return once(F.lower(text), named)


def keywords(text: Column, kind: Column) -> Column:
    """Sorted distinct tags of an article of a kind."""
    tag = lambda condition, name: F.when(condition, F.lit(name))
    # a term is within a stretch of letters and blanks; only those that define one are searched
    stretches = F.array_join(F.filter(F.split(text, r"[^a-zA-Z\s]+"), lambda x: x.contains("adalah")), ".")

    def tagged(low: Column, kind: Column) -> Column:
        sanctions = F.array(*(tag((kind == "sanksi") & low.contains(k), k) for k in TYPES[1][1]))
        duty = F.array(*(tag((kind == "kewajiban_larangan") & _any(low, signals), name) for name, signals in DUTIES))
        terms = F.when(kind == "definisi", F.concat(F.array(F.lit("definisi")), F.transform(F.slice(F.regexp_extract_all(stretches, F.lit(TERM), 1), 1, 3), lambda t: F.lower(strip(t))))).otherwise(F.array())
        tags = F.array(*(tag(low.contains(k), k) for k in TAGS))
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(sanctions, duty, terms, tags))))

    return once(F.struct(F.lower(text).alias("low"), kind.alias("kind")), lambda x: tagged(x["low"], x["kind"]))
