"""Operators over the lines of documents: (doc_id, pos, line) tables, windowed within a document.

All windows share the partitioning by document, so one exchange serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regtext.functions.text import SPACE, drop_page_markers, joins, normalise_space, repaired, strip
from regtext.sources.tables import fresh


def _doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def is_running_title(line: Column) -> Column:
    """Whether a line can be a header or footer at all."""
    s = strip(line)
    short = (F.length(s) < 4) & s.rlike(r"\d")
    return (s != "") & ~s.rlike(r"[.,;:]$") & ~s.rlike(r"^\(?\d+\)?\.?$") & ~s.rlike(r"^\(?[a-zA-Z]\)?\.?$") & ~short


def drop_running_titles(lines: DataFrame, times: int = 3) -> DataFrame:
    """lines: doc_id, page, pos, line. Without headers that repeat in the first two non-blank lines of pages, and footers in the last two (counted behind the first two)."""
    page = Window.partitionBy("doc_id", "page")
    full = lines.where(strip("line") != "").select("doc_id", "page", "pos", strip("line").alias("title"))
    at = full.withColumn("first", F.row_number().over(page.orderBy("pos"))).withColumn("last", F.row_number().over(page.orderBy(F.desc("pos"))))
    edge = at.where("first <= 2 or last <= 2")
    often = edge.where(is_running_title(F.col("title"))).groupBy("doc_id", "title").agg(F.count_if(F.col("first") <= 2).alias("heads"), F.count_if(F.col("first") > 2).alias("feet")).where(f"heads >= {times} or feet >= {times}")
    gone = edge.join(often, ["doc_id", "title"]).where(f"(first <= 2 and heads >= {times}) or (last <= 2 and feet >= {times})").select("doc_id", "page", "pos")
    return lines.join(gone, ["doc_id", "page", "pos"], "left_anti")


def drop_frequent_lines(lines: DataFrame, times: int = 3) -> DataFrame:
    """Without any line that occurs so often in its document, wherever it stands; blank lines stay."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", strip("line")))
    return lines.withColumn("n", n).where((F.col("n") < times) | (strip("line") == "")).drop("n")


def join_wrapped_lines(lines: DataFrame, fixed: bool = False) -> DataFrame:
    """Wrapped lines as one: islands of lines that join their predecessor. doc_id, pos (of the first), line, parts."""
    joined = joins(F.lag("line").over(_doc()), F.col("line"), fixed)
    island = F.sum(F.when(joined, 0).otherwise(1)).over(_so_far())
    grouped = lines.withColumn("island", island).groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x, i: F.when(F.size("l") == 1, x.line).when(i == 0, F.rtrim(x.line, F.lit(SPACE))).when(i == F.size("l") - 1, F.ltrim(x.line, F.lit(SPACE))).otherwise(strip(x.line))), " ")
    return grouped.select("doc_id", F.element_at("l", 1).pos.alias("pos"), text.alias("line"), F.size("l").alias("parts"))


def join_pages(pages: DataFrame, times: int = 3) -> DataFrame:
    """pages: doc_id, page, text. The document's text without running titles and page markers, repaired once more."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    kept = drop_running_titles(lines, times).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "line"))).alias("l"))
    text = drop_page_markers(F.array_join(F.transform("l", lambda x: x.line), "\n"))
    fixed = repaired(kept.select("doc_id", text.alias("text")))
    return fixed.select("doc_id", normalise_space(F.col("r.text")).alias("text"), F.col("r.total").alias("repairs"))


# Lines that open a zone of a statute.
CONSIDERING, IN_VIEW, DECREE, NOTES, BODY = r"(?i)^\s*Menimbang\b", r"(?i)^\s*Mengingat\s*:", r"(?i)^\s*MEMUTUSKAN\s*:", r"(?i)^\s*PENJELASAN\b", r"(?i)^\s*(BAB\s+I\b|Pasal\s+\d+[A-Za-z]?\s*$)"


def zones(lines: DataFrame) -> DataFrame:
    """doc_id, considering, body, notes, n: where the zones of each document start (null: nowhere) and its number of lines."""
    line = F.col("line")
    mark = F.when(line.rlike(DECREE), F.col("pos")), F.when(line.rlike(BODY), F.col("pos"))
    some = F.min(F.coalesce(*mark)).over(_so_far())
    notes = F.when(line.rlike(NOTES) & some.isNotNull(), F.col("pos"))
    at = lines.select("doc_id", "pos", "line", mark[0].alias("decree"), mark[1].alias("start"), F.min(notes).over(Window.partitionBy("doc_id")).alias("notes"))
    before = F.col("notes").isNull() | (F.col("pos") < F.col("notes"))
    found = at.groupBy("doc_id").agg(F.min(F.when(F.col("line").rlike(CONSIDERING), F.col("pos"))).alias("considering"), F.max(F.when(before, F.col("decree"))).alias("decree"), F.min(F.when(before, F.col("start"))).alias("start"), F.max("notes").alias("notes"), F.count(F.lit(1)).alias("n"))
    return found.select("doc_id", "considering", F.coalesce("decree", "start").alias("body"), "notes", "n")


def zone_of_lines(lines: DataFrame) -> DataFrame:
    """Every line with its zone: preamble, body or notes."""
    body, notes, pos = fresh(lines.columns, "body"), fresh(lines.columns, "notes"), F.col("pos")
    starts = zones(lines).select("doc_id", F.col("body").alias(body), F.col("notes").alias(notes))
    return lines.join(starts, "doc_id").withColumn("zone", F.when(pos >= F.col(notes), "notes").when(pos >= F.col(body), "body").otherwise("preamble")).drop(body, notes)


def offsets(lines: DataFrame) -> DataFrame:
    """The character offset of every line in its document."""
    before = F.sum(F.length("line") + 1).over(_doc().rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("char_start", F.coalesce(before, F.lit(0)).cast("long"))
