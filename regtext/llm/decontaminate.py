"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words of letters, digits and non-ASCII characters in lower case, joined by single
blanks. The windows of all test items (ten words, or the whole item where it has fewer) are the patterns of
one automaton, which runs over each normalised text once; a match's offset is mapped back to words and to
characters of the original text. No row moves between tasks.

The test set is small by nature and its size is checked: up to PATTERN_BYTES of item text go into one automaton, which a
worker builds once. A larger set is dealt over several, each a pass of its own over the texts, of which only the hits are
kept; so neither the driver nor a worker ever holds more than one.

Defined results: null texts have no words; items without words match nothing; repeated item rows count
once; an empty test set or table leaves everything clean; extra columns of the documents are kept out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regtext.llm.support import FOLD, fresh, map_batches, materialise, with_row_key, with_text_key

WINDOW = 10
#: Bytes of item text in one automaton: about 60 times as much memory in each worker.
PATTERN_BYTES = 2 << 20

_RUN = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_WORD = re.compile(rb"[^ ]+")


def item_windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The patterns of an item: each between blanks."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return []
    return list(dict.fromkeys(b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))))


def build(items: list[tuple[str, str | None]], size: int = WINDOW) -> ahocorasick.Automaton | None:
    owners: dict[bytes, list[str]] = {}
    for item, text in items:
        for w in item_windows(text, size):
            owners.setdefault(w, []).append(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, who in owners.items():
        found.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(dict.fromkeys(who))))
    found.make_automaton()
    return found


def scan(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, runs of hit words as (first, last), and the items found."""
    words = text.translate(FOLD).split()
    runs: list[list[int]] = []
    items: set[str] = set()
    if automaton is not None and words:
        line = f" {b' '.join(words).decode('latin-1')} "
        at = seen = 0
        for end, (n, who) in automaton.iter(line):
            seen += line.count(" ", at, end)
            at = end
            first, last = seen - n, seen - 1
            while runs and first <= runs[-1][1] + 1:
                a, b = runs.pop()
                first, last = min(a, first), max(b, last)
            runs.append([first, last])
            items.update(who)
    return len(words), [(a, b) for a, b in runs], items


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _offsets(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of runs of words."""
    spans = [m.span() for m in _WORD.finditer(re.sub(rb"\s", b" ", text.translate(FOLD)))]
    chars = lambda a: len(str(text[:a], "utf-8", "replace"))
    return [{"first_word": a, "last_word": b, "start": chars(spans[a][0]), "end": chars(spans[b][1])} for a, b in runs]


_AUTOMATA: dict[int, ahocorasick.Automaton | None] = {}


def _automaton(items: list[tuple[str, str | None]], size: int):
    """One automaton in a worker, kept over its tasks."""
    key = hash((size, tuple(items)))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = build(items, size)
    return _AUTOMATA[key]


_ARROW_RUN = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _scanner(items: list[tuple[str, str | None]], size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, size)
        for b in batches:
            n_words, runs, found = [], [], []
            for text in b.column(0).to_pylist():
                n, new, who = scan(text, automaton)
                n_words.append(n)
                runs.append(_offsets(text, new) if new else [])
                found.append(sorted(who))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_ARROW_RUN)), pa.array(found, pa.list_(pa.string()))], [*b.schema.names[1:], "n_words", "runs", "items"])

    return run


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of several passes as runs without overlap, and the items in order."""
    for b in batches:
        runs, items = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        out = []
        for each in runs:
            start = {r["first_word"]: r["start"] for r in each}
            end = {r["last_word"]: r["end"] for r in each}
            out.append([{"first_word": x, "last_word": y, "start": start[x], "end": end[y]} for x, y in _merge([(r["first_word"], r["last_word"]) for r in each])])
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.list_(_ARROW_RUN)), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], b.schema.names)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """One row per document: id, n_words, runs (of hit words, with offsets in the original), items (found, sorted)."""
    tests = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null and item is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // pattern_bytes))
    if shards > 1:
        docs, row = with_row_key(docs)
    own = [F.col(id_col).alias("id"), *([F.col(row).alias("row")] if shards > 1 else [])]
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *own)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("items", T.ArrayType(T.StringType()))])
    out = None
    for k in range(shards):
        part = sorted((r["item"], r["text"]) for r in tests.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k).collect())
        found = map_batches(rows, _scanner(part, size), schema)
        if shards > 1:
            found = materialise(found.where(F.size("runs") > 0) if k else found, "hits")
        out = found if out is None else out.unionByName(found)
    if shards > 1:
        out = out.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
        out = map_batches(out.select("id", "row", "n_words", "runs", "items"), _merged, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "items")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no window of a test item occurs, with all their columns.

    The verdict is joined by id and digest of the text, so it is only carried along for documents that are hit.
    """
    rows, key = with_text_key(docs, text_col)
    both = F.struct(F.col(id_col).alias("id"), F.col(key).alias("key"))
    leaky, digest = fresh(rows.columns, "leaky"), fresh(rows.columns, "leaky_digest")
    bad = find_leaks(rows.select(both.alias("id"), F.col(text_col).alias("text")), items, "id", "text").where(F.size("runs") > 0)
    bad = bad.select(F.col("id.id").alias(leaky), F.col("id.key").alias(digest)).distinct()
    return rows.join(bad, F.col(id_col).eqNullSafe(F.col(leaky)) & (F.col(key) == F.col(digest)), "left_anti").drop(key)
