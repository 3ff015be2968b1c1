"""Histories as a log of changes.

A change is a row (seq, op, process_id, ..). What it says of an entity is kept as facts: (entity, id, field) with a value and the
number of the change that said it last. Facts merge by the greatest number for each field, so a log may come twice, in parts or out of order
and the result is the same. Deleted processes stay as a fact, so that a repeated old change can't bring them back; a
later save does.

log: seq (long, unique), op (save, retitle, evaluate, delete), process_id, session_id, session_title, title, material (JSON), evaluation_id, evaluation (JSON).
Fields that an op doesn't use are ignored. Rows without seq, op or process_id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regtext.functions.text import strip

KEY = ["entity", "id", "field"]
FACTS = "entity string, id string, field string, value string, seq long"


def _fact(entity: str, key: Column, field: str, value: Column, when: Column) -> Column:
    row = F.struct(F.lit(entity).alias("entity"), key.cast("string").alias("id"), F.lit(field).alias("field"), value.cast("string").alias("value"))
    return F.when(when, row)


def facts_of(log: DataFrame) -> DataFrame:
    """What the changes of a log say. A title counts, if it has 1 to 255 characters without the blanks around it."""
    op, process, session = F.col("op"), F.col("process_id"), F.col("session_id")
    save, title = op == "save", strip("title")
    named = (save | (op == "retitle")) & F.length(title).between(1, 255)
    said = F.array_compact(F.array(
        _fact("process", process, "session", session, save & session.isNotNull()),
        _fact("process", process, "saved", F.lit("1"), save),
        _fact("process", process, "title", title, F.coalesce(named, F.lit(False))),
        _fact("process", process, "material", F.col("material"), save),
        _fact("session", session, "title", F.col("session_title"), save & session.isNotNull()),
        _fact("evaluation", F.col("evaluation_id"), "process", process, (op == "evaluate") & F.col("evaluation_id").isNotNull()),
        _fact("evaluation", F.col("evaluation_id"), "evaluation", F.col("evaluation"), (op == "evaluate") & F.col("evaluation_id").isNotNull()),
        _fact("process", process, "deleted", F.lit("1"), op == "delete"),
    ))
    known = log.where("seq is not null and op is not null and process_id is not null")
    return merged(known.select("seq", F.explode(said).alias("x")).select("x.*", "seq"))


def merged(*facts: DataFrame) -> DataFrame:
    """Facts of several sources: of each field the one that was said last (of two with one number, the greater value)."""
    every = facts[0]
    for more in facts[1:]:
        every = every.unionByName(more)
    best = F.max(F.struct("seq", "value")).alias("x")
    return every.groupBy(*KEY).agg(best).select(*KEY, "x.value", "x.seq")


def _entities(facts: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    one = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    columns = [one(f, c).alias(f if c == "value" else f"{f}_seq") for f in fields for c in ("value", "seq")]
    return facts.where(F.col("entity") == entity).groupBy("id").agg(*columns)


def processes(facts: DataFrame) -> DataFrame:
    """Live processes: id, session_id, title, material. A process lives, if it was saved after its last deletion; what was said before that is gone."""
    p = _entities(facts, "process", ["session", "saved", "title", "material", "deleted"])
    gone = F.coalesce("deleted_seq", F.lit(-1))
    since = lambda f: F.when(F.col(f"{f}_seq") > gone, F.col(f)).alias({"session": "session_id"}.get(f, f))
    return p.where(F.col("saved_seq") > gone).select("id", since("session"), since("title"), since("material"), gone.alias("gone_seq"))


def sessions(facts: DataFrame) -> DataFrame:
    """Sessions that have a live process: id, session_title."""
    live = processes(facts).where("session_id is not null").select(F.col("session_id").alias("id")).distinct()
    named = _entities(facts, "session", ["title"]).select("id", F.col("title").alias("session_title"))
    return live.join(named, "id", "left")


def evaluations(facts: DataFrame) -> DataFrame:
    """Evaluations of live processes that came after their last deletion: id, process_id, evaluation."""
    e = _entities(facts, "evaluation", ["process", "evaluation"])
    live = processes(facts).select(F.col("id").alias("process"), "gone_seq")
    return e.join(live, "process").where(F.col("process_seq") > F.col("gone_seq")).select("id", F.col("process").alias("process_id"), "evaluation")
