"""Evaluation: segments of generated material, guards, metric arithmetic, run reports; and histories and quotas."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regtext.functions.questions import missing_references
from regtext.functions.text import strip
from regtext.operators.context import is_thin
from regtext.sources.tables import fresh

# Metrics of an evaluation row, placeholders, score bands.
METRICS = ["faithfulness_summary", "faithfulness_qa", "answer_relevancy", "context_precision", "context_recall", "risk_faithfulness"]
PLACEHOLDERS = ["-", "", "None", "none"]
BANDS = [(0.85, "very good"), (0.70, "good"), (0.50, "fair")]
MATERIAL = "dasar_hukum array<struct<nama_peraturan:string,pasal:string,ayat:string,catatan_validasi:string>>, ringkasan_pembuka string, ringkasan array<struct<poin:string>>, konteks_tambahan string, analisa_risiko array<struct<skenario:string,penjelasan:string>>, qa array<struct<pertanyaan:string,jawaban:string>>"


# the labels in the texts below are fixed values as well: a judge has been tuned to them
def _joined(items: Column, each, between: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.transform(items, each), between)).otherwise("-")


def _or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))


def segments(material: Column) -> Column:
    """Struct of the three segments that are judged: faithfulness, qa, risk."""
    m = material
    law = _joined(m["dasar_hukum"], lambda x: F.trim(F.concat_ws(" ", x["nama_peraturan"], x["pasal"], F.coalesce(x["ayat"], F.lit("")))), " | ")
    first = F.concat(F.lit("Dasar Hukum: "), law, F.lit("\nRingkasan Pembuka: "), _or_dash(m["ringkasan_pembuka"]), F.lit("\nRingkasan: "), _joined(m["ringkasan"], lambda x: x["poin"], " | "), F.lit("\nKonteks Tambahan: "), _or_dash(m["konteks_tambahan"]))
    answers = F.filter(m["qa"], lambda x: F.coalesce(x["jawaban"], F.lit("")) != "")
    qa = F.when(F.coalesce(F.size(m["qa"]), F.lit(0)) > 0, F.array_join(F.transform(answers, lambda x: x["jawaban"]), " ")).otherwise("-")
    risk = _joined(m["analisa_risiko"], lambda x: F.concat(F.lit("Skenario: "), x["skenario"], F.lit(" - Penjelasan: "), x["penjelasan"]), " | ")
    return F.struct(first.alias("faithfulness"), qa.alias("qa"), risk.alias("risk"))


def flat_text(material: Column) -> Column:
    m = material
    note = lambda x: F.when(~F.coalesce(x["catatan_validasi"], F.lit("-")).isin("-", ""), F.concat(F.lit(" (Catatan: "), x["catatan_validasi"], F.lit(")"))).otherwise("")
    law = _joined(m["dasar_hukum"], lambda x: F.trim(F.concat(F.lit("- "), x["nama_peraturan"], F.lit(" "), x["pasal"], F.lit(" "), F.coalesce(x["ayat"], F.lit("")), note(x))), "\n")
    summary = _joined(m["ringkasan"], lambda x: F.concat(F.lit("- "), x["poin"]), "\n")
    opening = _or_dash(m["ringkasan_pembuka"])
    qa = _joined(m["qa"], lambda x: F.concat(F.lit("Pertanyaan: "), x["pertanyaan"], F.lit("\nJawaban: "), x["jawaban"]), "\n\n")
    risk = _joined(m["analisa_risiko"], lambda x: F.concat(F.lit("Skenario: "), x["skenario"], F.lit("\nPenjelasan: "), x["penjelasan"]), "\n\n")
    parts = [("Dasar Hukum", law), ("Ringkasan", F.when(opening != "-", F.concat(opening, F.lit("\n"), summary)).otherwise(summary)), ("Konteks Tambahan", _or_dash(m["konteks_tambahan"])), ("Analisa Risiko (Contoh Pelanggaran)", risk), ("Tanya Jawab (Q&A)", qa)]
    return F.concat(F.lit("\n    "), F.concat_ws("\n\n    ", *(F.concat(F.lit(f"{name}:\n    "), c) for name, c in parts)), F.lit("\n    "))


def is_placeholder(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")).isin(PLACEHOLDERS)


def status(question: Column, *parts: Column) -> Column:
    """skipped without a question, error when all segments are placeholders, else ready."""
    empty = F.lit(True)
    for p in parts:
        empty = empty & is_placeholder(p)
    return F.when(F.coalesce(strip(question), F.lit("")).isin("", "-", "NONE", "null"), "skipped").when(empty, "error").otherwise("ready")


def context_chunks(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(text)).otherwise(parts)


def clean_score(x: Column) -> Column:
    """NaN as null, four digits."""
    return F.when(F.isnan(x), None).otherwise(F.floor(x * 10000 + 0.5) / 10000)


# metrics from arrays of verdicts (1 or 0); empty arrays give null
def share_true(verdicts: Column) -> Column:
    """Faithfulness and context recall: supported ones among all."""
    return F.try_divide(F.aggregate(verdicts, F.lit(0.0), lambda a, v: a + v), F.size(verdicts))


def precision_at(verdicts: Column) -> Column:
    """Mean of precision@k over the relevant places k."""
    step = lambda a, v: F.struct((a["k"] + 1).alias("k"), (a["hits"] + v).alias("hits"), (a["total"] + F.when(v == 1, (a["hits"] + v) / (a["k"] + 1)).otherwise(0.0)).alias("total"))
    zero = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("hits"), F.lit(0.0).alias("total"))
    return F.aggregate(F.transform(verdicts, lambda v: v.cast("double")), zero, step, lambda a: F.try_divide(a["total"], a["hits"]))


def relevancy(similarities: Column, noncommittal: Column) -> Column:
    return F.when(noncommittal, F.lit(0.0)).otherwise(share_true(similarities))


def carry_over(fresh: Column, old: Column) -> Column:
    return F.coalesce(fresh, old)


#: A mean sums whole billionths, so it is the same whatever the order of its rows.
UNIT = 1e9


def exact_mean(x: Column) -> Column:
    units = F.floor(x * UNIT + 0.5).cast("long")
    return F.sum(units).cast("double") / F.count(units) / UNIT


def report(results: DataFrame, evaluations: DataFrame, items: DataFrame) -> DataFrame:
    """Means of the metrics by evaluation type and by category (both types pooled), null skipped: grouping sets in one pass; and total_items, which counts all results of a run, failed ones too.

    results: run_id, item_id, process_id; evaluations: process_id, evaluation_type, metrics; items: item_id, category.
    """
    totals = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_items"))
    rows = results.where("process_id is not null").join(evaluations.where("evaluation_type in ('dataset_eval_live', 'dataset_eval_reference')"), "process_id").join(items, "item_id")
    rows = rows.withColumns({m: F.when(F.isnan(m), None).otherwise(F.col(m)) for m in METRICS}).withColumn("category", F.nullif("category", F.lit("")))
    sets = rows.groupingSets([["run_id", "evaluation_type"], ["run_id", "category"]], "run_id", "evaluation_type", "category")
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *(clean_score(exact_mean(F.col(m))).alias(m) for m in METRICS))
    out = out.where((F.col("g") == 1) | F.col("category").isNotNull()).select("run_id", F.when(F.col("g") == 1, "type").otherwise("category").alias("kind"), F.coalesce("evaluation_type", "category").alias("name"), "n", *METRICS)
    return out.join(totals, "run_id")


def band(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("weak")


# histories
def latest(rows: DataFrame, key: str, order: Column, tie: str = "id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order, F.desc(tie))
    turn = fresh(rows.columns, "turn")
    return rows.withColumn(turn, F.row_number().over(w)).where(F.col(turn) == 1).drop(turn)


def serialised(processes: DataFrame, sessions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Processes with their session and latest evaluation (by time); 'skipped' without one, 'error' without a status."""
    last = latest(evaluations, "process_id", F.desc_nulls_last("created_at")).select("process_id", F.col("id").alias("evaluation_id"), F.col("status").alias("evaluation_status"))
    s = sessions.select(F.col("id").alias("session_id"), "session_title", "knowledge_base")
    out = processes.join(s, "session_id", "left").join(last.withColumnRenamed("process_id", "id"), "id", "left")
    state = F.when(F.col("evaluation_id").isNull(), "skipped").otherwise(F.coalesce("evaluation_status", F.lit("error")))
    return out.withColumns({"title": F.coalesce(F.nullif("title", F.lit("")), "session_title"), "evaluation_status": state})


def delete_processes(gone: DataFrame, processes: DataFrame, sessions: DataFrame, evaluations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the processes in gone (id), what hangs on them, and sessions that become empty."""
    kept = processes.join(gone.select("id"), "id", "left_anti")
    touched = processes.join(gone.select("id"), "id", "left_semi").select(F.col("session_id").alias("id")).distinct()
    orphans = touched.join(kept.select(F.col("session_id").alias("id")), "id", "left_anti")
    return kept, sessions.join(orphans, "id", "left_anti"), evaluations.join(gone.select(F.col("id").alias("process_id")), "process_id", "left_anti")


def time_bucket(at: Column, today: Column) -> Column:
    """Times to come count as recent ones, missing ones as old."""
    days = F.datediff(today, at)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, "Previous 7 Days").otherwise("Older")


# quotas: requests with model, ts (timestamp), tokens
#: Microseconds of a slice of time: the longest window.
SLICE = 86_400_000_000


def windowed_usage(requests: DataFrame) -> DataFrame:
    """Tokens and requests of the last minute and day at every request; what is exactly as old as a window is out of it.

    Time is cut into slices of a day. A request stands in its own and, for the windows that reach back, in the
    next one; so a model with very many requests is dealt over as many tasks as it has days.
    """
    rows = requests.withColumn("us", F.unix_micros("ts")).withColumn("day", F.floor(F.col("us") / SLICE).cast("long"))
    both = rows.withColumn("slice", F.explode(F.array(F.col("day"), F.col("day") + 1)))
    w = lambda seconds: Window.partitionBy("model", "slice").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    order = Window.partitionBy("model", "slice").orderBy("us", "request_id")
    used = both.withColumns({"tokens_minute": F.sum("tokens").over(w(60)), "requests_minute": F.count(F.lit(1)).over(w(60)), "tokens_day": F.sum("tokens").over(w(86400)), "requests_day": F.count(F.lit(1)).over(w(86400)), "prior": F.lag("us").over(order)})
    days = rows.groupBy("model", "day").agg(F.max("us").alias("last_us"))
    before = days.withColumn("before", F.max("last_us").over(Window.partitionBy("model").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).drop("last_us")
    out = used.where("slice = day").join(before, ["model", "day"])
    gap = (F.col("us") - F.coalesce("prior", "before")) / 1e6
    return out.withColumn("gap_seconds", gap).drop("us", "day", "slice", "prior", "before")


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.floor(chars / 4 * 1.2).cast("long"), F.lit(150).cast("long"))


def with_limits(usage: DataFrame, limits: DataFrame, tpm: int = 4500, tpd: int = 90_000) -> DataFrame:
    """limits: model, tpm, tpd. Flags of requests over their model's limits, or over the defaults."""
    out = usage.join(limits, "model", "left")
    return out.withColumns({"over_minute": F.col("tokens_minute") > F.coalesce("tpm", F.lit(tpm)), "over_day": F.col("tokens_day") > F.coalesce("tpd", F.lit(tpd))}).drop("tpm", "tpd")


# evaluation of material and golden-set runs: verdicts come from a judge, the seam; all else is columns
def _given(text: Column) -> Column:
    return ~is_placeholder(text)


def guarded(rows: DataFrame) -> DataFrame:
    """rows (question, summary, qa, risk, ground_truth, is_reeval, reuse_relevancy, old_answer_relevancy) with status, error and whether the old relevancy is taken."""
    truth = F.coalesce("ground_truth", F.lit("")) != ""
    reeval = F.coalesce("is_reeval", F.lit(False))
    all_empty = ~_given(F.col("summary")) & ~_given(F.col("qa")) & ~_given(F.col("risk"))
    error = F.when(reeval & ~truth, "re-evaluation needs a ground truth").when(~reeval & all_empty, "all segments are placeholders")
    skipped = F.coalesce(strip("question"), F.lit("")).isin("", "-", "NONE", "null")
    status = F.when(skipped, "skipped").when(error.isNotNull(), "error").otherwise("success")
    reuse = F.coalesce("reuse_relevancy", F.lit(False)) & F.col("old_answer_relevancy").isNotNull()
    return rows.withColumns({"status": status, "error": F.when(~skipped, error), "reuse": reuse})


def judged(rows: DataFrame) -> DataFrame:
    """guarded rows with verdict arrays (v_summary, v_qa, v_risk, v_precision, v_recall of 0 and 1; similarities; noncommittal) and old metrics: the metrics, the basis of precision and recall, the segments, and a flag for a low risk score.

    Full mode scores each segment that is given; precision and recall need a ground truth, and are judged on the answers or else the
    summary. Re-evaluation scores these two only and carries the rest over.
    """
    ok, reeval = F.col("status") == "success", F.coalesce("is_reeval", F.lit(False))
    truth = F.coalesce("ground_truth", F.lit("")) != ""
    summary, qa, risk = (_given(F.col(c)) for c in ("summary", "qa", "risk"))
    basis = F.when(truth & qa, "qa").when(truth & summary, "summary")
    fresh = lambda given, value, old: F.when(ok, F.when(reeval, F.col(old)).when(given, value))
    share = lambda c: share_true(F.col(c).cast("array<double>"))
    answer = F.when(F.col("reuse"), F.col("old_answer_relevancy")).otherwise(relevancy(F.col("similarities"), F.col("noncommittal")))
    names = F.array_compact(F.array(F.when(summary, "faithfulness"), F.when(qa, "qa"), F.when(risk, "risk")))
    merged = F.array_sort(F.array_union(F.coalesce("old_segments", F.array().cast("array<string>")), F.array_compact(F.array(basis))))
    out = rows.withColumns({
        "faithfulness_summary": clean_score(fresh(summary, share("v_summary"), "old_faithfulness_summary")),
        "faithfulness_qa": clean_score(fresh(qa, share("v_qa"), "old_faithfulness_qa")),
        "answer_relevancy": clean_score(fresh(qa, answer, "old_answer_relevancy")),
        "context_precision": clean_score(F.when(ok & basis.isNotNull(), precision_at(F.col("v_precision").cast("array<double>")))),
        "context_recall": clean_score(F.when(ok & basis.isNotNull(), share("v_recall"))),
        "risk_faithfulness": clean_score(fresh(risk, share("v_risk"), "old_risk_faithfulness")),
        "basis": F.when(ok, basis), "segments": F.when(ok, F.when(reeval, merged).otherwise(names)),
    })
    return out.withColumn("low_risk_score", F.coalesce(F.col("risk_faithfulness") < 0.6, F.lit(False)))


# What a material says when its generation failed.
SYSTEM_ERROR = "system error"


def golden_run(items: DataFrame, outcomes: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """Results of a run (run_id, item_id, process_id: null where it failed, status) and its counts.

    items: item_id; outcomes: item_id, process_id, first_point. An item fails without material or history, or with a system error.
    """
    good = F.col("process_id").isNotNull() & F.col("first_point").isNotNull() & (F.col("first_point") != SYSTEM_ERROR)
    rows = items.select("item_id").join(outcomes, "item_id", "left")
    results = rows.select(F.lit(run_id).alias("run_id"), "item_id", F.when(good, F.col("process_id")).alias("process_id"), F.when(good, "success").otherwise("failed").alias("status"))
    counts = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("status") == "success").alias("success_count"), F.count_if(F.col("status") == "failed").alias("failed_count"))
    return results, counts.withColumn("status", F.lit("completed"))


def two_evaluations(items: DataFrame, results: DataFrame) -> DataFrame:
    """Each successful result twice: with the context that was found (live), and with the item's own, cut into chunks (reference)."""
    good = results.where("process_id is not null").join(items, "item_id")
    kind = F.explode(F.array(F.lit("dataset_eval_live"), F.lit("dataset_eval_reference")))
    out = good.withColumn("evaluation_type", kind)
    live = F.col("evaluation_type") == "dataset_eval_live"
    return out.withColumns({"context": F.when(live, F.col("context")).otherwise(F.col("reference_context")), "chunks": F.when(live, F.array("context")).otherwise(context_chunks(F.col("reference_context")))})


def with_item_counts(datasets: DataFrame, items: DataFrame) -> DataFrame:
    """datasets (id, name, created_at) with n_items and place, the newest first."""
    n = items.groupBy(F.col("dataset_id").alias("id")).agg(F.count(F.lit(1)).alias("n_items"))
    out = datasets.join(n, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("long"))
    return out.withColumn("place", _newest())


def _newest() -> Column:
    """The place in a list of datasets or runs, which are made by hand and few."""
    return F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))


def add_datasets(new: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New datasets whose name is free, and those whose name is taken (also by an earlier new one)."""
    first = new.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("id")))
    taken = F.col("n") > 1
    free = first.where(~taken).drop("n").join(datasets.select("name"), "name", "left_anti").select(*new.columns)
    return free, new.join(free.select("id"), "id", "left_anti")


def add_items(items: DataFrame, dataset_id: int, rows: DataFrame) -> DataFrame:
    """items and rows as items of a dataset; rows that are blank where a value is needed are not added."""
    needed = ["question", "ground_truth", "reference_context"]
    blank = [F.coalesce(strip(c), F.lit("")) == "" for c in needed]
    good = rows.where(~(blank[0] | blank[1] | blank[2])).withColumn("dataset_id", F.lit(dataset_id).cast(items.schema["dataset_id"].dataType))
    return items.unionByName(good.select(*items.columns))


# writing of histories: new rows beside the tables that are there
def get_or_create_sessions(asked: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked (request_id, session_id, session_title, knowledge_base, provider) with the session each belongs to, and the sessions to append.

    A known id is kept; any other request opens a session of its own, whose id comes from the request.
    """
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("known"))
    out = asked.join(known, "session_id", "left")
    new_id = F.concat(F.lit("s-"), F.col("request_id").cast("string"))
    out = out.withColumn("session", F.when(F.col("known"), F.col("session_id").cast("string")).otherwise(new_id))
    created = out.where("known is null").select(F.col("session").alias("id"), "session_title", "knowledge_base", "provider")
    return out.select("request_id", "session"), created


def new_processes(rows: DataFrame) -> DataFrame:
    """rows (process_id, session, title, material: a struct) as processes, with the material as JSON."""
    return rows.select("process_id", "session", "title", F.to_json("material").alias("material"))


def new_evaluations(results: DataFrame, processes: DataFrame) -> DataFrame:
    """Evaluations to append: of known processes, typed by their source label, or else by whether there is a ground truth; without a status they are errors."""
    kind = F.coalesce(F.nullif("source_label", F.lit("")), F.when(F.coalesce("ground_truth", F.lit("")) != "", "manual_with_ground_truth").otherwise("auto_evaluation"))
    known = processes.select("process_id")
    return results.join(known, "process_id", "left_semi").withColumns({"evaluation_type": kind, "status": F.coalesce("status", F.lit("error"))}).drop("source_label")


def with_evaluations(processes: DataFrame, evaluations: DataFrame) -> DataFrame:
    """processes (id) with all their evaluations (id, process_id, ..) as one sorted array; empty without any."""
    rest = [c for c in evaluations.columns if c not in ("id", "process_id")]
    nested = evaluations.groupBy(F.col("process_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", *rest))).alias("evaluations"))
    out = processes.join(nested, "id", "left")
    return out.withColumn("evaluations", F.coalesce("evaluations", F.array().cast(nested.schema["evaluations"].dataType)))


def newest_page(rows: DataFrame, size: int, after: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of rows (id, created_at), the newest first, and the total."""
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).offset(after).limit(size), rows.agg(F.count(F.lit(1)).alias("total"))


def retitled(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """rows (id, title) with new titles (id, new_title): stripped, of 1 to 255 characters; others change nothing."""
    new = strip("new_title")
    good = titles.where((F.length(new) >= 1) & (F.length(new) <= 255)).select("id", new.alias("new_title"))
    return rows.join(good, "id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")


def label_of(value: Column, labels: dict[str, str]) -> Column:
    """A label from a map, or the value itself; '-' without one."""
    out = F.when(F.coalesce(value, F.lit("")) == "", "-")
    for k, name in labels.items():
        out = out.when(value == k, name)
    return out.otherwise(value)


# payloads where no material was generated
def corrected(material: Column) -> Column:
    """Whether any citation says something about its reference."""
    return F.coalesce(F.exists(material["dasar_hukum"], lambda x: ~F.coalesce(x["catatan_validasi"], F.lit("")).isin("", "-")), F.lit(False))


def needs_hint(asked: Column, context: Column, material: Column) -> Column:
    """Whether the generator gets a second try: articles were asked for that the context lacks, and no citation says so."""
    return (F.size(missing_references(asked, context)) > 0) & ~corrected(material)


# Texts of the payloads.
THIN = "Konteks dokumen hukum yang tersedia terlalu sedikit untuk dianalisis."
NO_CONTEXT = "Pembahasan tentang ini tidak ditemukan di database."


def fallback_material(context: Column, has_context: Column) -> Column:
    """The material where generation failed: without any context, with a thin one, or for another reason."""
    point = F.when(~has_context, NO_CONTEXT).when(is_thin(context), THIN).otherwise(SYSTEM_ERROR)
    return F.from_json(F.to_json(F.struct(F.array(F.struct(point.alias("poin"))).alias("ringkasan"), F.when(has_context, "-").otherwise(NO_CONTEXT).alias("konteks_tambahan"))), MATERIAL)


_LISTED = {"dasar_hukum": ("nama_peraturan", "pasal", "ayat", "catatan_validasi"), "ringkasan": ("poin",), "analisa_risiko": ("skenario", "penjelasan"), "qa": ("pertanyaan", "jawaban")}
_SINGLE = ("ringkasan_pembuka", "konteks_tambahan")


def well_formed(made: object) -> dict:
    """A generator's answer, if it is a material: a dict with some known section, whose lists hold dicts of texts. Anything else is an error."""
    text = lambda x: x is None or isinstance(x, str | int | float)
    if not isinstance(made, dict):
        raise ValueError("no material")
    for section, names in _LISTED.items():
        rows = made.get(section) or []
        if not isinstance(rows, list) or not all(isinstance(r, dict) and all(text(r.get(n)) for n in names) for r in rows):
            raise ValueError(f"{section} is malformed")
    if not all(text(made.get(c)) for c in _SINGLE):
        raise ValueError("a text is malformed")
    if not any(made.get(c) for c in (*_LISTED, *_SINGLE)):
        raise ValueError("an empty material")
    return made


def generated(rows: DataFrame, generator) -> DataFrame:
    """rows (request_id, question, context) with a material by a seam, and how many attempts it took.

    generator(question, context, hint) gives a material as a dict, or fails. It gets a second attempt where it failed or gave anything but a material
    (see well_formed), or, with the hint, where it did not say that the context lacks an article the question names. Two failures give the fallback.
    """

    def attempts(question: str, context: str, missing: bool) -> tuple[str | None, int]:
        found, hint = None, False
        for k in (1, 2):
            try:
                made = well_formed(generator(question, context, hint))
            except Exception:  # a model's failure is an attempt that gave nothing; an earlier material stays
                continue
            found = made
            noted = any((c.get("catatan_validasi") or "-") != "-" for c in found.get("dasar_hukum") or [])
            if not missing or noted or k == 2:
                return json.dumps(found), k
            hint = True
        return (json.dumps(found) if found is not None else None), 2

    def run(frames):
        for f in frames:
            out = [attempts(q, c, m) for q, c, m in zip(f["question"], f["context"], f["missing"], strict=True)]
            yield pd.DataFrame({"request_id": f["request_id"], "context": f["context"], "made": [x[0] for x in out], "attempts": [x[1] for x in out]})

    asked = rows.select("request_id", "question", "context", (F.size(missing_references(F.col("question"), F.col("context"))) > 0).alias("missing"))
    out = asked.mapInPandas(run, f"request_id {dict(rows.dtypes)['request_id']}, context string, made string, attempts int")
    return out.select("request_id", F.coalesce(F.from_json("made", MATERIAL), fallback_material(F.col("context"), F.lit(True))).alias("material"), "attempts")


def answered(payloads: DataFrame, call) -> DataFrame:
    """process_id, status, answer (JSON) and detail of an evaluator's answers to payloads, by a seam: call(payload as a dict) gives a dict.

    A call that fails, or gives anything but a dict, is a row with the status error, an empty answer and the reason; never a failed job.
    """

    def run(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    got = call(row)
                    if not isinstance(got, dict):
                        raise TypeError(f"an answer of type {type(got).__name__}")
                    out.append((row["process_id"], "success", json.dumps(got), None))
                except Exception as error:  # the other side's failure is what this row says
                    out.append((row["process_id"], "error", "{}", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["process_id", "status", "answer", "detail"])

    return payloads.mapInPandas(run, f"process_id {dict(payloads.dtypes)['process_id']}, status string, answer string, detail string")


def payload(rows: DataFrame) -> DataFrame:
    """What is sent to a judge: rows (process_id, question, context, ground_truth, material) with the flat answer and its segments."""
    s = segments(F.col("material"))
    return rows.select("process_id", "question", "context", "ground_truth", flat_text(F.col("material")).alias("answer"), s["faithfulness"].alias("faithfulness_text"), s["qa"].alias("answer_qa"), s["risk"].alias("answer_risk"))
