"""Validation of corpus records kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, strip
from .durable import sized, stored
from .records import parsed, split_stored, stored_lines

REQUIRED = ("text", "input", "source", "doc_id")
OPTIONAL_STRINGS = ("content", "url", "title", "filename")
SHOWN_ERRORS, SHOWN_IDS = 50, 20


def _blank(s: Column) -> Column:
    return F.ltrim(s, F.lit(SPACES)) == ""  # looks no further than the first letter


def record_errors(records: DataFrame, min_chars: Column | int = 0) -> DataFrame:
    """``records(source_id, line_no, line)`` with ``errors array<string>`` and ``doc_id``.

    Types are read from the JSON, never coerced: a number for a string is an error. Each key is looked up
    once: its type (``_t_``, null: absent) and, if it is one, its string (``_s_``) are columns."""
    strings = (*REQUIRED, *OPTIONAL_STRINGS)
    rows = records.withColumn("v", parsed(F.col("line")))
    rows = rows.withColumns({"_kind": F.schema_of_variant("v"), **{f"_t_{k}": F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) for k in (*strings, "page")}})
    rows = rows.withColumns({f"_s_{k}": F.when(F.col(f"_t_{k}") == "STRING", F.try_variant_get("v", f"$.{k}", "string")) for k in strings})
    text, given, content, doc_id = (F.col(f"_s_{k}") for k in ("text", "input", "content", "doc_id"))
    rows = rows.withColumn("_n", F.when(text != "", F.length(strip(text))))
    kind, n = F.col("_kind"), F.col("_n")
    prefix = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "))
    say = lambda when, text: F.when(when, F.concat(prefix, text if isinstance(text, Column) else F.lit(text)))
    checks = []
    for key in REQUIRED:
        t = F.col(f"_t_{key}")
        checks.append(
            F.when(t.isNull(), F.concat(prefix, F.lit(f"missing required key '{key}'")))
            .when(t != "STRING", F.concat(prefix, F.lit(f"key '{key}' must be string")))
            .when(_blank(F.col(f"_s_{key}")), F.concat(prefix, F.lit(f"key '{key}' is empty")))
        )
    for key in OPTIONAL_STRINGS:
        checks.append(say(F.col(f"_t_{key}").isNotNull() & ~F.col(f"_t_{key}").isin("VOID", "STRING"), f"key '{key}' must be string when present"))
    checks.append(say((text != "") & (given != "") & (text != given), "'text' and 'input' must be identical"))
    checks.append(say((text != "") & content.isNotNull() & (content != text), "'content' must equal 'text' when present"))
    least = min_chars if isinstance(min_chars, Column) else F.lit(min_chars)
    checks.append(say(n < least, F.concat(F.lit("text shorter than min length ("), n.cast("string"), F.lit(" < "), least.cast("string"), F.lit(")"))))
    page = F.col("_t_page")
    checks.append(say(page.isNotNull() & ~page.isin("VOID", "BIGINT", "BOOLEAN"), "key 'page' must be integer when present"))
    known = F.filter(F.array(*checks), lambda x: x.isNotNull())
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    errors = F.when(F.col("v").isNull(), F.array(F.concat(prefix, F.lit("invalid JSON")))).when(~is_object, F.array(F.concat(prefix, F.lit("expected JSON object")))).otherwise(known)
    return rows.select(*records.columns, errors.alias("errors"), F.when(~_blank(doc_id), doc_id).alias("doc_id"))


def duplicate_ids(checked: DataFrame) -> DataFrame:
    return checked.filter("doc_id is not null").groupBy("source_id", "doc_id").agg(F.count("*").alias("n")).filter("n > 1")


def smallest(rows: DataFrame, group: str, order: list[str], value: str, k: int, name: str) -> DataFrame:
    """``group, name``: the ``value`` of the first ``k`` rows of each group in order, as an array. Spark
    keeps each task's first rows before it shuffles them, so no group is ever gathered whole."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    first = rows.select(group, *dict.fromkeys([*order, value])).withColumn("_nth", nth).filter(F.col("_nth") <= k)
    return first.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_nth", value))), lambda x: x[value]).alias(name))


def file_reports(lines: DataFrame, registry: DataFrame, quality: bool = False, strict: bool = False, empty_ratio: float = 0.05) -> DataFrame:
    """One row per registered source: status, records, line counts, errors, warnings and duplicate ids.

    ``lines(source_id, line_no, line)`` are physical lines, ``registry(source_id, path, min_chars)``. A
    record may be split over lines: it counts as one, with a warning, and errors name its first line.
    A source without lines is skipped, or failed if ``strict``; one of blank lines only fails. All
    errors are counted; the first 50 by line, 50 warnings and 20 duplicate ids are shown, and
    ``more_duplicates`` says how many ids are not.
    """
    registry = stored(registry, "registry")
    known = stored_lines(lines.join(sized(registry.select("source_id")), "source_id", "left_semi"), "source_id")
    records = split_stored(known, "source_id").withColumnsRenamed({"start_line": "line_no", "record": "line"})
    least = F.col("min_chars") if quality else F.lit(0)
    checked = stored(record_errors(records.join(sized(registry.select("source_id", "min_chars")), "source_id"), least).select("source_id", "line_no", "end_line", "errors", "doc_id"), "checked")
    counts = known.groupBy("source_id").agg(F.count("*").alias("physical_lines"), F.count_if(F.col("n") == 0).alias("empty_lines"))
    found = checked.groupBy("source_id").agg(F.count("*").alias("records"), F.count_if(F.col("end_line") > F.col("line_no")).alias("split_records"), F.sum(F.size("errors")).alias("error_count"))
    listed = checked.select("source_id", "line_no", F.explode("errors").alias("error"))
    shown = smallest(listed, "source_id", ["line_no", "error"], "error", SHOWN_ERRORS, "errors")
    spans = F.format_string("Line %d: record spans physical lines %d-%d", "line_no", "line_no", "end_line")
    warned = smallest(checked.filter("end_line > line_no").withColumn("warning", spans), "source_id", ["line_no"], "warning", SHOWN_ERRORS, "_spans")
    ids = duplicate_ids(checked)
    twice = ids.groupBy("source_id").agg(F.count("*").alias("duplicates")).join(smallest(ids, "source_id", ["doc_id"], "doc_id", SHOWN_IDS, "duplicate_doc_ids"), "source_id")
    out = registry
    for part in (counts, found, shown, warned, twice):
        out = out.join(part, "source_id", "left")
    out = out.na.fill(0, ["records", "split_records", "physical_lines", "empty_lines", "error_count", "duplicates"])
    missing = F.col("physical_lines") == 0
    ratio = F.col("empty_lines") / F.greatest(F.lit(1), F.col("physical_lines"))
    bad = (F.col("records") == 0) | (F.col("error_count") > 0)
    if quality:
        bad = bad | (F.col("duplicates") > 0) | (ratio > empty_ratio)
    more = F.greatest(F.lit(0), F.col("duplicates") - SHOWN_IDS)
    status = F.when(missing, F.lit("failed" if strict else "skipped")).when(bad, "failed").otherwise("ok")
    filled = F.col("physical_lines") - F.col("empty_lines")
    uneven = F.when(filled != F.col("records"), F.format_string("%d lines that are not empty hold %d records", filled, "records"))
    warnings = F.filter(F.concat(F.coalesce("_spans", F.array().cast("array<string>")), F.array(uneven)), lambda x: x.isNotNull())
    return out.select(
        "source_id", "path", status.alias("status"), "records", "split_records", "physical_lines", "empty_lines", F.round(100 * ratio, 2).alias("empty_percent"),
        "error_count", F.get("errors", F.lit(0)).alias("first_error"), "errors", warnings.alias("warnings"), "duplicates", "duplicate_doc_ids", more.alias("more_duplicates"),
    )


def report_payload(reports: DataFrame, quality: bool = False, strict: bool = False) -> DataFrame:
    """The reports as one JSON document a row, ``source_id, payload``, for ``write_json``."""
    empty = F.array().cast("array<string>")
    listed = [F.coalesce(c, empty).alias(c) for c in ("errors", "warnings", "duplicate_doc_ids")]
    fields = F.struct("source_id", "path", "status", "records", "physical_lines", "empty_lines", *listed, F.lit(quality).alias("quality_checks"), F.lit(strict).alias("strict"))
    return reports.select("source_id", F.to_json(fields).alias("payload"))


def exit_status(reports: DataFrame, strict: bool = False) -> int:
    """1 if a source failed, or was skipped under ``strict``, else 0."""
    bad = ["failed", "skipped"] if strict else ["failed"]
    return int(reports.filter(F.col("status").isin(*bad)).limit(1).count())


def job_outcomes(reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """``jobs(job, nth, source_id, optional)``, the sources that each job makes in order -> one row a job:
    ``job, passed, checked, failed, summary``. A missing source fails its job unless it is optional. The
    summary is one line on the first source that is not fine. A job without sources passes."""
    status = F.coalesce("status", F.lit("skipped"))
    gone = (status == "skipped") & F.col("optional")
    ok = (status == "ok") | gone
    said = F.coalesce("first_error", F.when(status == "skipped", "no file"), F.when(F.col("duplicates") > 0, F.concat(F.col("duplicates").cast("string"), F.lit(" duplicate ids"))), status)
    line = F.concat(F.lit("Corpus validation failed: "), "source_id", F.lit(": "), said)
    rows = jobs.join(reports.select("source_id", "status", "first_error", "duplicates"), "source_id", "left").withColumns({"_ok": F.col("source_id").isNull() | ok, "_gone": gone, "_line": line})
    out = rows.groupBy("job").agg(
        F.bool_and("_ok").alias("passed"),
        F.count_if(F.col("source_id").isNotNull() & ~F.col("_gone")).alias("checked"),
        F.count_if(~F.col("_ok")).alias("failed"),
        F.min_by("_line", F.when(~F.col("_ok"), F.col("nth"))).alias("summary"),
    )
    return out.withColumn("summary", F.coalesce("summary", F.lit("")))
