"""Records split over lines, line numbers over splits, reports and jobs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import records as R
from fieldloom.operators import validate as V
from fieldloom.sources import readers


def cut(rnd, text):
    """A JSON text cut into lines at places where no white space is lost."""
    at = [i for i in range(1, len(text)) if not text[i - 1].isspace() and not text[i].isspace()]
    places = sorted(rnd.sample(at, min(len(at), rnd.choice([0, 0, 1, 3]))))
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]


def made_lines(rnd, n):
    tricky = ['a"b', "c:\\d\\", '{"x": [1, 2]}', "[}{]", "\\", '\\"', "plain words", "", "ñ{", "tab\tline\nbreak"]
    lines, want = [], []
    for i in range(n):
        record = {"k": [rnd.choice(tricky) for _ in range(rnd.randint(0, 4))], "o": {rnd.choice(tricky): {"p": [{}, []]}}, "i": i}
        pieces = [p for p in cut(rnd, json.dumps(record, ensure_ascii=rnd.random() < 0.5))]
        if any(set(p) == {"\\"} for p in pieces):  # not taken apart by contract
            pieces = ["".join(pieces)]
        start = len(lines) + 1
        for p in pieces:
            lines.append(p)
            end = len(lines)
            if rnd.random() < 0.2:
                lines.append(rnd.choice(["", "  ", "\t"]))
        want.append((start, end, record))
    return lines, want


def test_split_records(spark):
    rnd = random.Random(4)
    files = {f: made_lines(rnd, n) for f, n in (("big", 400), ("small", 3), ("one", 1))}
    rows = [(f, i + 1, line) for f, (lines, _) in files.items() for i, line in enumerate(lines)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, line_no long, line string").withColumn("record", F.lit("x"))
    got = {}
    for r in R.split_records(df).collect():
        got.setdefault(r.file, []).append((r.start_line, r.end_line, json.loads(r.record)))
    assert {f: sorted(x, key=lambda t: t[0]) for f, x in got.items()} == {f: want for f, (_, want) in files.items()}
    kept, _ = R.numbered_records(df)
    assert kept.filter("file = 'big'").select("_part").distinct().count() > 1  # one file, several tasks
    assert R.split_records(df.limit(0)).count() == 0


def test_what_does_not_parse_is_taken_line_by_line(spark):
    lines = ['{"a": 1}', '{"b": "open', '{"c": 2}', '{"d":', "3}", None, '{"e": ', '{"f": 4}}']
    df = spark.createDataFrame([("x", i + 1, s) for i, s in enumerate(lines)], "file string, line_no int, line string")
    got = sorted((r.start_line, r.end_line, r.record) for r in R.split_records(df).collect())
    assert got[0] == (1, 1, '{"a": 1}') and (3, 3, '{"c": 2}') in got
    good = spark.createDataFrame([("x", i, s) for i, s in enumerate(lines[3:])], "file string, line_no int, line string")
    assert {(r.start_line, r.end_line): json.loads(r.record) for r in R.split_records(good).collect()} == {(0, 1): {"d": 3}, (3, 4): {"e": {"f": 4}}}
    assert {(r.start_line, r.end_line) for r in R.split_records(good, longest=6).collect()} == {(0, 0), (1, 1), (3, 3), (4, 4)}


def test_lines_of_files_in_splits(spark, tmp_path):
    texts = {"a.txt": "".join(f"line {i}\r\n" if i % 7 else "\n" for i in range(3000)), "b.txt": "no end", "c.txt": "\n", "d.txt": "x\n\ny"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in rows:
        got.setdefault(r.file.rpartition("/")[2], []).append((r.line_no, r.line))
    assert {f: [line for _, line in sorted(x)] for f, x in got.items()} == {f: t.split("\n") for f, t in texts.items()}
    assert all([n for n, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values())


@pytest.fixture
def reports(spark):
    text = "x" * 95
    good = {"text": text, "input": text, "source": "s", "doc_id": "a"}
    whole = json.dumps(good)
    files = {
        "split": [whole[:30], whole[30:], json.dumps(good | {"doc_id": "b"})],
        "short": [json.dumps(good | {"text": "y", "input": "y"})],
        "twice": [whole, whole],
        "blank": ["", " "],
    }
    lines = spark.createDataFrame([(f, i + 1, s) for f, x in files.items() for i, s in enumerate(x)], "source_id string, line_no int, line string")
    registry = spark.createDataFrame([(f, f + ".jsonl", 80) for f in (*files, "none")], "source_id string, path string, min_chars int")
    return V.file_reports(lines, registry, quality=True)


def test_reports_and_jobs(spark, reports):
    got = {r.source_id: r for r in reports.collect()}
    assert {k: (r.status, r.records, r.split_records, r.error_count) for k, r in got.items()} == {
        "split": ("ok", 2, 1, 0), "short": ("failed", 1, 0, 1), "twice": ("failed", 2, 0, 0), "blank": ("failed", 0, 0, 0), "none": ("skipped", 0, 0, 0),
    }
    assert got["split"].warnings == ["Line 1: record spans physical lines 1-2", "3 lines that are not empty hold 2 records"]
    assert got["twice"].duplicate_doc_ids == ["a"] and got["twice"].warnings == []
    assert V.exit_status(reports) == 1 and V.exit_status(reports.filter("source_id IN ('split', 'none')")) == 0
    assert V.exit_status(reports.filter("source_id IN ('split', 'none')"), strict=True) == 1
    payload = {r.source_id: json.loads(r.payload) for r in V.report_payload(reports, quality=True).collect()}
    assert payload["split"]["records"] == 2 and payload["none"]["errors"] == [] and payload["twice"]["duplicate_doc_ids"] == ["a"] and payload["blank"]["quality_checks"]
    jobs = [("fine", 1, "split", False), ("fine", 2, "none", True), ("gone", 1, "split", False), ("gone", 2, "none", False), ("bad", 1, "twice", False), ("bad", 2, "short", False), ("idle", 1, None, False)]
    done = {r.job: r for r in V.job_outcomes(reports, spark.createDataFrame(jobs, "job string, nth int, source_id string, optional boolean")).collect()}
    assert {k: (r.passed, r.checked, r.failed) for k, r in done.items()} == {"fine": (True, 1, 0), "gone": (False, 2, 1), "bad": (False, 2, 2), "idle": (True, 0, 0)}
    assert done["bad"].summary == "Corpus validation failed: twice: 1 duplicate ids" and done["gone"].summary.endswith("none: no file") and done["fine"].summary == ""


def test_smallest_keeps_ties_apart(spark):
    rows = spark.createDataFrame([("g", i % 5, str(i)) for i in range(40)] + [("h", 1, None)], "g string, o int, v string")
    got = {r.g: r.first for r in V.smallest(rows, "g", ["o", "v"], "v", 3, "first").collect()}
    assert got == {"g": ["0", "10", "15"], "h": [None]}


def old_lexed(line):
    """The state's changes taken from the text itself, character by character."""
    out = {}
    for e in (0, 1):
        for inside in (0, 1):
            quotes = depth = 0
            open_, skip = bool(inside), bool(e)
            for c in line:
                if skip:
                    skip = False
                elif c == "\\":
                    skip = True
                elif c == '"':
                    open_, quotes = not open_, quotes + 1
                elif not open_:
                    depth += (c in "{[") - (c in "}]")
            out[f"q{e}"], out[f"d{e}{inside}"] = quotes, depth
        if not e:
            out["escapes"] = skip
    return out


def test_lines_states_by_their_marks(spark):
    rnd = random.Random(8)
    lines = ["".join(rnd.choices('\\"{}[]a ñ😀', k=rnd.randint(1, 12))) for _ in range(600)]
    lines = [x for x in lines if set(x) != {"\\"}]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = R.with_lexed(df).collect()
    assert len(got) == len(lines) and all(r.lexed.asDict() == old_lexed(r.line) for r in got)


def test_texts_are_not_sorted_or_shuffled_to_find_records(spark, monkeypatch):
    """Only the lines' states are dealt by range, and lines of records of their own stay where they are stored."""
    dealt = []
    monkeypatch.setattr(R, "ranged", lambda made, *a, _old=R.ranged: dealt.append(made.columns) or _old(made, *a))
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate(['{"a": 1}', "", '{"d":', "3}"])], "file string, line_no int, line string")
    out = R.split_records(df)
    assert dealt and "line" not in dealt[0]
    assert sorted((r.start_line, r.end_line, r.record) for r in out.collect()) == [(0, 0, '{"a": 1}'), (2, 3, '{"d":3}')]


def test_errors_look_each_key_up_once(spark):
    """Each check used to look its key up anew, and blank texts were stripped as a whole."""
    texts = [{"text": "  x ", "input": "  x ", "source": "  ", "doc_id": " "}, {"text": "", "input": 1, "source": None, "content": "y", "page": "1"}, {"text": "abc", "input": "abd", "source": "s", "doc_id": "d", "content": None, "page": 2, "url": 3}]
    df = spark.createDataFrame([("s", i, json.dumps(t)) for i, t in enumerate(texts)] + [("s", 3, "[1]"), ("s", 4, "{")], "source_id string, line_no long, line string")
    checked = V.record_errors(df, 2)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("$.text") <= 2
    got = {r.line_no: ([e.partition(": ")[2] for e in r.errors], r.doc_id) for r in checked.collect()}
    assert got == {
        0: (["key 'source' is empty", "key 'doc_id' is empty", "text shorter than min length (1 < 2)"], None),
        1: (["key 'text' is empty", "key 'input' must be string", "key 'source' must be string", "missing required key 'doc_id'", "key 'page' must be integer when present"], None),
        2: (["key 'url' must be string when present", "'text' and 'input' must be identical"], "d"),
        3: (["expected JSON object"], None),
        4: (["invalid JSON"], None),
    }


def test_records_with_long_strings(spark):
    n = 20_000_000  # what Spark's JSON functions take by themselves
    text = F.repeat(F.lit("x"), F.lit(n + 1))
    good = F.concat(F.lit('{"text":"'), text, F.lit('","source":"s","doc_id":"a","input":"'), text, F.lit('"}'))
    bad = F.concat(F.lit("{'text':'"), text, F.lit("'}"))
    lines = spark.range(3).select(F.lit("s").alias("source_id"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, good).when(F.col("id") == 1, bad).otherwise(F.substring(good, 1, n + 99)).alias("line"))
    got = {r.line_no: (r.errors, r.doc_id) for r in V.record_errors(lines, 100).collect()}
    assert got == {0: ([], "a"), 1: (["Line 1: invalid JSON"], None), 2: (["Line 2: invalid JSON"], None)}
    halves = lines.filter("line_no = 0").select(F.col("source_id").alias("file"), F.posexplode(F.array(F.substring("line", 1, n), F.substring("line", n + 1, 1 << 30))).alias("line_no", "line"))
    assert [(r.start_line, r.end_line) for r in R.split_records(halves).select("start_line", "end_line").collect()] == [(0, 1)]
