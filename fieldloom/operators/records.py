"""JSON records in text lines: one a line, or split over several, found without a task a file.

Where a record begins depends on all text before it: whether a string is open, and how deep objects
and arrays are nested. Both are sums of small numbers that each line gives on its own, so they are
added up over range partitions of the lines, as running sums are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .durable import discard, joined_to_parts, ranged, sized, starts_of, stored

LONGEST = 64 << 20  #: bytes of the lines that are put together to one record
STRING = 20_000_000  #: characters of one string that Spark's JSON functions take unless told otherwise
MARKED = 1_000_000  #: lines of split records, two numbers each, that may go to all tasks


def parsed(c: Column) -> Column:
    """JSON as a variant, or null if it is none; also with longer strings than ``STRING``."""
    options = {"maxStringLen": str((1 << 31) - 1), "allowSingleQuotes": "false"}
    return F.coalesce(F.try_parse_json(c), F.when(F.octet_length(c) > STRING, F.from_json(c, "variant", options)))


def _count(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, characters, ""))


def _marks(c: Column) -> Column:
    """Quotes and brackets that no backslash stands before, in one pass; all else goes."""
    return F.regexp_replace(c, r'(?s)\\.?|[^"\\{}\[\]]+', "")


def with_lexed(rows: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``lexed``, what a line does to the state of the text before it: quotes that open or close strings,
    and the change in depth, for each state it may begin in: after an escaping backslash (``q1``) or not
    (``q0``), outside strings (``d00``, ``d10``) or inside (``d01``, ``d11``). The text itself is looked
    at once: all is counted in its few marks, of which those after an escaped first character are the rest."""
    text = F.col(line)
    first = F.substring(text, 1, 1)
    rows = rows.withColumn("_m0", _marks(text))
    rest = F.when(first == "\\", _marks(F.substring(text, 2, 1 << 30))).when(first.isin(*'"{}[]'), F.substring("_m0", 2, 1 << 30)).otherwise(F.col("_m0"))
    rows = rows.withColumn("_m1", rest)
    parts = {}
    for e in (0, 1):
        marks = F.col(f"_m{e}")
        parts[f"q{e}"] = _count(marks, '"')
        for inside, c in ((0, marks), (1, F.regexp_replace(marks, r'^[^"]*("|$)', ""))):
            outside = F.regexp_replace(c, r'"[^"]*("|$)', "")
            parts[f"d{e}{inside}"] = _count(outside, "{[") - _count(outside, "}]")
    trailing = F.length(text) - F.length(F.rtrim(text, F.lit("\\")))
    escapes = F.when(text.endswith("\\"), trailing % 2 == 1).otherwise(F.lit(False))
    return rows.withColumn("lexed", F.struct(*(c.cast("long").alias(n) for n, c in parts.items()), escapes.alias("escapes"))).drop("_m0", "_m1")


def _running(rows: DataFrame, file: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the lines of the file before this one."""
    totals = rows.groupBy(file, "_part").agg(F.sum(value).alias("_sum"))
    within = Window.partitionBy(file, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = joined_to_parts(rows.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))), starts_of(totals, [file], "_sum", "_start"), [file])
    return rows.withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def stored_lines(lines: DataFrame, file: str = "file") -> DataFrame:
    """The lines, stripped and stored with their state (``lexed``), bytes ``n`` (0: blank) and a number ``_id``."""
    rows = lines.select(file, F.col("line_no").cast("long").alias("line_no"), F.coalesce(strip(F.col("line")), F.lit("")).alias("line"))
    return stored(with_lexed(rows).withColumns({"n": F.octet_length("line"), "_id": F.monotonically_increasing_id()}), "lines")


def _numbered(made: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    kept = ranged(made.filter("n > 0").select(file, "line_no", "_id", "n", "lexed.*"), [file], ["line_no"], "states")
    narrow = kept.drop("line_no")
    last = narrow.groupBy(file, "_part").agg(F.max_by("escapes", "_at").alias("_last"))
    previous = Window.partitionBy(file).orderBy("_part")  # a row a partition
    last = last.select(file, "_part", F.lag("_last").over(previous).alias("_last"))
    within = Window.partitionBy(file, "_part").orderBy("_at")
    state = joined_to_parts(narrow.withColumn("_escaped", F.lag("escapes").over(within)), last, [file])
    escaped = F.coalesce("_escaped", "_last", F.lit(False))
    pick = lambda a, b: F.when(escaped, F.col(b)).otherwise(F.col(a))
    line = [file, "_part", "_at", "_id", "n"]
    state = state.select(*line, escaped.alias("escaped"), pick("q0", "q1").alias("q"), pick("d00", "d10").alias("d0"), pick("d01", "d11").alias("d1"))
    state = _running(state, file, "q", "quotes").withColumn("inside", F.col("quotes") % 2 == 1)
    state = state.withColumn("d", F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0")))
    state = _running(state.select(*line, "escaped", "inside", "d"), file, "d", "depth")
    begins = (~F.col("escaped") & ~F.col("inside") & (F.col("depth") <= 0)).cast("long")
    state = _running(state.select(*line, begins.alias("begins")), file, "begins", "before")
    return kept, stored(state.select(file, "_id", "n", (F.col("before") + F.col("begins")).alias("record")), "records")


def numbered_records(lines: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """``lines(file, line_no, line)`` -> the states of the lines that are not blank, in order, with ``_id``; and
    ``file, _id, n, record``, their bytes and the number of the record that each belongs to.

    A record begins with a line that stands outside strings and objects. A line of nothing but
    backslashes is taken to begin unescaped.
    """
    return _numbered(stored_lines(lines, file), file)


def split_records(lines: DataFrame, file: str = "file", longest: int = LONGEST) -> DataFrame:
    """``lines(file, line_no, line)`` -> ``file, start_line, end_line, record``.

    The stripped lines of a record are joined. What doesn't parse then, or would be longer than
    ``longest`` bytes, is taken line by line, so that a record without an end spoils no other: only
    lines of records that are split, and of moderate size, are ever gathered. Texts are stored once, and only
    their states are sorted; a line of a record of its own stays where it was stored. Blank lines count as
    lines and nothing else; a null line is blank. No lines give no records.
    """
    return split_stored(stored_lines(lines, file), file, longest)


def split_stored(made: DataFrame, file: str = "file", longest: int = LONGEST) -> DataFrame:
    """``split_records`` of lines that ``stored_lines`` has stored."""
    kept, numbers = _numbered(made, file)
    discard(kept)
    texts = made.filter("n > 0").select(file, "line_no", "line", "_id")
    split = numbers.groupBy(file, "record").agg(F.count("*").alias("m"), F.sum("n").alias("bytes")).filter((F.col("m") > 1) & (F.col("bytes") <= longest))
    gathered = stored(numbers.join(split.select(file, "record").hint("merge"), [file, "record"]).select("_id", "record"), "split")
    discard(numbers)
    alone = lambda df: df.select(file, F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("record"))
    if not gathered.limit(1).count():
        discard(gathered)
        return alone(texts)
    marked = sized(gathered, MARKED)
    single = texts.join(marked, "_id", "left_anti")
    groups = texts.join(marked, "_id").groupBy(file, "record")
    groups = groups.agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).withColumn("joined", F.array_join(F.transform("l", lambda x: x.line), ""))
    whole = F.array(F.struct(F.element_at("l", 1).line_no.alias("start_line"), F.element_at("l", -1).line_no.alias("end_line"), F.col("joined").alias("record")))
    each = F.transform("l", lambda x: F.struct(x.line_no.alias("start_line"), x.line_no.alias("end_line"), x.line.alias("record")))
    found = groups.select(file, F.inline(F.when(parsed(F.col("joined")).isNotNull(), whole).otherwise(each)))
    return alone(single).unionByName(found)
