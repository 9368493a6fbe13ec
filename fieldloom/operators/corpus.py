"""Cleaning, chunking and recording of corpus texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, collapse_blank_lines, contains_any, lines, sanitize, strip, url_slug

# What the portal's pages repeat.
FOOTERS = ("CONTACT US", "PHILRICE TEXT CENTER", "DEPARTMENT OF AGRICULTURE", "Are you satisfied with PINOYRICE KNOWLEDGE BANK?")
UNWANTED = (
    "HOME", "RICE PRODUCTION", "RICE VARIETIES", "DOWNLOADS", "SEED GROWERS", "OFFLINE", "Search for:", "Menu -HOME",
    "Are you satisfied with PINOYRICE KNOWLEDGE BANK?", "uQuoted.com",
)
NOISE_WORDS = (
    "leave a reply", "0 reply", "1 reply", "2 reply", "replies", "years ago", "months ago", "days ago", "« previous", "next »",
    "subscribe", "post comment",
)
# Lines of page furniture, as one pattern, so that a line is looked at once.
NOISE_LINE = (
    r"(?i)^(\d*\s*Reply\s*$|\d+\s*(year|month|day)s?\s+ago\s*$|«\s*Previous\s*|Next\s*»|\d+\s*\.\.\.\s*\d+"
    r"|(Guest|Author|admin|Editor)\s*$|Posted\s+on\s+|Published\s+|Share\s*(this|on)\s*)"
)
DATE_LINE = r"(?i)^(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s*\d{4}$"


def split_text(text: str | None, size: int) -> list[str]:
    """Chunks of at most ``size`` characters: paragraphs packed greedily, long ones cut. Size 0: one."""
    text = (text or "").strip()
    if not text:
        return []
    if size <= 0 or len(text) <= size:
        return [text]
    out, held = [], ""
    for part in filter(None, (p.strip() for p in text.split("\n\n"))):
        if held and len(held) + 2 + len(part) <= size:
            held = f"{held}\n\n{part}"
            continue
        if held:
            out.append(held)
            held = ""
        if len(part) + 2 <= size or len(part) <= size:
            held = part
        else:
            out += filter(None, (part[i : i + size].strip() for i in range(0, len(part), size)))
    return [*out, held] if held else out


BLANK = SPACES + "\x1c\x1d\x1e\x1f"  # what Python strips


def chunks(text: Column, size: int) -> Column:
    """``array<string>`` of ``split_text``, by built-in functions, so that no texts go to Python; ``text`` is a
    column without ``BLANK`` characters at its ends (null: no chunks)."""
    none = F.array().cast("array<string>")
    if size <= 0:
        return F.when(text != "", F.array(text)).otherwise(none)
    trimmed = lambda xs: F.filter(F.transform(xs, lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    one = lambda c: F.when(c != "", F.array(c)).otherwise(none)

    def add(acc: Column, part: Column) -> Column:
        together = (acc.held != "") & (F.length(acc.held) + 2 + F.length(part) <= size)
        cut = trimmed(F.regexp_extract_all(part, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
        out = F.when(together, acc.out).when(F.length(part) <= size, F.concat(acc.out, one(acc.held))).otherwise(F.concat(acc.out, one(acc.held), cut))
        held = F.when(together, F.concat(acc.held, F.lit("\n\n"), part)).when(F.length(part) <= size, part).otherwise("")
        return F.struct(out.alias("out"), held.alias("held"))

    start = F.struct(none.alias("out"), F.lit("").alias("held"))
    packed = F.aggregate(trimmed(F.split(text, "\n\n")), start, add, lambda acc: F.concat(acc.out, one(acc.held)))
    return F.when(F.length(text) > size, packed).otherwise(F.when(text != "", F.array(text)).otherwise(none))


def chunk_records(docs: DataFrame, base_id: Column, size: int, least: int = 100, text_col: str = "text", always_suffix: bool = False) -> DataFrame:
    """One row per chunk: columns of ``docs``, chunk text and ``chunk_doc_id``. Chunks are numbered before
    short ones are dropped; a text of one chunk keeps its plain id (``always_suffix``: unless it was cut)."""
    cut = docs.withColumns({"_base": base_id, "_whole": F.btrim(F.col(text_col), F.lit(BLANK))}).withColumn("_chunks", chunks(F.col("_whole"), size))
    rows = cut.select(*docs.columns, "_base", F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("chunk", "chunk_text"))
    plain = (F.col("_n") == 1) if not always_suffix else (F.length(F.col(text_col)) <= size) | F.lit(size <= 0)
    ident = F.when(plain, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("_chunk_"), F.col("chunk").cast("string")))
    return rows.withColumn("chunk_doc_id", ident).filter(F.length("chunk_text") >= least).drop("_base", "_n")


def article_base_id(filename: Column, url: Column) -> Column:
    """File stem as id, with the URL's slug unless it ends with it."""
    stem = F.substring(F.regexp_replace(F.regexp_replace(filename, r"\.[^.]+$", ""), r"(?U)[^\w\-.]", "_"), 1, 120)
    slug = url_slug(url)
    return F.when((slug == "") | stem.endswith(slug), stem).otherwise(F.concat_ws("_", stem, slug))


def page_records(pages: DataFrame, size: int = 0, least: int = 100) -> DataFrame:
    """``pages(doc, page, text)`` -> ``{stem}_page_{n}`` records, with ``_chunk_{j}`` where a page is cut."""
    base = F.concat(F.col("doc"), F.lit("_page_"), F.col("page").cast("string"))
    out = chunk_records(pages, base, size, least)
    return out.withColumn("title", F.replace(F.replace("doc", F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))


def noise_lines(pages: DataFrame, ratio: float = 0.3, longest: int = 120) -> DataFrame:
    """``doc, noise``: lines on at least max(2, ratio x pages) pages of their document.

    Lines too long to be noise go before the shuffle; each line counts once a page, and the counts are
    summed in parts, so a document of many pages is no single task's.
    """
    with_text = pages.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    total = with_text.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    distinct = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: strip(x)))
    line = with_text.select("doc", "page", F.explode(distinct).alias("line")).filter((F.col("line") != "") & (F.length("line") <= longest))
    counts = line.groupBy("doc", "line").agg(F.count("*").alias("n")).filter("n >= 2")
    found = counts.join(total, "doc").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * ratio)))
    return found.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("noise"))


def clean_pages(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """Page texts without page numbers and noise lines; a line that goes leaves an empty one."""
    joined = pages.join(noise, "doc", "left")
    text = F.regexp_replace("text", "\r\n", "\n")
    kept = F.transform(
        F.split(text, "\n"),
        lambda x: F.when(x.rlike(r"^\s*\d{1,4}\s*$"), "").when(F.array_contains(F.coalesce("noise", F.array().cast("array<string>")), F.rtrim(x)), "").otherwise(x),
    )
    return joined.withColumn("text", sanitize(collapse_blank_lines(F.array_join(kept, "\n")))).drop("noise")


def clean_article(body: Column, title: Column, footer: str = r"(?i)For more information") -> Column:
    """Body up to the contact footer, without leading SHARE, date and title lines, blank lines merged."""
    cut = strip(F.get(F.split(body, footer, 2), F.lit(0)))
    rows = F.transform(F.split(cut, "\n"), strip)
    skip = lambda s: (s == "") | (F.upper(s) == "SHARE") | s.rlike(DATE_LINE) | F.coalesce(s == title, F.lit(False))
    flags = F.transform(rows, lambda s, i: F.when(~skip(s), i))
    first = F.array_min(flags)
    kept = F.when(first.isNotNull(), F.slice(rows, first + 1, F.size(rows))).otherwise(F.array().cast("array<string>"))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def clean_portal(text: Column, least: int = 100) -> Column:
    """Portal lines up to the footer, without menus, reply marks and short lines in capitals; "" if short."""
    rows = F.filter(F.transform(lines(text), strip), lambda s: s != "")
    footer = lambda s: contains_any(F.upper(s), tuple(m.upper() for m in FOOTERS))
    end = F.array_min(F.transform(rows, lambda s, i: F.when(footer(s), i)))
    rows = F.when(end.isNotNull(), F.slice(rows, F.lit(1), end)).otherwise(rows)

    def noise(s: Column) -> Column:
        capitals = (F.length(s) <= 80) & (F.length(F.regexp_replace(s, r"\P{L}", "")) >= 5) & (s == F.upper(s))
        return contains_any(F.upper(s), tuple(u.upper() for u in UNWANTED)) | contains_any(F.lower(s), NOISE_WORDS) | s.rlike(NOISE_LINE) | capitals

    out = F.array_join(F.filter(rows, lambda s: ~noise(s)), "\n")
    return F.when(F.length(out) >= least, out).otherwise("")


def article_until_moods(full: Column) -> Column:
    """Article text up to "Leave a Reply", and through the mood list if there is one."""
    # The marks of the reply and mood boxes, the moods, and 350 characters where none is rated.
    head = strip(F.get(F.split(full, "(### )?Leave a Reply", 2), F.lit(0)))
    at = F.instr(F.upper(head), "HOW DOES THIS POST MAKE YOU FEEL")
    rest = F.substr(head, at, F.length(head))
    rated = F.regexp_extract(rest, r"(?is)^(.*?(?:ANGRY|SAD|BORED|AMUSED|FASCINATED|EXCITED)\s*\d+\s*%)", 1)
    last = F.regexp_extract(rest, r"(?is)^(.*ANGRY)", 1)
    tail = F.when(rated != "", rated).when(last != "", last).otherwise(F.substring(rest, 1, 350))
    return F.when(at > 0, strip(F.concat(F.substr(head, F.lit(1), at - 1), tail))).otherwise(head)


def parse_article(raw: Column) -> Column:
    """``URL:`` / ``Title:`` / optional ``Date:`` lines, then the body -> struct(url, title, body)."""
    text = strip(raw)
    rows = F.split(text, "\n")
    tagged = text.startswith("URL:")
    has = lambda i, tag: F.coalesce(F.lower(F.trim(F.get(rows, F.lit(i)))).startswith(tag), F.lit(False))
    start = F.when(has(2, "date:"), 4).otherwise(3)
    body = F.when(F.size(rows) >= start, strip(F.array_join(F.slice(rows, start, F.greatest(F.lit(1), F.size(rows))), "\n"))).otherwise(text)
    return F.struct(
        F.when(tagged, strip(F.replace(F.get(rows, F.lit(0)), F.lit("URL:"), F.lit("")))).otherwise("").alias("url"),
        F.when(tagged & has(1, "title:"), strip(F.replace(F.get(rows, F.lit(1)), F.lit("Title:"), F.lit("")))).otherwise("").alias("title"),
        F.when(tagged, body).otherwise(text).alias("body"),
    )


def document_key(rows: DataFrame) -> Column:
    """What makes two hits one document: source, and the first of its names that is not blank."""
    fields = [c for c in ("title", "url", "pdf_url", "source_url", "doc_id", "filename") if c in rows.columns]
    name = F.coalesce(*(F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")) for c in fields), F.lit(""))
    return F.concat_ws("\t", F.lower(F.trim("source_id")), name)


def searchable(rows: DataFrame) -> Column:
    parts = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in ("url", "filename", "doc_id", "title") if c in rows.columns]
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), parts)


def looks_like(rows: DataFrame, kind: str) -> Column:
    """``news`` or ``papers``: by source, page number and names."""
    text, source = searchable(rows), F.lower(F.coalesce(F.col("source_id"), F.lit("")))
    if kind == "papers":
        return source.isin("philrice", "pinoyrice") | contains_any(text, ("paper", "publication", "research", "study", "journal", ".pdf"))
    page = F.col("page").isNotNull() if "page" in rows.columns else F.lit(False)
    return (source == "philrice_news") | (~page & ~text.contains(".pdf") & (text.contains("news") | (source == "irri")))


def latest_documents(rows: DataFrame, found: Column, limit: int, kind: str | None = None, score: str = "score", key: str = "point_id") -> DataFrame:
    """The newest ``limit`` documents with their date ``found``: newest first, then by score, then key.

    Rows without a date go; ``kind`` keeps only those that ``looks_like`` says are news or papers. Of
    the rows of one document the first in that order stays, by an aggregate with partial results, so
    copies neither fill the list nor gather in one task.
    """
    names = [F.col(f"`{c}`") for c in rows.columns if c != "found"]
    dated = rows.select(*names, found.alias("found"), document_key(rows).alias("_document"))
    dated = dated.filter(F.col("found").isNotNull() & (looks_like(rows, kind) if kind else F.lit(True)))
    worth = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    order = F.struct(-F.unix_date("found"), -worth, F.col(key))
    best = dated.groupBy("_document").agg(F.min_by(F.struct(*names, "found"), order).alias("r")).select("r.*")
    return best.orderBy(F.desc("found"), worth.desc(), key).limit(limit)
