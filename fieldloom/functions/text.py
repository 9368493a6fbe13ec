"""Text, id and URL expressions: ``Column -> Column``, built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"  # scheme, host, path (RFC 3986, appendix B)

# The namespaces of the three kinds of row ids.
YIELD_NAMESPACE = "8b9c2d4a-1f3e-4b7c-9a5d-6e8f0a1b2c3d"
PRICE_NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
CORPUS_NAMESPACE = "c4e8f1a2-6b3d-4e5f-8a9c-0d1e2f3a4b5c"


# The white space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def to_number(c: Column) -> Column:
    """The double a string spells, else null; no suffixes, infinities or NaN."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def to_year(c: Column, lenient: bool = False) -> Column:
    """Integer year; ``lenient`` also takes ``2018.0``."""
    return to_number(c).try_cast("int") if lenient else F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("int"))


def uuid5(namespace: str, raw: Column) -> Column:
    """Name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(raw, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.lower(F.hex(nibble)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def row_id(namespace: str, *parts: str | Column) -> Column:
    return uuid5(namespace, F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)))


def sanitize(c: Column) -> Column:
    """Line-break controls that are no line feed become spaces, CRLF and CR line feeds; stripped."""
    c = F.regexp_replace(c, "[\\x85\\u2028\\u2029\\x0B\\x0C]", " ")
    return F.coalesce(strip(F.regexp_replace(c, "\r\n?", "\n")), F.lit(""))


def collapse_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def lines(c: Column) -> Column:
    """All lines, at every kind of line break; no empty line after a final break."""
    parts = F.split(c, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def url_part(c: Column, n: int) -> Column:
    return F.regexp_extract(c, URL, n)


def url_key(c: Column) -> Column:
    """Lower-case scheme and host with the path; no query, fragment or trailing slash."""
    s = strip(c)
    scheme, host, path = F.lower(url_part(s, 1)), F.lower(url_part(s, 2)), F.regexp_replace(url_part(s, 3), "/+$", "")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(""), host, path)


def id_from_url(c: Column, size: int = 120, fallback: str = "doc") -> Column:
    """The path with everything but letters, digits, ``_-.`` as ``_``."""
    path = F.regexp_replace(url_part(c, 3), "^/+|/+$", "")
    path = F.when(path == "", F.lit(fallback)).otherwise(path)
    return F.substring(F.regexp_replace(path, r"(?U)[^\w\-.]", "_"), 1, size)


def url_slug(c: Column, size: int = 48) -> Column:
    """Last part of the path as a slug, with eight digits of its SHA-1; empty where there is none."""
    last = strip(F.element_at(F.split(F.regexp_replace(url_part(c, 3), "^/+|/+$", ""), "/"), -1))
    slug = F.regexp_replace(F.regexp_replace(F.lower(last), r"(?U)[^\w\-]", "_"), "_+", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.when(F.coalesce(last, F.lit("")) == "", "").otherwise(F.concat(F.substring(slug, 1, size), F.lit("_"), F.substring(F.sha1(slug), 1, 8)))


KEPT = "abcdefghijklmnopqrstuvwxyz0123456789-"  # in tokens, beside "_"
COMMON_SIGNS = " #.,:/()&'"


def safe_token(c: Column, fallback: str = "unknown", size: int = 80) -> Column:
    """Lower-case token of ASCII letters, digits, ``_`` and ``-``. Patterns take most of a row's time, so they are
    left to strings with runs of other characters, or with other ones than common signs."""
    s = F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    spaced = F.translate(s, COMMON_SIGNS, " " * len(COMMON_SIGNS))
    single = (F.translate(spaced, f"{KEPT}_ ", "") == "") & ~F.contains(spaced, F.lit("  "))
    clean = F.when(single, F.translate(spaced, " ", "_")).otherwise(F.regexp_replace(s, "[^a-zA-Z0-9_-]+", "_"))
    return F.when((s != "nan") & (F.translate(s, KEPT, "") != s), F.substring(F.btrim(clean, F.lit("_")), 1, size)).otherwise(fallback)


def title_slug(c: Column, size: int = 100, fallback: str = "unknown") -> Column:
    s = F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s\-]", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(F.substring(s, 1, size))


def clean_title(c: Column, suffix: str, fallback: str = "unknown") -> Column:
    """Without an institute's suffix (a pattern), spaces squeezed."""
    t = F.regexp_replace(strip(F.regexp_replace(c, suffix, "")), r"(?U)\s+", " ")
    return F.when(F.coalesce(t, F.lit("")) == "", fallback).otherwise(t)


def contains_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a string holds any of the words anywhere."""
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words), F.lit(False))


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", F.round(c, 2))


def snippet(c: Column, size: int = 500) -> Column:
    return F.substring(strip(c), 1, size)


# The sites that are searched for documents without a link.
SEARCH_PAGES = {"pinoyrice": "https://www.pinoyrice.com/?s=", "philrice": "https://www.philrice.gov.ph/?s="}


def source_link(source_id: Column, title: Column, filename: Column, *links: Column) -> Column:
    """The first link that is not blank; else, for sources with a site, a search for the title or file name."""
    known = F.coalesce(*(blank_to_null(c) for c in links), F.lit(None).cast("string"))
    wanted = F.coalesce(blank_to_null(title), blank_to_null(filename))
    quoted = F.replace(F.replace(F.url_encode(wanted), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    site = reduce(lambda a, b: a.when(F.lower(source_id) == b[0], b[1]), SEARCH_PAGES.items(), F.when(F.lit(False), ""))
    return F.coalesce(known, F.concat(site, quoted))


def seed_urls(c: Column) -> Column:
    """The http(s) URLs of a list set apart by spaces and commas."""
    return F.filter(F.split(c, r"[\s,]+"), lambda x: x.startswith("http://") | x.startswith("https://"))


def app_url(c: Column, host: str, listing: str = "/dataproducts", app: str = "/wp-dynamicreports") -> Column:
    """URLs of a host's listing pages -> URL of the application they wrap; others unchanged."""
    path = F.regexp_replace(F.lower(url_part(c, 3)), "/+$", "")
    inside = path.endswith(listing) | path.contains(f"{listing}/")
    scheme = F.when(url_part(c, 1) == "", "https").otherwise(url_part(c, 1))
    return F.when(F.lower(url_part(c, 2)).contains(host) & inside, F.concat(scheme, F.lit(f"://{host}{app}"))).otherwise(c)


def table_text(rows: Column) -> Column:
    """``array<array<string>>`` -> lines of cells with bars between."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | ")), "\n")
