"""Text, price, date and URL normalisation as Column -> Column expressions; none needs Python."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F



def null_string() -> Column:
    return F.lit(None).cast("string")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Mail addresses in Java's syntax.  A match begins where a run of local characters does, or behind the match
#: before it, so that long runs without an @ are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# ---- text


def clean_text(c: Column) -> Column:
    """White space of any kind collapsed to one space, trimmed; null gives the empty string."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def strip_control(c: Column, collapse_ws: bool = True) -> Column:
    """Control characters other than line breaks and tabs removed, white space collapsed unless told not to."""
    bare = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")) if collapse_ws else bare


def safe_filename(c: Column, length: int = 50) -> Column:
    return F.left(F.regexp_replace(c, r"(?U)[^\w\s-]", ""), F.lit(length))


def is_falsy(c: Column, kind: str) -> Column:
    """Null, and what counts as nothing in the column's type: empty, zero, false."""
    if kind == "string":
        empty = c == ""
    elif kind == "boolean":
        empty = ~c
    elif kind.startswith(("array", "map")):
        empty = F.size(c) == 0
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        empty = c == 0
    else:
        empty = F.lit(False)
    return c.isNull() | empty


STOP_WORDS = (
    # fixed values
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
)


def keywords(c: Column, most: int = 10) -> Column:
    """Different words of over three ASCII letters, without stop words, in alphabetical order."""
    words = F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z]+"), F.lit(0))
    long_ = F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))
    return F.slice(F.array_sort(F.array_distinct(long_)), 1, most)


def selector_map(c: Column) -> Column:
    """"a:b,c:d" as a map; parts without a colon are skipped."""
    parts = F.filter(F.split(c, ","), lambda p: p.contains(":"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))), F.trim(F.split_part(p, F.lit(":"), F.lit(2))))))


def record_key(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


# ---- numbers

CURRENCIES = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"))  # fixed values


def currency(c: Column, compat: bool = True) -> Column:
    """By the first symbol that occurs; dollars of Australia and Canada only if not compat."""
    out = None
    rules = CURRENCIES if compat else (("A$", "AUD"), ("C$", "CAD"), *CURRENCIES)
    for symbol, code in rules:
        out = F.when(c.contains(symbol), code) if out is None else out.when(c.contains(symbol), code)
    return out.otherwise("USD")


def price(c: Column, compat: bool = True) -> Column:
    """struct(amount double, currency): digits and dots are kept; two dots give null."""
    kept = F.regexp_replace(blank(c), r"[^\d.]", "")
    return F.struct(kept.try_cast("double").alias("amount"), currency(blank(c), compat).alias("currency"))


def first_price(c: Column) -> Column:
    """The first number, commas dropped."""
    return F.nullif(F.regexp_extract(F.replace(blank(c), F.lit(","), F.lit("")), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def rating(c: Column) -> Column:
    return F.nullif(F.regexp_extract(blank(c), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def review_count(c: Column) -> Column:
    """1,234 and 1.2K and 3M as whole numbers; 0 if there is none."""
    low = F.replace(F.lower(blank(c)), F.lit(","), F.lit(""))
    number = F.nullif(F.regexp_extract(low, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(low, r"\d+\.?\d*\s*([km])", 1)
    scale = F.when(unit == "k", 1000).when(unit == "m", 1000000).otherwise(1)
    return F.coalesce(F.round(number * scale, 6).cast("bigint"), F.lit(0).cast("bigint"))


def availability(c: Column, strict: bool = False) -> Column:
    """Ordered rules; "unavailable" holds "available" and so is in stock unless strict."""
    low = F.lower(blank(c))
    out = low.rlike("out of stock|unavailable|sold out")
    stock = low.rlike("in stock|available")
    if strict:
        return F.when(out, "out_of_stock").when(stock, "in_stock").when(low.contains("pre-order"), "pre_order").otherwise("unknown")
    return F.when(stock, "in_stock").when(out, "out_of_stock").when(low.contains("pre-order"), "pre_order").otherwise("unknown")


def backoff(attempt: Column, initial: float = 1.0, base: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(base), attempt), F.lit(most))


# ---- contacts and dates


def clean_email(c: Column) -> Column:
    low = F.lower(F.trim(blank(c)))
    return F.when(low.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), low).otherwise("")


def clean_phone(c: Column) -> Column:
    digits = F.regexp_replace(blank(c), r"[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits)


DATE_FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def clean_date(c: Column) -> Column:
    """ISO date by the first format that fits, days before months; else the trimmed text."""
    text = F.trim(blank(c))
    tries = [F.date_format(F.try_to_timestamp(text, F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS]
    return F.coalesce(*tries, text)


# ---- urls


def scheme(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"^[^?#]*\?([^#]*)", 1)


def query_names(url: Column) -> Column:
    """The parameters' names, in order."""
    parts = F.filter(F.split(url_query(url), "&"), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.substring_index(p, "=", 1))


def rstrip_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def absolute_url(base: Column, link: Column) -> Column:
    """RFC 3986 resolution of absolute, scheme-relative, rooted, query, fragment and sibling references;
    dot segments are removed."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = (
        F.when(scheme(link) != "", link).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link)).when(link == "", F.substring_index(base, "#", 1))
        .when(link.startswith("?"), F.concat(root, url_path(base), link)).when(link.startswith("#"), F.concat(F.substring_index(base, "#", 1), link))
        .otherwise(F.concat(root, folder, link))
    )
    return F.when(whole.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/\.\.?(?:/|$|[?#])"), _without_dots(whole)).otherwise(whole)


def _without_dots(url: Column) -> Column:
    parts = F.split(url_path(url), "/")
    walked = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda kept, p: F.when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(p == ".", kept).otherwise(F.concat(kept, F.array(p))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/"), F.array_join(walked, "/"), tail, rest)


def clean_url(c: Column, base: Column) -> Column:
    """Without the fragment, absolute."""
    bare = F.substring_index(F.trim(blank(c)), "#", 1)
    return F.when(bare == "", "").when(bare.startswith("http"), bare).otherwise(absolute_url(base, bare))


def normalize_page_url(c: Column) -> Column:
    """For site maps: null without scheme and host, no query, no fragment, no final slash."""
    path = url_path(c)
    kept = F.when(rstrip_slash(path) == "", "/").otherwise(rstrip_slash(path))
    return F.when((scheme(c) == "") | (netloc(c) == ""), null_string()).otherwise(F.concat(scheme(c), F.lit("://"), netloc(c), kept))


def normalize_record_url(c: Column) -> Column:
    """For records: trimmed, cut at the first ?, no final slash; a fragment before it stays."""
    return rstrip_slash(F.substring_index(F.trim(c), "?", 1))


def base_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def page_urls(base: Column, pages: Column, param: str = "page", offset: bool = False, limit: int = 20) -> Column:
    """The urls of pages 0 to pages - 1: page numbers from 1, or offsets."""
    join = F.when(base.contains("?"), "&").otherwise("?")
    value = (lambda i: i * limit) if offset else (lambda i: i + 1)
    return F.when(pages > 0, F.transform(F.sequence(F.lit(0), pages - 1), lambda i: F.concat(base, join, F.lit(f"{param}="), value(i).cast("string")))).otherwise(F.array().cast("array<string>"))


def search_url(base: str, query: Column, **more: Column) -> Column:
    parts = [F.lit(base), F.lit("?q="), F.url_encode(query)]
    for k, v in more.items():
        parts += [F.lit(f"&{k}="), F.url_encode(v.cast("string"))]
    return F.concat(*parts)


def short_id(c: Column, length: int = 16) -> Column:
    return F.substring(F.md5(c), 1, length)


def cache_key(url: Column, selectors: Column) -> Column:
    """md5 of url:selectors, the map sorted by key and written with a space after , and : ."""
    pairs = F.transform(F.array_sort(F.map_entries(selectors)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')))
    return F.md5(F.concat(url, F.lit(":{"), F.array_join(pairs, ", "), F.lit("}")))


def domain_pattern(host: Column) -> Column:
    return F.regexp_replace(host, r"\d+", "*")


# ---- lookups

CATEGORIES = {
    # fixed values
    "bot_detected": "anti_detection",
    "cloudflare": "protection",
    "rate_limited": "rate_limiting",
    "captcha": "captcha",
    "js_required": "rendering",
    "auth_required": "authentication",
    "empty_content": "data_extraction",
    "http_error": "network",
}


def lookup(c: Column, values: Mapping[str, str], otherwise: Column | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(null_string() if otherwise is None else otherwise)
