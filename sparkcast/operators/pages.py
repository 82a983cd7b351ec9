"""Page text, prompts, answer parsing and the occurrence matrix
(T1-T6, F5, F6, F14, F15, F18, A14, A15, P19, P20).

Comments, scripts and styles are removed first (they may hold a literal
``</p>``). The p and li elements nest and close each other as a browser's
document has them, which regular expressions can't follow: one Arrow-batched
helper walks the tags of a page and gives the text of each element. Character
references, named and numeric, are decoded as HTML has them.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fill_placeholders, list_placeholder

WS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
HIDDEN_RE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
BODY_RE = r"(?is)<body(?:\s[^>]*)?>(.*)</body>"
FIRST_P_RE = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
FIRST_DIV_RE = r"(?is)<div(?:\s[^>]*)?>(.*?)</div>"


def strip_ws(col: Column) -> Column:
    """Trim leading/trailing whitespace: the characters Python's ``str.strip``
    removes (ASCII whitespace, information separators, Unicode spaces)."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def clean_html(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN_RE, "")


def _decode(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or "&" not in t else _html.unescape(t) for t in texts.to_pylist()], pa.string())


def html_text(fragment: Column) -> Column:
    """Tags removed, character references decoded, trimmed."""
    return strip_ws(F.arrow_udf(_decode, "string")(F.regexp_replace(fragment, "<[^>]*>", "")))


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<[^>]*>")
# fixed values: elements whose start ends an open paragraph
_ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul
    li""".split())
_LISTS = frozenset(("ul", "ol", "menu", "dir"))
# fixed values: further elements whose end ends what is open in them
_HOLDERS = (_ENDS_P | frozenset("body html table thead tbody tr td th button object".split())) - {"hr", "p", "li"} - _LISTS


def block_texts(page: str) -> list[str]:
    """Trimmed text of every p and li of a page without comments and scripts,
    in document order. An element's text holds that of those nested in it."""
    out: list[list[str]] = []
    stack: list[tuple[str, int]] = []            # open elements, p and li with their place in out

    def close(names, until=()):
        """Close the innermost of the named elements and what is open in it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    def text(part):
        for _, i in stack if part else ():
            if i >= 0:
                out[i].append(part)

    at = 0
    for m in _TAG.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if m[1]:
            if name == "p":
                close(("p",), ("li", *_LISTS))
            elif name == "li":
                close(("li",), _LISTS)
            elif name in _LISTS:
                close(_LISTS)
            elif name in _HOLDERS:
                close((name,))
        elif name:
            if name in _ENDS_P:
                close(("p",), ("li", *_LISTS))
            if name == "li":
                close(("li",), _LISTS)
            if name in ("p", "li"):
                stack.append((name, len(out)))
                out.append([])
            elif name in _LISTS or name in _HOLDERS:
                stack.append((name, -1))
    text(page[at:])
    return [_html.unescape("".join(x)).strip() for x in out]


def _blocks(min_len: int):
    def run(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            kept = [t for t in block_texts(page) if len(t) > min_len] if page else []
            out.append("\n".join(kept) if kept else None)
        return pa.array(out, pa.string())
    return run


def page_blocks(html: Column | str, min_len: int = 30) -> Column:
    """Text of every p/li element longer than ``min_len`` characters,
    newline-joined; null when there is none. Nested elements count each."""
    html = F.col(html) if isinstance(html, str) else html
    return F.arrow_udf(_blocks(min_len), "string")(clean_html(html))


def _first(html: Column, pattern: str) -> Column:
    return html_text(F.regexp_extract(html, pattern, 1))


def page_fallback(html: Column | str, min_len: int = 500) -> Column:
    """T2 (Q12 fixed): body text when long enough, else the first paragraph,
    else the first div; null when none reaches ``min_len``.
    Returns ``struct<source string, text string>``."""
    html = F.col(html) if isinstance(html, str) else html
    h = clean_html(html)
    body, p, div = _first(h, BODY_RE), _first(h, FIRST_P_RE), _first(h, FIRST_DIV_RE)
    src = (F.when(F.length(body) >= min_len, F.lit("body"))
           .when(F.length(p) >= min_len, F.lit("p"))
           .when(F.length(div) >= min_len, F.lit("div")))
    txt = (F.when(F.length(body) >= min_len, body)
           .when(F.length(p) >= min_len, p)
           .when(F.length(div) >= min_len, div))
    return F.struct(src.alias("source"), txt.alias("text"))


def best_text(extracted: Column, html: Column, min_len: int = 1000) -> Column:
    """The first extractor's text when longer than ``min_len``, else T1."""
    return F.when(F.length(extracted) > min_len, extracted).otherwise(page_blocks(html))


def prompts(articles: DataFrame, reminder: str, metrics: Column, text: str = "full_text",
            country: str = "country", max_chars: int | None = None) -> DataFrame:
    """T4 (+F3, F4, F15): the per-article prompt: reminder with the metric list
    and country filled, then the page text, whole unless ``max_chars`` cuts it."""
    r = list_placeholder(F.lit(reminder), metrics)
    r = fill_placeholders(r, {"country": F.col(country)})
    return articles.withColumn("prompt", F.concat_ws(" ", r, F.col(text) if max_chars is None else F.substring(F.col(text), 1, max_chars)))


def answer_rows(answers: DataFrame, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """T5 + P20: answers equal to 'no' (any case/space) dropped; the first
    line dropped; each further line split on commas, every cell trimmed
    (Q13): ``country``, ``metric`` (null when absent), ``dates`` (rest)."""
    a = answers.where(F.lower(strip_ws(F.col(text))) != "no")
    lines = F.split(strip_ws(F.col(text)), "\n")
    e = a.select(*keys, F.posexplode(lines).alias("line_no", "line")).where(F.col("line_no") >= 1)
    cells = F.transform(F.split(F.col("line"), ","), strip_ws)
    return e.select(*keys, "line_no", cells[0].alias("country"),
                    F.try_element_at(cells, F.lit(2)).alias("metric"),
                    F.filter(cells, lambda x, i: i >= 2).alias("dates"))


# fixed values: month names, and words of a date that say nothing about its month
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
FILLERS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun",
           "st", "nd", "rd", "th", "of", "at", "and", "am", "pm", "t", "z", "utc", "gmt"]
#: Two-digit years up to this are 20xx, others 19xx.
PIVOT = 68
_CLOCK_RE = r"t?\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([ap]m)?\s*(z|utc|gmt)?\s*([+-]\d{2}:?\d{2})?"


def _date_values(s: Column) -> Column:
    """The date's tokens as numbers, in order: a month's name as minus its number,
    digits as they are; null where a word is neither a month nor a filler."""
    names = {n: i for i, n in enumerate(MONTH_NAMES, 1)} | {n[:3]: i for i, n in enumerate(MONTH_NAMES, 1)} | {"sept": 9}
    words = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, -v)], *[F.lit(x) for k in FILLERS for x in (k, 0)])
    plain = F.regexp_replace(F.lower(strip_ws(s)), _CLOCK_RE, " ")
    tokens = F.filter(F.regexp_extract_all(plain, F.lit(r"(\d+|\p{L}+)")), lambda x: x != "")
    # eight digits are year, month and day
    tokens = F.flatten(F.transform(tokens, lambda x: F.when(x.rlike(r"^\d{8}$"), F.array(F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).otherwise(F.array(x))))
    values = F.transform(tokens, lambda x: F.when(x.rlike(r"^\d+$"), F.struct(x.try_cast("int").alias("v"), F.length(x).alias("len"), F.lit(False).alias("word")))
                         .otherwise(F.struct(F.try_element_at(words, x).alias("v"), F.lit(0).alias("len"), F.lit(True).alias("word"))))
    return F.filter(values, lambda x: ~(x["word"] & (F.coalesce(x["v"], F.lit(1)) == 0)))


def parse_month(s: Column | str) -> Column:
    """first of the month of a date in words and numbers, in any common order
    and with any separators; null when it names no month and year.

    Clock time, zone, weekday and ordinal ends are left out. A month's name is the
    month, wherever it stands; a number over 31 or of four digits is the year. Of
    numbers alone the year comes first or last; month before day where both fit.
    Two-digit years: see ``PIVOT``. A date that doesn't exist, a bare year (Q16), a
    month without a year and any other word give null (counted by the caller)."""
    s = F.col(s) if isinstance(s, str) else s
    # bound once, as the only element of an array, so that the tokens are made once a value
    ymd = F.transform(F.array(_date_values(s)), lambda v: _resolve(v))[0]
    y = ymd["y"]["v"]
    year = F.when(ymd["y"]["len"] <= 2, F.when(y <= PIVOT, y + 2000).otherwise(y + 1900)).when(ymd["y"]["len"] == 4, y)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(ymd["m"].cast("string"), 2, "0"), F.lpad(ymd["d"].cast("string"), 2, "0"))
    return F.when(year.isNotNull() & ymd["m"].between(1, 12) & ymd["d"].between(1, 31), F.trunc(F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))), "month"))


def _resolve(v: Column) -> Column:
    """Year, month and day of the values ``v``."""
    at = lambda i: F.get(v, F.lit(i))
    date = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    a, b, c = at(0), at(1), at(2)
    one, long = F.lit(1), (a["v"] > 31) | (a["len"] == 4)
    two = (F.when(a["word"] & (b["v"] > 31), date(b, -a["v"], one)).when(b["word"] & (a["v"] > 31), date(a, -b["v"], one))
           .when(a["word"] | b["word"], F.lit(None)).when(a["v"] > 31, date(a, b["v"], one)).when(b["v"] > 31, date(b, a["v"], one)))
    three = (F.when(a["word"], F.when(b["v"] > 31, date(b, -a["v"], c["v"])).otherwise(date(c, -a["v"], b["v"])))
             .when(b["word"], F.when(long, date(a, -b["v"], c["v"])).otherwise(date(c, -b["v"], a["v"])))
             .when(c["word"], F.when(b["v"] > 31, date(b, -c["v"], a["v"])).otherwise(date(a, -c["v"], b["v"])))
             .when(long, date(a, b["v"], c["v"])).when(a["v"] > 12, date(c, b["v"], a["v"])).otherwise(date(c, a["v"], b["v"])))
    bad = F.exists(v, lambda x: x["v"].isNull()) | (F.size(F.filter(v, lambda x: x["word"])) > 1)
    return F.when(bad, F.lit(None)).when(F.size(v) == 2, two).when(F.size(v) == 3, three)


def month_label(d: Column, fmt: str = "MM-yyyy") -> Column:
    """``MM-yyyy`` (or another pattern, e.g. ``MMMM-yyyy``)."""
    return F.date_format(d, fmt)


def occurrence_cells(rows: DataFrame, metrics: Sequence[str], countries: DataFrame | None = None,
                     fmt: str = "MM-yyyy") -> DataFrame:
    """Per metric x country x month of the full month range,
    1 when the country reported the metric in that month, else 0.

    ``rows``: ``country, metric, dates array<string>``. The month range runs
    from the first to the last parsed date of all rows (a scalar; its
    sequence is bounded by the calendar). ``countries`` defaults to the
    sorted distinct countries of ``rows`` (Q15); rows of other countries are
    dropped.
    """
    # one pass over the raw rows: distinct (country, metric, month); rows
    # without a parsable date keep a null month so their country still counts
    seen = (rows.select("country", "metric", F.explode_outer("dates").alias("d"))
            .select("country", "metric", parse_month("d").alias("month"))
            .distinct())
    from ..session import materialize
    seen = materialize(seen)
    hits = (seen.where(F.col("month").isNotNull())
            .select("metric", "country", "month", F.lit(1).alias("present")))
    if hits.limit(1).count() == 0:      # Q17: nothing to build a month range from
        raise ValueError("no valid dates found")
    rng = hits.select(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).scalar()
    cl = countries if countries is not None else seen.select("country").distinct()
    grid = (cl.select(F.col(cl.columns[0]).alias("country"))
            .select("country", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
            .select("country", "metric", F.explode(rng).alias("month")))
    j = grid.join(hits, ["metric", "country", "month"], "left")
    return j.select("metric", "country", month_label(F.col("month"), fmt).alias("month_label"),
                    "month", F.coalesce("present", F.lit(0)).alias("present"))


def occurrence_report(rows: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """F5/Q15 counts in one pass: date strings that parse to no month, and
    rows whose country is outside the given list (0 without a list)."""
    d = rows.select("country", F.explode_outer("dates").alias("d"))
    unparsed = F.sum(F.when(F.col("d").isNotNull() & parse_month("d").isNull(), 1).otherwise(0))
    if countries is None:
        return d.agg(unparsed.cast("long").alias("unparsed_dates"), F.lit(0).cast("long").alias("rows_outside"))
    cl = countries.select(F.col(countries.columns[0]).alias("country")).distinct()
    outside = rows.join(cl, "country", "left_anti").select(F.count(F.lit(1))).scalar()
    return (d.agg(unparsed.cast("long").alias("unparsed_dates"))
            .select("unparsed_dates", outside.alias("rows_outside")))


def matrix_wide(cells: DataFrame) -> DataFrame:
    """K4 shape: one row per (metric, country), one column per month label in
    month order. The label list is the bounded month range (collected once)."""
    labels = [r[0] for r in cells.select("month_label", "month").distinct().orderBy("month").collect()]
    return (cells.groupBy("metric", "country").pivot("month_label", labels).agg(F.max("present"))
            .orderBy("metric", "country"))
