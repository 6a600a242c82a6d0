"""What a file carries: chosen columns in order, repeats, previews, documents."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions.urls import absolute_link, displayed_link, search_domain, search_url
from rankframe.operators.running import firsts

PREVIEW_RECORDS, PREVIEW_AMONG = 10, 100
CSV, TXT, JSONL = "csv", "txt", "jsonl"
FORMATS = (CSV, TXT, JSONL)
LF, CRLF = "\n", "\r\n"
TAB = "\t"


class LayoutError(ValueError):
    """A layout that cannot be written."""


@dataclass(frozen=True)
class FileColumn:
    """One column a file can carry: its name, the table's column, how text and
    JSON show it, and its JSON key where that is another word."""

    name: str
    source: str
    kind: str = "text"
    key: str | None = None

    def text(self) -> Column:
        c = F.col(self.source)
        if self.kind == "related":
            return F.when(F.coalesce(c, F.lit(False)), "false").otherwise("true")
        if self.kind == "score":
            return F.when(c.isNotNull(), F.format_string("%.3f", c.cast("double"))).otherwise("")
        return F.coalesce(c.cast("string"), F.lit(""))

    def value(self) -> Column:
        c = F.col(self.source)
        if self.kind == "related":
            return ~F.coalesce(c, F.lit(False))
        return c if self.kind in ("number", "flag", "score") else F.coalesce(c, F.lit(""))


def _number(name: str, source: str | None = None) -> FileColumn:
    return FileColumn(name, source or name, "number")


def _text(name: str, source: str | None = None) -> FileColumn:
    return FileColumn(name, source or name)


# The columns of each kind of file, in the order they are written.
CATALOGS: dict[str, tuple[FileColumn, ...]] = {
    "results": (
        _number("ordinal"), _text("query"), _number("page"), _number("rank"), _text("title"), _text("url"),
        _text("link"), _text("host"), _text("snippet"), _text("path", "display_path"),
    ),
    "ads": (
        _number("ordinal"), _text("query"), _number("page"), _number("position"), _text("placement"),
        _text("title"), _text("host"), _text("url"), _text("snippet"),
    ),
    "related": (_number("ordinal"), _text("query"), _number("page"), _number("position"), _text("text")),
    "completions": (
        _number("ordinal"), _text("key", "query"), _text("suggestion", "title"),
        FileColumn("related", "offtopic", "related"), FileColumn("similarity", "similarity", "score"),
    ),
    "verdicts": (_number("ordinal"), FileColumn("address", "target", key="target"), FileColumn("held", "held", "flag")),
}


@dataclass(frozen=True)
class Layout:
    """How a file is written; checked when it is made, before anything is."""

    catalog: str
    fields: tuple[str, ...] | None = None
    format: str = CSV
    header: bool = True
    eol: str = LF
    sep: str = TAB
    unique: bool = False
    bom: bool = False

    def __post_init__(self):
        if self.format not in FORMATS:
            raise LayoutError(f"{self.format!r} is none of {FORMATS}")
        if self.eol not in (LF, CRLF):
            raise LayoutError("a line ends with LF or CRLF")
        names = [c.name for c in CATALOGS[self.catalog]]
        chosen = default_fields(self.catalog) if self.fields is None else tuple(self.fields)
        if not chosen:
            raise LayoutError("no column was chosen")
        for at, name in enumerate(chosen):
            if name not in names:
                raise LayoutError(f"{name!r} is not a column of this file")
            if name in chosen[:at]:
                raise LayoutError(f"{name!r} is chosen twice")
        object.__setattr__(self, "fields", chosen)

    def columns(self) -> list[FileColumn]:
        known = {c.name: c for c in CATALOGS[self.catalog]}
        return [known[name] for name in self.fields]


def default_fields(catalog: str) -> tuple[str, ...]:
    """Every column, but for the two judgements of a suggestion."""
    return tuple(c.name for c in CATALOGS[catalog] if c.name not in ("related", "similarity"))


def separator(text: str) -> str:
    """The one character a text file is separated by; nothing is the tab."""
    if text.strip().lower() in ("", "tab", "\\t"):
        return TAB
    if len(text) != 1:
        raise LayoutError(f"{text!r}: one character, or nothing for a tab")
    if text == '"':
        raise LayoutError("a quote is what a field is quoted with")
    return text


def project_layout(rows: DataFrame, layout: Layout, keep: Sequence[str] = ()) -> DataFrame:
    """The chosen columns as text, in order; ``keep`` carries sort keys along."""
    return rows.select(*[F.col(k).alias(f"__{k}") for k in keep], *[c.text().alias(c.name) for c in layout.columns()])


def distinct_layout(rows: DataFrame, layout: Layout, order: Sequence[str]) -> DataFrame:
    """Rows without those whose chosen columns, as text, repeat an earlier row's."""
    return firsts(rows, [c.text().alias(f"__text_{c.name}") for c in layout.columns()], order)


def preview(rows: DataFrame, layout: Layout, order: Sequence[str]) -> DataFrame:
    """The first ten records of the file. Where repeats are left out they are
    looked for among the first rows only, and among more of them until ten
    records are found or the rows end: the table itself is never grouped."""
    if not layout.unique:
        return rows.orderBy(*order).limit(PREVIEW_RECORDS)
    among = PREVIEW_AMONG
    while True:
        first = rows.orderBy(*order).limit(among)
        kept = distinct_layout(first, layout, order).orderBy(*order).limit(PREVIEW_RECORDS)
        if kept.count() == PREVIEW_RECORDS or first.count() < among:
            return kept
        among *= PREVIEW_AMONG


def number_text(c: Column) -> Column:
    """A double in its shortest form: 1 rather than 1.0, 0.0005 rather than 5.0E-4."""
    size = F.abs(c)
    plain = F.regexp_replace(c.cast("string").cast("decimal(38,24)").cast("string"), r"\.?0+$", "")
    # Very small and very large ones keep their exponent, written 1e-7.
    short = F.replace(F.lower(c.cast("string")), F.lit(".0e"), F.lit("e"))
    large = F.when(size < 1e21, c.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(short, "e([0-9])", "e+$1"))
    return F.when(c == 0, "0").when(size < 1e-6, short).when(size < 1e13, plain).otherwise(large)


def json_line(layout: Layout) -> Column:
    """A record as one JSON object: keys in order, numbers and yes/no as such."""
    parts, plain = [], []

    def close() -> None:
        if plain:
            parts.append(F.regexp_extract(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1))
            plain.clear()

    for c in layout.columns():
        key = c.key or c.name
        if c.kind == "score":
            close()
            parts.append(F.concat(F.lit(f'"{key}":'), F.coalesce(number_text(c.value().cast("double")), F.lit("null"))))
        else:
            plain.append(c.value().alias(key))
    close()
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def text_line(layout: Layout) -> Column:
    """A record as a line of text; what would break a column becomes a blank."""
    breaks = layout.sep + "\r\n"
    cells = [F.translate(c.text(), breaks, " " * len(breaks)) for c in layout.columns()]
    return F.concat_ws(layout.sep, *cells)


def _quoted(c: Column, eol: str) -> Column:
    inside = F.replace(c, F.lit('"'), F.lit('""'))
    if eol == CRLF:
        inside = F.replace(F.replace(inside, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(CRLF))
    # A lone \. would end some readers' input; a leading blank would be lost.
    needs = c.rlike(r'[",\r\n]') | c.rlike(r"^[\s\x{85}\p{Z}]") | (c == "\\.")
    return F.when(needs, F.concat(F.lit('"'), inside, F.lit('"'))).otherwise(c)


def csv_line(layout: Layout) -> Column:
    return F.concat_ws(",", *[_quoted(c.text(), layout.eol) for c in layout.columns()])


def record_line(layout: Layout) -> Column:
    return {CSV: csv_line, TXT: text_line}.get(layout.format, json_line)(layout)


def header_line(layout: Layout) -> str:
    return ("," if layout.format == CSV else layout.sep).join(layout.fields)


def results_ndjson(rows: DataFrame) -> DataFrame:
    """A job's results (see ``history.job_rows``) in their narrower JSON form."""
    names = ("ordinal", "query", "page", "rank", "title", "url", "host", "snippet")
    return rows.select("ordinal", "rank", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))


def history_ndjson(rows: DataFrame) -> DataFrame:
    """A site's history (see ``history.site_history``) as JSON lines."""
    taken = F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("taken_at")
    line = F.to_json(F.struct("job_id", "job_name", taken, "query", "rank", "url"), {"ignoreNullFields": "false"})
    return rows.select("job_id", "ordinal", "rank", line.alias("line"))


def serp_documents(serps: DataFrame) -> DataFrame:
    """One nested JSON document per captured page.

    ``serps`` is what ``pages.extract_serps`` gives, with query, country and
    language: a page's results already stand in one row, so nothing is gathered.
    A page without an origin belongs to the domain its query is asked at. What
    was not said (country, language, a snippet) is left out.
    """
    domain = search_domain(F.col("country"))
    origin = F.coalesce(F.nullif("origin", F.lit("")), F.concat(F.lit("https://"), domain))
    link = F.transform(
        "results",
        lambda r: F.struct(
            r["position"].alias("position"),
            r["title"].alias("title"),
            F.when(r["url"] != "", r["url"])
            .otherwise(F.coalesce(absolute_link(origin, r["link"])["url"], r["link"]))
            .alias("link"),
            displayed_link(r["host"], r["display_path"], r["url"]).alias("displayed_link"),
            F.nullif(r["snippet"], F.lit("")).alias("snippet"),
        ),
    )
    more = F.transform(
        "related",
        lambda q: F.struct(
            q.alias("query"), search_url(q, F.col("country"), F.col("language"), F.lit(1)).alias("link")
        ),
    )
    asked = F.struct(
        F.lit("google").alias("engine"), F.col("query").alias("q"), F.regexp_replace(domain, r"^www\.", "").alias("google_domain"),
        F.nullif("country", F.lit("")).alias("gl"), F.nullif("language", F.lit("")).alias("hl"), F.lit("desktop").alias("device"),
    )
    document = F.struct(
        asked.alias("search_parameters"),
        link.alias("organic_results"),
        F.when(F.size(more) > 0, more).alias("related_searches"),
        F.size("ads").alias("ads_omitted"),
    )
    return serps.withColumn("document", F.to_json(document))
