"""Column expressions over text; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: White space that Unicode text may be trimmed of; a plain trim only drops blanks.
SPACES = r"\s\x{85}\x{A0}\x{1C}-\x{1F}\x{2028}\x{2029}\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACES}]+", ""), f"[{SPACES}]+$", "")


def preview(text: Column, most: int = 80) -> Column:
    """One line of at most ``most`` characters; dots mark what was cut, and stand alone where nothing else fits."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    if most <= 3:
        return F.when(F.length(flat) <= most, flat).otherwise("." * most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def ngrams(words: Column, n: int) -> Column:
    """The distinct runs of n words, space-joined; fewer words give none."""
    made = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.when(F.size(words) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def clean_pages(text: Column) -> Column:
    """Text of a page without lone page numbers, character codes, hyphens at line ends, and runs of white space."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(r"^(page )?[0-9]{1,4}$"))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\(cid:[0-9]+\)", " "), r"([\p{L}])-\n([\p{Ll}])", "$1$2")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def redact_lines(text: Column, words: tuple[str, ...] = ("api_key", "apikey", "secret", "token", "password", "authorization")) -> Column:
    """Every line that names something sensitive is hidden as a whole."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(f"(?i)({'|'.join(words)})"), "<hidden>").otherwise(x)), "\n")


# What names a metric, and the signs of formulas.
METRIC = r"(?i)\b(rrf\s*\(|mrr\b|recall@|hit@)"
SIGNS = "=+-*/^<>≈≤≥∑Σ∫√∂αβγλθ"


def formula_line(line: Column) -> Column:
    """Names a metric, or has a mathematical sign, a digit and a letter."""
    signs = "".join("\\" + c if c in "-^" else c for c in SIGNS)
    return line.rlike(METRIC) | (line.rlike(f"[{signs}]") & line.rlike(r"\p{Nd}") & line.rlike(r"\p{L}"))


def source_label(path: Column, first_page: Column, last_page: Column, table: Column | None = None) -> Column:
    """File name, its page or pages, and the table where a chunk is one; null pages and tables are left out."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    name = F.coalesce(F.nullif(F.regexp_extract(plain, r"([^/]*)$", 1), F.lit("")), path)
    last = F.coalesce(last_page, first_page)
    pages = F.when(first_page.isNull(), "").when(first_page == last, F.concat(F.lit(" p."), first_page.cast("string")))
    label = F.concat(name, pages.otherwise(F.concat(F.lit(" pp."), first_page.cast("string"), F.lit("-"), last.cast("string"))))
    return label if table is None else F.concat(label, F.when(first_page.isNotNull() & table.isNotNull(), F.concat(F.lit(" table "), table.cast("string"))).otherwise(""))


def source_lines(media_type: Column, first_page: Column, last_page: Column, block_types: Column, formula: Column, warnings: Column) -> Column:
    """What is known of where a chunk comes from, as an array of lines; only PDFs have pages, formulas and warnings."""
    pdf = F.coalesce(media_type == "application/pdf", F.lit(False))
    last = F.coalesce(last_page, first_page)
    pages = F.when(first_page == last, first_page.cast("string")).otherwise(F.concat_ws("-", first_page.cast("string"), last.cast("string")))
    kind = F.when(pdf, "type: pdf").when(media_type == "text/markdown", "type: markdown").when(media_type == "text/plain", "type: text")
    parts = F.array(
        kind, F.when(pdf & first_page.isNotNull(), F.concat(F.lit("page range: "), pages)), F.when(F.size(block_types) > 0, F.concat(F.lit("block type: "), F.array_join(block_types, ", "))),
        F.when(pdf & F.coalesce(formula, F.lit(False)), F.lit("possible formula: yes")), F.when(pdf & (F.size(warnings) > 0), F.concat(F.lit("warnings: "), F.array_join(warnings, ", "))),
    )
    return F.filter(parts, lambda x: x.isNotNull())
