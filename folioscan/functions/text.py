"""String, date and citation functions: columns to columns, no UDF."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import fixed, rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def empty(c: Column | str) -> Column:
    """The string, or '' for null: both mean missing."""
    return F.coalesce(col(c), F.lit(""))


def words(text: Column | str, least: int) -> Column:
    """Distinct lower-case runs of at least `least` letters a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(empty(text)), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))


def overlap_tokens(text: Column | str) -> Column:
    """Distinct words of two letters or more and decimal numbers, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(empty(text)), F.lit(r"[a-z]{2,}|[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def overlap_ratio(old: Column | str, new: Column | str) -> Column:
    """Share of old's tokens that new has; null if old has none."""
    return F.size(F.array_intersect(col(old), col(new))) / F.nullif(F.size(col(old)), F.lit(0))


def whitespace_folded(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; single spaces stay where they are."""
    return F.trim(F.regexp_replace(empty(text), r"[ \t\n\r\f\x0B]{2,}|[\t\n\r\f\x0B]", " "))


def header_field(value: Column | str, limit: int | None = None) -> Column:
    """A value without the characters that structure a source header."""
    safe = F.trim(F.translate(empty(value), "|][\n\r\t", "/)(   "))
    return F.substring(safe, 1, limit) if limit else safe


def dotted_date(iso: Column | str) -> Column:
    """2024-10-01 as 01.10.2024, 2024-10 as 10.2024; anything else unchanged, null as ''."""
    part = F.split(empty(iso), "-")
    return F.when(F.size(part) == 3, F.concat_ws(".", part[2], part[1], part[0])).when(F.size(part) == 2, F.concat_ws(".", part[1], part[0])).otherwise(empty(iso))


def citation(letter: Column | str, iso: Column | str) -> Column:
    date = dotted_date(iso)
    dated = F.concat(F.lit("dt. "), date)
    return F.when((empty(letter) != "") & (date != ""), F.concat(empty(letter), F.lit(", "), dated)).when(empty(letter) != "", empty(letter)).when(date != "", dated).otherwise("")


def page_label(page: Column | str, printed: Column | str) -> Column:
    page, printed = empty(col(page).cast("string")), empty(col(printed).cast("string"))
    both = F.concat(F.lit("p."), printed, F.lit(" (PDF p."), page, F.lit(")"))
    return F.when((printed != "") & (printed != page), both).when((page != "") & (page != "0"), F.concat(F.lit("p."), page)).otherwise("")


def compact(text: Column | str) -> Column:
    """Lower case, dashes unified, no plus-minus, decimal commas as points, no white space."""
    dashes = F.translate(F.lower(empty(text)), "–—~±", "---")
    return F.regexp_replace(F.regexp_replace(dashes, r"(?<=[0-9]),(?=[0-9])", "."), r"\s+", "")


def compact_designation(text: Column | str) -> Column:
    return F.translate(compact(text), "-/", "")


def value_in_context(value: Column | str, context: Column | str) -> Column:
    return F.contains(compact(context), compact(value))


def chunk_id(*parts: Column | str) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *(empty(col(p).cast("string")) for p in parts))), 1, 12)


def cache_key(model: str, dim: int, task: str, text: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(str(dim)), F.lit(task), empty(text)))


def question_language(text: Column | str) -> Column:
    """'hi' by script or by marker words, else 'en'."""
    text = empty(text)
    deva = F.length(text) - F.length(F.regexp_replace(text, "[\\x{0900}-\\x{097F}]", ""))
    token = F.array_distinct(F.split(F.lower(whitespace_folded(text)), " "))
    weak, strong = (F.array(*map(F.lit, x)) for x in (fixed.WEAK_MARKERS, fixed.STRONG_MARKERS))
    hindi = (deva > F.length(text) * 0.10) | text.rlike("[\\x{0600}-\\x{06FF}\\x{FB50}-\\x{FDFF}]") | F.arrays_overlap(token, strong) | (F.size(F.array_intersect(token, weak)) >= 2)
    return F.when((text != "") & hindi, "hi").otherwise("en")


def first_pattern(text: Column | str, patterns: dict[str, str], lower: bool = True) -> Column:
    """Name of the first pattern, in the given order, that the text has; else null."""
    subject = F.lower(empty(text)) if lower else empty(text)
    return F.coalesce(*(F.when(subject.rlike(p), F.lit(name)) for name, p in patterns.items()))


def spoken(text: Column | str, limit: int = 800) -> Column:
    """Markdown reduced to what is read aloud: the direct answer, without marks, at most `limit` characters."""
    text = empty(text)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    direct = F.regexp_extract(text, fixed.DIRECT_PART, 1)
    chosen = F.when(text.contains(fixed.DIRECT_ANSWER), bare(direct)).otherwise(text)
    steps = bare(F.regexp_extract(text, fixed.STEPS_PART, 1))
    chosen = F.when((F.length(chosen) < 50) & text.contains(fixed.STEPS), F.concat(chosen, F.lit(". "), steps)).otherwise(chosen)
    clean = whitespace_folded(reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), fixed.SPOKEN_PASSES, chosen))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("."))).otherwise(clean)


def symbols(text: Column | str, source: str, target: str) -> Column:
    """Symbol-font characters mapped one by one; other private-use characters are dropped."""
    return F.regexp_replace(F.translate(empty(text), source, target), "[\\x{E000}-\\x{F8FF}]", "")


def iso_day(x: Column) -> Column:
    """ISO date of struct<y,m,d>, null unless day and month are valid and the year is of 2000 to 2035."""
    good = x["d"].between(1, 31) & x["m"].between(1, 12) & x["y"].between(2000, 2035)
    return F.when(good, F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"]))


def filename_date(name: Column | str) -> Column:
    """ISO date in a file name (four layouts, 2000-2035, valid day and month), else its year, else ''."""
    name = empty(name)

    def iso(pattern: str, y: int, m: int, d: int) -> Column:
        found = F.struct(*(F.try_to_number(F.regexp_extract(name, pattern, g), F.lit("9999")).cast("int").alias(part) for part, g in (("y", y), ("m", m), ("d", d))))
        return F.when(name.rlike(pattern), let(found, iso_day))

    return F.coalesce(*(iso(*layout) for layout in fixed.FILENAME_DATES), F.regexp_extract(name, fixed.FILENAME_YEAR, 1))


def document_slug(name: Column | str, prefix: str = "", limit: int = 60) -> Column:
    stem = F.regexp_replace(empty(name), r"\.[^./\\]*$", "")
    stem = F.regexp_replace(stem, r"\(\d+\)|_[a-z0-9]{8}$", "")
    stem = F.trim(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.rtrim(F.substring(F.concat(F.lit(prefix), stem), 1, limit), F.lit("_"))


def index_order(reply: Column | str, n: Column | int) -> Column:
    """The first [list of integers] in a reply: its distinct members below n, in order; null if none."""
    listed = F.regexp_extract(empty(reply), r"\[[0-9,\s]*\]", 0)
    numbers = F.transform(F.regexp_extract_all(listed, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    order = F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x < n)))
    return F.when(F.size(order) > 0, order)


def markdown_cells(row: Column | str) -> Column:
    """Cells of a table row, empty ones in place."""
    inner = F.regexp_replace(F.trim(empty(row)), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def table_columns(text: Column | str) -> Column:
    """Labels of a chunk's repeated header row."""
    lines = F.filter(F.split(empty(text), "\n"), lambda s: s.startswith("|") & ~s.rlike(r"^\|\s*▸"))
    header = F.try_element_at(lines, F.lit(1))
    cells = F.transform(markdown_cells(header), lambda c: F.trim(F.regexp_replace(c, r"\s*<br>\s*", " "), F.lit(" *")))
    return F.coalesce(F.filter(cells, lambda c: c != ""), F.array().cast("array<string>"))


def unnamed_columns(text: Column | str) -> Column:
    """Placeholder headers in table rows; neighbours that share a bar all count."""
    return F.regexp_count(empty(text), F.lit(r"\|Col[0-9]+(?=\|)"))


def shattered(text: Column | str) -> Column:
    """Whether a table is prose under a grid: cell bounds inside words, in number and share."""
    hits = F.regexp_count(empty(text), F.lit(r"[a-z]\|(?=[a-z])"))
    bounds = F.regexp_count(empty(text), F.lit(r"(?<=[^|\n])\|(?=[^|\n])"))
    return (bounds >= fixed.SHATTER_MIN_BOUNDARIES) & (hits >= fixed.SHATTER_MIN_HITS) & (hits >= bounds * fixed.SHATTER_MAX)


def label_like(cell: Column | str) -> Column:
    plain = F.trim(F.regexp_replace(empty(cell), r"\*+", ""))
    return (plain != "") & ~plain.rlike(r"^Col\d+$") & (F.length(plain) <= fixed.LABEL_MAX) & plain.rlike(r"^(\p{Lu}|\p{Nd})")


def url_path(path: Column | str) -> Column:
    """Percent-encoded path; its slashes stay."""
    return F.array_join(F.transform(F.split(empty(path), "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def thread_title(text: Column | str, limit: int = 60) -> Column:
    return F.substring(whitespace_folded(text), 1, limit)


def page_footer(line: Column | str) -> Column:
    """Whether a line is nothing but 'page n of m' or 'n / m'."""
    return empty(line).rlike(fixed.PAGE_FOOTER)


def printed_page(line: Column | str) -> Column:
    """The number in a line that is nothing but 'page n' or 'page n of m', else null."""
    return F.regexp_extract(empty(line), fixed.PRINTED_PAGE, 1).try_cast("int")


DOC_TYPES = fixed.DOC_TYPES


def classified(text: Column | str, table: tuple[tuple[str, str], ...], default: str) -> Column:
    """The first name of the table whose pattern the text has, in any case; else the default."""
    return F.coalesce(*(F.when(empty(text).rlike(f"(?i){p}"), F.lit(name)) for name, p in table), F.lit(default))


def letterhead_date(text: Column | str) -> Column:
    """ISO date of the letterhead's date field (valid day and month, 2000-2035), else ''."""
    head = F.substring(empty(text), 1, fixed.LETTERHEAD_CHARS)
    found = F.struct(*(F.regexp_extract(head, fixed.LETTERHEAD_DATE, g).try_cast("int").alias(part) for part, g in (("d", 1), ("m", 2), ("y", 3))))
    return F.coalesce(let(found, iso_day), F.lit(""))


def letter_of_text(text: Column | str) -> Column:
    """The letter number of a letterhead by the first of the known forms, else ''."""
    head = F.substring(empty(text), 1, fixed.LETTERHEAD_CHARS)
    found = F.coalesce(*(F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in fixed.LETTER_NUMBERS), F.lit(""))
    return F.trim(whitespace_folded(found), F.lit(" .,;:"))


def letter_of_filename(name: Column | str) -> Column:
    """The letter number that a file name holds, in its printed form, else ''."""
    part = lambda p, g: F.regexp_extract(empty(name), p, g)
    two = lambda x: F.lpad(x, 2, "0")
    smi = F.concat(F.lit("VB/SMI/"), F.upper(part(fixed.FILENAME_SMI, 1)), F.lit("/"), two(part(fixed.FILENAME_SMI, 2)))
    cai = F.concat(F.lit("CAI "), F.upper(part(fixed.FILENAME_CAI, 1)), F.lit("-"), part(fixed.FILENAME_CAI, 2), F.lit("/"), two(part(fixed.FILENAME_CAI, 3)))
    return F.when(empty(name).rlike(fixed.FILENAME_SMI), smi).when(empty(name).rlike(fixed.FILENAME_CAI), cai).otherwise("")


def title_of_text(text: Column | str, fallback: Column | str) -> Column:
    """The subject line without marks, if it has 8 to 160 characters, else the fallback."""
    subject = F.trim(whitespace_folded(F.regexp_replace(F.regexp_extract(empty(text), rules.SUBJECT, 1), r"[*_`]", "")), F.lit(" .:-"))
    return F.when(F.char_length(subject).between(8, 160), subject).otherwise(col(fallback))


def blob_key(path: Column | str) -> Column:
    """The key of a document in an object store: its path with forward slashes."""
    return F.replace(empty(path), F.lit("\\"), F.lit("/"))


def download_url(base: str, path: Column | str) -> Column:
    """The address of a document, '' without a base."""
    return F.concat(F.lit(f"{base}/"), url_path(blob_key(path))) if base else F.lit("")


def value_bearing(text: Column | str) -> Column:
    """Whether a text holds a digit: what cases about values are drawn from."""
    return empty(text).rlike("[0-9]")
