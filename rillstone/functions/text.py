"""Text clean-up, extraction and tokenisation as column expressions.

Patterns use Java syntax; (?U) where the class shorthands must cover Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and word lists.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
IMAGE = r"(?i)\[Image(?: omitted)?:\s*[^\]]+\]"
URL = r"https?://\S+"
SECTION_PREFIX = r"(?m)^Section:\s*"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
BM25_TOKEN = r"\d+(?:\.\d+)?%?|[A-Za-z][A-Za-z0-9]*|[\x{4e00}-\x{9fff}]+"
CHAR_TOKEN = r"[\x{4e00}-\x{9fff}]|[A-Za-z]+|\d+(?:\.\d+)?%?"
COUNT_TOKEN = r"(?U)[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+|[^\S\r\n]+|\n|[^\w\s]"
PARSER_LINES = ("Source: ", "Raw output directory: ", "## Source file: ")
PARSER_TITLE = "# Cleaned Magic-PDF / MinerU Text"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
PERIOD = r"(\d{4}-\d{2}-\d{2})\s*~\s*(\d{4}-\d{2}-\d{2})"
SUMMARY = r"同比\s*([+\-]?\d+(?:\.\d+)?%)\s*[｜|]\s*环比\s*([+\-]?\d+(?:\.\d+)?%)\s*平均值\s*([\d.]+万?)"
PROVINCE = r"(?:^|\n)\s*(\d{1,2})\s+([\x{4e00}-\x{9fff}]{2,6})\s+([\d.]+)%\s+([\d.]+)"
GENDER = r"(男性|女性)\s*\n?\s*占比\s*(\d+(?:\.\d+)?)%\s*TGI\s*(\d+(?:\.\d+)?)"
ASCII_TOKEN = r"[A-Za-z0-9_./:%+-]+"
#: Letters of which Spark's capital is not one letter, or came with Unicode 16, and what stands for them one by one.
LONG_UPPER = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1]
NEW_UPPER = [chr(c) for c in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))]
TAB_KEYS = ("keyword", "tab", "status", "source_url", "data_periods", "collected_at", "index_summaries", "has_data", "summary", "ranking_by_relevance", "ranking_by_growth", "provinces", "gender", "age_summary", "interest_summary", "message", "reason")


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        text = F.regexp_replace(text, pattern, to)
    return text


def stripped(text: Column) -> Column:
    # Possessive, and never from inside a run of blanks, so that long runs are passed once.
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


# -- clean-up --------------------------------------------------------------------------------


def _parser_line(start: str, blank: str, end: str) -> str:
    """A pattern of lines that the parser adds: a title, or one of the beginnings with something behind it."""
    return rf"(?Um){start}{blank}*+(?:(?:{'|'.join(PARSER_LINES)}){blank}*+\S.*|{PARSER_TITLE}{blank}*+){end}"


def _content_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda line: ~line.rlike(_parser_line(r"\A", r"\s", r"\z")))


def normalise_markdown(text: Column) -> Column:
    """Parser lines dropped, images as placeholders, lines right-trimmed, blank runs collapsed, one final newline.

    In passes over the whole text, each linear: a line on its own costs a call of every pattern.
    """
    blank = r"[^\S\n]"
    kept = replaced(text, (LINE_BREAK, "\n"), (_parser_line("^", blank, r"(?:\n|\z)"), ""), (r"!\[[^\]\n]*\]\(([^)\n]+)\)", "[Image: $1]"), (rf"(?U)(?<!{blank}){blank}++(?=\n|\z)", ""))
    joined = F.regexp_replace(stripped(kept), r"\n{3,}", "\n\n")
    return bound(joined, lambda t: F.when(F.length(t) > 0, F.concat(t, F.lit("\n"))).otherwise(""))


def flatten_markdown(text: Column, keep_tables: bool = False) -> Column:
    """As normalise_markdown, without heading marks and with table rows as joined cells; separator rows go."""

    def flat(line: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(line, r"^#{1,6}\s+", ""), MARKDOWN_IMAGE, "[Image: $1]")
        s = stripped(line)
        cells = F.filter(F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), stripped), lambda c: c != "")
        separator = F.forall(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$"))
        if keep_tables:
            return F.regexp_replace(line, r"(?U)\s+$", "")
        row = F.when(separator, F.lit(None).cast("string")).otherwise(F.array_join(cells, "；"))
        return F.when(s.startswith("|") & s.endswith("|"), row).otherwise(F.regexp_replace(line, r"(?U)\s+$", ""))

    kept = F.filter(F.transform(_content_lines(text), flat), lambda x: x.isNotNull())
    return F.concat(stripped(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")), F.lit("\n"))


def parse_noise(text: Column) -> Column:
    return replaced(text, (CONTROL, ""), (r"(?m)^[ \t]*[■□]{1,}[ \t]*", "- "), (r"[■□]{2,}", " "), (r"(?m)^#{1,6}\s*$", ""), (r"(?m)^(#{1,6})\s+", "$1 "))


def table_cell(cell: Column) -> Column:
    return F.replace(stripped(F.regexp_replace(F.regexp_replace(cell, "<[^>]+>", ""), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: Column) -> Column:
    """Ragged rows of cells as a Markdown table, padded to the widest, the first as its header."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0)))), "\n")).otherwise("")


def html_table(table: Column) -> Column:
    rows = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), table_cell))
    return markdown_table(F.filter(rows, lambda r: F.size(r) > 0))


def html_to_text(text: Column) -> Column:
    """Tables to Markdown, images to placeholders, all other tags dropped; script bodies and references stay."""
    pieces = F.split(text, r"(?is)<table\b.*?</table>", -1)
    tables = F.concat(F.regexp_extract_all(text, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0)), F.array(F.lit("")))
    woven = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), tables.alias("t")), lambda x: F.concat(x["p"], F.when(x["t"] != "", F.concat(F.lit("\n\n"), html_table(x["t"]), F.lit("\n\n"))).otherwise(""))), "")
    converted = F.when(text.rlike("(?i)<table"), woven).otherwise(text)
    image = r'<img\s+[^>]*src="([^"]+)"[^>]*>'
    bare = replaced(converted, (rf"(?i)<div[^>]*>\s*{image}\s*</div>", "\n[Image omitted: $1]\n"), (f"(?i){image}", "\n[Image omitted: $1]\n"), ("<[^>]+>", ""))
    return stripped(replaced(parse_noise(bare), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")))


def lexicon_text(text: Column) -> Column:
    return replaced(text, (IMAGE, " "), (URL, " "), (SECTION_PREFIX, ""))


def question_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def preview(text: Column, limit: int = 420) -> Column:
    flat = stripped(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(F.substring(flat, 1, limit), r"(?U)\s+$", ""), F.lit("..."))).otherwise(flat)


def trimmed(text: Column, limit: int = 2600, mark: str = "\n...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit(mark))).otherwise(text)


def safe_name(text: Column) -> Column:
    name = F.trim(F.regexp_replace(stripped(text), r"(?U)[^\w\x{4e00}-\x{9fff}-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("untitled"))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))


def image_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(IMAGE))


def worth_asking_about(text: Column, tokens: Column) -> Column:
    """Long enough, with enough ideographs, and not mostly images."""
    return (tokens >= 80) & (cjk_count(text) >= 60) & ~((image_count(text) >= 2) & (cjk_count(text) < 120))


def json_object(text: Column) -> Column:
    """The JSON object of a fenced block, or the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def without_ticks(text: Column) -> Column:
    return F.trim(stripped(text), F.lit("`"))


def page_set(expression: Column, total: Column) -> Column:
    """Pages of "1-3,7" as sorted zero-based numbers below the total."""
    parts = F.filter(F.transform(F.split(expression, ","), stripped), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    spans = F.transform(parts, lambda p: F.sequence(F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.greatest(F.regexp_extract(p, r"(\d+)$", 1).cast("int"), F.regexp_extract(p, r"^(\d+)", 1).cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(spans), lambda n: n - 1), lambda n: (n >= 0) & (n < total))))


def reading_order(y: Column, x: Column) -> list[Column]:
    """Sort keys of layout blocks: rows of 20 pixels, then columns, blocks without a place last."""
    return [F.coalesce(F.bround(y / 20) * 20, F.lit(1e9)), F.coalesce(x, F.lit(1e9))]


def calculate(op: Column, a: Column, b: Column) -> Column:
    return F.when(op == "add", a + b).when(op == "subtract", a - b).when(op == "multiply", a * b).when((op == "divide") & (b != 0), F.try_divide(a, b)).when(op == "divide", F.raise_error(F.lit("division by zero"))).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), op)))


def nfc(text: Column) -> Column:
    """Unicode NFC, trimmed; null for text that is blank or no valid UTF-8, as with lone surrogates. By the ICU library that Spark carries, so no text goes to Python."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    trimmed_ = F.regexp_replace(F.when(text.isNotNull() & F.is_valid_utf8(text), composed), r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$", "")
    return bound(trimmed_, lambda t: F.nullif(t, F.lit("")))


# -- tokens ----------------------------------------------------------------------------------


def bm25_tokens(text: Column) -> Column:
    """Numbers and percentages, ASCII words, and runs of ideographs, in lower case."""
    return F.regexp_extract_all(F.lower(lexicon_text(text)), F.lit(BM25_TOKEN), F.lit(0))


def char_tokens(text: Column) -> Column:
    """Single ideographs, ASCII letters, numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(CHAR_TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    """The tokens that lengths are counted in."""
    return F.regexp_extract_all(text, F.lit(COUNT_TOKEN), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: inside a lambda function Spark computes it for every element."""
    return F.transform(F.array(value), use)[0]


def token_windows(tokens: Column, size: int) -> Column:
    starts = lambda t: F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(size))
    return bound(tokens, lambda t: F.filter(F.transform(starts(t), lambda i: stripped(F.array_join(F.slice(t, i + 1, F.lit(size)), ""))), lambda x: x != ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[。！？.!?])\s*"), stripped), lambda x: x != "")


def ascii_terms(text: Column) -> Column:
    """Domain terms of 2 to 12 letters and digits that start with a letter, upper-cased."""
    return F.transform(F.regexp_extract_all(lexicon_text(text), F.lit(r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9]{1,11}"), F.lit(0)), F.upper)


def context_tokens(text: Column, safety: float = 1.2) -> Column:
    return F.ceil(F.size(count_tokens(text)) * F.lit(safety))


# -- index pages -----------------------------------------------------------------------------


def date_periods(text: Column) -> Column:
    pattern = F.lit(PERIOD)
    return F.array_distinct(F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("start"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("end")))


def index_summaries(text: Column) -> Column:
    pattern = F.lit(SUMMARY)
    names = ("year_on_year", "month_on_month", "average")
    return F.array_distinct(F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(k + 1)).alias(n) for k, n in enumerate(names)]))


def amount(text: Column) -> Column:
    """A number that may end in the sign for ten thousand."""
    return F.regexp_extract(text, r"^([\d.]+)", 1).try_cast("double") * F.when(text.endswith("万"), 10000.0).otherwise(1.0)


def relevance_ranking(text: Column, marker: str = "按涨幅", most: int = 20) -> Column:
    """(rank, term, score) from alternating lines after the marker; from rank 4 on a line with the rank itself is skipped."""
    rows = F.filter(F.transform(lines(text), stripped), lambda x: x != "")
    start = F.array_position(rows, marker).cast("int")
    kind = "array<struct<rank: int, term: string, score: double>>"
    first = F.struct(start.alias("at"), (start > 0).alias("open"), F.array().cast(kind).alias("found"))

    def step(acc: Column, rank: Column) -> Column:
        at = F.when((rank >= 4) & (F.try_element_at(rows, acc["at"] + 1) == rank.cast("string")), acc["at"] + 1).otherwise(acc["at"])
        term, score = F.try_element_at(rows, at + 1), F.try_element_at(rows, at + 2)
        good = acc["open"] & F.coalesce(score.rlike(r"^\d+(\.\d+)?$"), F.lit(False))
        one = F.array(F.struct(rank.cast("int").alias("rank"), term.alias("term"), score.try_cast("double").alias("score"))).cast(kind)
        return F.struct(F.when(good, at + 2).otherwise(at).alias("at"), good.alias("open"), F.when(good, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, step, lambda acc: acc["found"])


def provinces(text: Column) -> Column:
    pattern = F.lit(PROVINCE)
    part = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))
    zipped = F.arrays_zip(part(1).alias("r"), part(2).alias("p"), part(3).alias("s"), part(4).alias("t"))
    return F.transform(zipped, lambda z: F.struct(z["r"].cast("int").alias("rank"), z["p"].alias("province"), z["s"].try_cast("double").alias("share_percent"), z["t"].try_cast("double").alias("tgi")))


def genders(text: Column) -> Column:
    pattern = F.lit(GENDER)
    part = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("g"), part(2).alias("s"), part(3).alias("t")), lambda z: F.struct(z["g"].alias("gender"), z["s"].cast("double").alias("share_percent"), z["t"].cast("double").alias("tgi")))


def keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[,，、;；/\n]"), lambda x: stripped(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def upper(text: Column) -> Column:
    """Capitals letter by letter as SQL has them: Spark's own upper() makes SS of a sharp s, and two letters of a ligature."""
    odd = "".join(LONG_UPPER + NEW_UPPER)
    capital = {"ß": "ẞ"} | {c: c.title() for c in LONG_UPPER if len(c.title()) == 1}
    pieces = F.regexp_extract_all(text, F.lit(f"[{odd}]|[^{odd}]+"), F.lit(0))
    one = lambda x: F.when(x.rlike(f"[{odd}]"), F.translate(x, odd, "".join(capital.get(c, c) for c in odd))).otherwise(F.upper(x))
    return F.when(text.rlike(f"[{odd}]"), F.array_join(F.transform(pieces, one), "")).otherwise(F.upper(text))


def percent_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def front_matter(text: Column) -> Column:
    """Key and value lines between the leading rules, as a map."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(stripped(F.substring_index(x, ":", 1)).alias("key"), stripped(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))))


# -- records -----------------------------------------------------------------------------------


def media_blocks(blocks: Column) -> Column:
    """Of layout blocks (label, ...) those that are tables, charts or images."""
    return F.filter(blocks, lambda b: F.lower(b["label"]).isin("table", "chart", "image"))


def layout_markdown(blocks: Column) -> Column:
    """Layout blocks (label, text, bbox) as Markdown sections with their numbers, labels and boxes, blocks without text left out."""
    shown = F.filter(F.transform(blocks, lambda b, k: F.struct((k + 1).alias("n"), b.alias("b"))), lambda x: stripped(F.coalesce(x["b"]["text"], F.lit(""))) != "")
    return F.array_join(F.transform(shown, lambda x: F.concat(F.lit("## Block "), x["n"].cast("string"), F.lit(" ("), x["b"]["label"], F.lit(")"), F.coalesce(F.concat(F.lit(" bbox="), F.array_join(x["b"]["bbox"].cast("array<string>"), ",")), F.lit("")), F.lit("\n\n"), stripped(x["b"]["text"]))), "\n\n")


def parts_joined(parts: Column) -> Column:
    """Parts (name, text) under headings of their names, blank ones left out."""
    kept = F.filter(parts, lambda p: stripped(F.coalesce(p["text"], F.lit(""))) != "")
    return F.array_join(F.transform(kept, lambda p: F.concat(F.lit("## "), p["name"], F.lit("\n\n"), stripped(p["text"]))), "\n\n")


def ideographs_only(text: Column) -> Column:
    """Text without images, addresses and every word of ASCII letters and digits."""
    return replaced(text, (r"\[[Ii]mage:[^\]]+\]", " "), (URL, " "), (ASCII_TOKEN, " "))


def compact_record(record: Column, screenshot: Column | None = None, keys: tuple[str, ...] = TAB_KEYS) -> Column:
    """A map with the wanted keys only, and a non-empty screenshot's path."""
    kept = F.map_filter(record, lambda k, v: k.isin(*keys))
    if screenshot is None:
        return kept
    return F.when(F.coalesce(screenshot, F.lit("")) != "", F.map_concat(kept, F.create_map(F.lit("full_screenshot"), screenshot))).otherwise(kept)


def json_row(frame_schema, **options: str) -> Column:  # noqa: ANN001
    """All columns of a frame with this schema as JSON: decimals as numbers, dates and times in ISO form, nulls kept."""
    columns = [F.col(f"`{f.name}`").cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`") for f in frame_schema.fields]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"} | options)


def time_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def cell(value: Column) -> Column:
    """A spreadsheet cell as text without blanks around it; null is the empty text."""
    return stripped(F.coalesce(value.cast("string"), F.lit("")))


def periods_text(text: Column) -> Column:
    return F.transform(date_periods(text), lambda p: F.concat(p["start"], F.lit(" ~ "), p["end"]))


def summary_after(text: Column, marker: str, most: int = 300) -> Column:
    """The text after the last marker up to the next blank line, at most so long; null where the marker is not there."""
    rest = F.substring(stripped(F.split(F.substring_index(text, marker, -1), r"\n\s*\n")[0]), 1, most)
    return F.when(F.contains(text, F.lit(marker)), rest)
