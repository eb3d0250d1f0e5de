"""Sections, blocks, sentence units and token-bounded chunks.

What is a window or a higher-order function stays one; the greedy folds, in which each
cut depends on the one before, run per document and section in grouped pandas functions.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators.bm25 import spread

HEADING = r"^(#{1,6})\s+(.+)$"
MAX_TOKENS, MIN_TOKENS = 500, 150
CHUNK = "doc_id long, section_no int, part_no int, section string, token_count int, block_types array<string>, boundary_distance double, text string"


def _lines(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    return docs.select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "line")).withColumn("heading", F.when(T.stripped(line).rlike(HEADING), T.stripped(F.regexp_extract(T.stripped(line), HEADING, 2))))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, section, text): text between headings; sections without text are left out, equal names stay apart."""
    running = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(docs).withColumn("section_no", F.count("heading").over(running).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("pos", "line")))), lambda x: F.regexp_replace(x["line"], r"(?U)\s+$", "")), "\n")
    found = rows.groupBy("doc_id", "section_no").agg(F.coalesce(F.max("heading"), F.lit("Document")).alias("section"), T.stripped(joined).alias("text"))
    return found.where(F.col("text") != "")


def blocks(parts: DataFrame) -> DataFrame:
    """(doc_id, section_no, section, block_no, type, text): runs of table lines and of other lines; blank lines end both."""
    s = T.stripped(F.col("line"))
    kind = F.when(s == "", "blank").when(s.startswith("|") & s.endswith("|"), "table").otherwise("paragraph")
    rows = parts.select("doc_id", "section_no", "section", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("kind", kind)
    order = Window.partitionBy("doc_id", "section_no").orderBy("pos")
    rows = rows.withColumn("fresh", (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit(""))).cast("int"))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'blank'")
    joined = T.stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"))
    found = rows.groupBy("doc_id", "section_no", "section", "island", "kind").agg(joined.alias("text"))
    return found.select("doc_id", "section_no", "section", F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("island")).alias("block_no"), F.col("kind").alias("type"), "text")


def units(found: DataFrame) -> DataFrame:
    """Tables whole, paragraphs of several sentences as sentence units: (doc_id, section_no, section, unit_no, type, text)."""
    split = T.sentences(F.col("text"))
    whole = F.array(F.struct(F.col("type").alias("type"), F.col("text").alias("text")))
    several = F.transform(split, lambda x: F.struct(F.lit("sentence").alias("type"), x.alias("text")))
    rows = found.select("doc_id", "section_no", "section", "block_no", F.posexplode(F.when((F.col("type") == "paragraph") & (F.size(split) > 1), several).otherwise(whole)).alias("at", "u"))
    order = Window.partitionBy("doc_id", "section_no").orderBy("block_no", "at")
    return rows.select("doc_id", "section_no", "section", F.row_number().over(order).alias("unit_no"), F.col("u.type").alias("type"), F.col("u.text").alias("text"))


def fixed_chunks(docs: DataFrame, size: int = 400, overlap: int = 80) -> DataFrame:
    """(doc_id, chunk_index, start_token, end_token, token_count, text): windows of size tokens; blank windows take no number."""
    step = size - overlap
    rows = docs.select("doc_id", T.count_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("n", F.size("tokens"))
    last = F.greatest(F.ceil((F.col("n") - F.lit(overlap)) / F.lit(float(step))), F.lit(1)).cast("int") - 1
    cut = rows.where("n > 0").select("doc_id", "tokens", "n", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    cut = cut.select("doc_id", (F.col("i") * step).alias("start_token"), F.least(F.col("i") * step + size, F.col("n")).alias("end_token"), T.stripped(F.array_join(F.slice("tokens", F.col("i") * step + 1, F.lit(size)), "")).alias("text"))
    order = Window.partitionBy("doc_id").orderBy("start_token")
    return cut.where(F.col("text") != "").select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "start_token", "end_token", (F.col("end_token") - F.col("start_token")).alias("token_count"), "text")


def statistics(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    rows = chunks.groupBy(*(by or []))
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.min("token_count").cast("long").alias("min_tokens"), F.max("token_count").cast("long").alias("max_tokens"), F.round(F.avg("token_count"), 2).alias("avg_tokens"))


def boundary_quality(chunks: DataFrame, group_col: str, most: int, share: float = 0.85) -> DataFrame:
    """Transitions inside a group, and those whose chunk before is at least share of the limit."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    rows = chunks.withColumn("before", F.lag(group_col).over(order)).withColumn("tokens_before", F.lag("token_count").over(order))
    same = F.col("before") == F.col(group_col)
    return rows.agg(F.count_if(same).alias("transitions"), F.count_if(same & (F.col("tokens_before") >= share * most)).alias("full_transitions"))


def chunk_id(source: str = "source", section: str = "section", index: str = "chunk_index", text: str = "text"):  # noqa: ANN201
    return F.sha2(F.concat_ws("|", F.col(source), F.col(section), F.col(index), F.substring(F.sha2(F.col(text), 256), 1, 16)), 256)


def corpus_fingerprint(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 1000) -> DataFrame:
    """(rows, fingerprint): a digest of all ids and texts in id order, as a tree in which no node joins more than fan digests."""
    now = rows.select(F.col(id_col).alias("k"), F.sha2(F.concat(F.col(id_col).cast("string"), F.lit("\n"), F.coalesce(text_col, F.lit(""))), 256).alias("d"), F.lit(1).cast("long").alias("n"))
    top = rows.agg(F.max(id_col)).first()[0] or 0
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "")
        now = now.groupBy(F.floor(F.col("k") / fan).alias("k")).agg(F.sha2(joined, 256).alias("d"), F.sum("n").alias("n"))
        top //= fan
        if top == 0:
            return now.select(F.col("n").alias("chunks"), F.col("d").alias("fingerprint"))


# -- greedy folds -----------------------------------------------------------------------------

_COUNT = re.compile(r"[一-鿿]|[A-Za-z0-9_]+|[^\S\r\n]+|\n|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[。！？.!?])\s*")


def token_count(text: str) -> int:
    return len(_COUNT.findall(text))


def windows(text: str, size: int) -> list[str]:
    tokens = _COUNT.findall(text)
    return [w for k in range(0, len(tokens), size) if (w := "".join(tokens[k : k + size]).strip())]


class Lengths:
    """Token totals of texts in a row, of which any run may be joined with so many tokens between neighbours."""

    def __init__(self, texts: list[str], between: int) -> None:
        self.between, self.totals = between, [0, *accumulate(token_count(t) + between for t in texts)]

    def __call__(self, start: int, end: int) -> int:
        return self.totals[end] - self.totals[start] - self.between if end > start else 0

    def reach(self, start: int, room: int) -> int:
        """The end of the longest run from start that fits; start itself where not even one text does."""
        return bisect_right(self.totals, self.totals[start] + room + self.between) - 1

    def filled(self, room: int, start: int = 0) -> list[tuple[int, int]]:
        """Runs that each take as many texts as fit, and one at least."""
        runs, end = [], len(self.totals) - 1
        while start < end:
            runs.append((start, max(start + 1, self.reach(start, room))))
            start = runs[-1][1]
        return runs


def table_parts(text: str, most: int) -> list[tuple[str, str]]:
    """A table beyond the limit as parts under its repeated first two lines.

    Rows at the top that do not even fit alone are cut into token windows without these
    lines; a later one makes a part of its own.
    """
    lines = text.splitlines()
    cut = 2 if len(lines) > 1 else 0
    head, rows = "".join(f"{line}\n" for line in lines[:cut]), lines[cut:]
    lengths, room = Lengths(rows, 1), most - token_count(head)
    first = next((k for k in range(len(rows)) if lengths(k, k + 1) <= room), len(rows))
    whole = [("table_token_fallback", w) for row in rows[:first] for w in windows(row, most)]
    return whole + [("table_split", head + "\n".join(rows[a:b])) for a, b in lengths.filled(room, first)]


Distance = Callable[[str, str], float]


@lru_cache(maxsize=2)
def _word_counts(text: str) -> tuple[Counter, int]:
    """The counts of a text's words and the sum of their squares; a text is compared with the one before, then with the one behind."""
    found = Counter(re.findall(r"\w+", text.lower()))
    return found, sum(n * n for n in found.values())


def lexical_distance(a: str, b: str) -> float:
    """One less the cosine of word counts: the offline stand-in for a sentence encoder."""
    (x, p), (y, q) = _word_counts(a), _word_counts(b)
    norm = math.sqrt(p * q)
    return 1.0 - (sum(n * y[w] for w, n in x.items()) / norm if norm else 0.0)


def best_cut(runs: Lengths, gaps: list[float | None], start: int, end: int, least: int, by_gap: bool = False) -> int:
    """The boundary inside a run with the widest gap and enough tokens on both sides, the first of such.

    Else one with enough on its left: by_gap that of the widest gap, otherwise the last; else the one before the end.
    """
    inner = range(start + 1, end)
    wide = [k for k in inner if runs(start, k) >= least]
    fair = [k for k in wide if gaps[k - 1] is not None and runs(k, end) >= least]
    widest = lambda places: max(places, key=lambda k: (gaps[k - 1], -k))
    if fair:
        return widest(fair)
    if wide:
        return widest(wide) if by_gap else wide[-1]
    return max(start + 1, end - 1)


def cut_runs(runs: Lengths, gaps: list[float | None], room: int, least: int, by_gap: bool = False) -> list[tuple[int, int]]:
    """Runs of all texts: each grows to the limit and then ends at its best cut; the rest is the last."""
    found, start, size = [], 0, len(runs.totals) - 1
    while start < size:
        end = runs.reach(start, room)
        if end < size:
            end = best_cut(runs, gaps, start, end, least, by_gap)
        found.append((start, end))
        start = end
    return found


def sentence_groups(parts: list[str], most: int, least: int, distance: Distance) -> list[tuple[str, str]]:
    """The sentences of a long paragraph in groups that end where neighbours differ most."""
    gaps = [distance(a, b) for a, b in pairwise(parts)]
    return [("semantic_sentence_group", text) for a, b in cut_runs(Lengths(parts, 0), gaps, most, least, by_gap=True) if (text := "".join(parts[a:b]).strip())]


def sized_units(rows: list[tuple[str, str]], most: int, least: int = MIN_TOKENS, distance: Distance = lexical_distance) -> list[tuple[str, str]]:
    """Units within the limit: long tables in parts, long paragraphs by sentences, a single long sentence in token windows."""
    out: list[tuple[str, str]] = []
    for kind, text in rows:
        parts = split_sentences(text) if kind != "table" else []
        if token_count(text) <= most:
            out.append((kind, text))
        elif kind == "table":
            out += table_parts(text, most)
        elif len(parts) > 1:
            out += sentence_groups(parts, most, least, distance)
        else:
            out += [("token_fallback", w) for w in windows(text, most)]
    return out


def split_sentences(text: str) -> list[str]:
    return [s for x in _SENTENCE.split(text) if (s := x.strip())]


def _chunk(number: int, name: str, kinds: list[str], gap: float | None, body: str) -> tuple:
    text = f"Section: {name}\n\n{body}".strip()
    return number, name, token_count(text), sorted(set(kinds)), gap, text


def fold(name: str, rows: list[tuple[str, str]], most: int = MAX_TOKENS, least: int = MIN_TOKENS, distance: Distance = lexical_distance) -> list[tuple]:
    """Chunks of one section: runs of units within the limit that end where neighbouring units differ most."""
    room = max(1, most - token_count(f"Section: {name}\n\n"))
    found = sized_units(rows, room, least, distance)
    kinds, texts = [k for k, _ in found], [t for _, t in found]
    gaps = [None if "table" in (kinds[k], kinds[k + 1]) else distance(texts[k], texts[k + 1]) for k in range(len(found) - 1)]
    runs = cut_runs(Lengths(texts, 2), gaps, room, least)
    return [_chunk(n, name, kinds[a:b], gaps[b - 1] if b < len(found) else None, "\n\n".join(texts[a:b]).strip()) for n, (a, b) in enumerate(runs)]


def semantic_chunks(found: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """Chunks of units(): sections fold apart from each other, then documents number their chunks through."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit_no")
        out = fold(rows["section"].iloc[0], list(zip(rows["type"], rows["text"], strict=True)), most, least)
        frame = pd.DataFrame(out, columns=["part_no", "section", "token_count", "block_types", "boundary_distance", "text"])
        return frame.assign(doc_id=key[0], section_no=key[1])[["doc_id", "section_no", "part_no", "section", "token_count", "block_types", "boundary_distance", "text"]]

    order = Window.partitionBy("doc_id").orderBy("section_no", "part_no")
    return found.groupBy("doc_id", "section_no").applyInPandas(run, CHUNK).withColumn("chunk_index", F.row_number().over(order) - 1)


def _sentence_runs(text: str, room: int) -> list[tuple[str, str]]:
    """A long paragraph's sentences, those beyond the limit in token windows, packed while they fit."""
    parts = [p for s in split_sentences(text) for p in ([s] if token_count(s) <= room else windows(s, room))]
    return [("sentence_group", " ".join(parts[a:b])) for a, b in Lengths(parts, 1).filled(room)]


def packed_blocks(name: str, rows: list[tuple[str, str]], most: int = 400, least: int = 120) -> list[tuple]:
    """Structure-aware packing: blocks while they fit (measured with one line break between them), sentences of long ones packed, small neighbours without tables merged."""
    head = token_count(f"Section: {name}\n\n")
    room = max(1, most - head)
    pieces: list[tuple[str, str]] = []
    for kind, text in rows:
        pieces += [(kind, text)] if token_count(text) <= room else table_parts(text, room) if kind == "table" else _sentence_runs(text, room)
    texts, kinds = [t for _, t in pieces], [k for k, _ in pieces]
    joined = Lengths(texts, 2)
    runs: list[tuple[int, int]] = []
    for a, b in Lengths(texts, 1).filled(most - head):
        start = runs[-1][0] if runs else a
        small = bool(runs) and min(joined(*runs[-1]), joined(a, b)) + head < least
        if small and "table" not in kinds[start:b] and head + joined(start, b) <= most:
            runs[-1] = (start, b)
        else:
            runs.append((a, b))
    return [_chunk(n, name, kinds[a:b], None, "\n\n".join(texts[a:b])) for n, (a, b) in enumerate(runs)]


def structure_chunks(found: DataFrame, most: int = 400, least: int = 120) -> DataFrame:
    """Chunks of blocks()."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_no")
        out = packed_blocks(rows["section"].iloc[0], list(zip(rows["type"], rows["text"], strict=True)), most, least)
        frame = pd.DataFrame(out, columns=["part_no", "section", "token_count", "block_types", "boundary_distance", "text"]).astype({"boundary_distance": float})
        return frame.assign(doc_id=key[0], section_no=key[1])[["doc_id", "section_no", "part_no", "section", "token_count", "block_types", "boundary_distance", "text"]]

    order = Window.partitionBy("doc_id").orderBy("section_no", "part_no")
    return found.groupBy("doc_id", "section_no").applyInPandas(run, CHUNK).withColumn("chunk_index", F.row_number().over(order) - 1)


# -- whole documents ----------------------------------------------------------------------------
# The same cuts as sections(), blocks() and units(), for a text where it lies: no line is shuffled, no section a group.

_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_HEADING = re.compile(r"#{1,6}[ \t\n\x0b\f\r]+(.+)", re.DOTALL)
_UNIT = re.compile("(?<=[。！？.!?])[ \t\n\x0b\f\r]*")
#: What (?U)\\s matches.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Documents whose results a task holds at once.
DOCUMENTS = 64


def section_texts(text: str) -> list[tuple[int, str, str]]:
    """(section_no, section, text) as in sections()."""
    found: list[tuple[int, str, list[str]]] = [(0, "Document", [])]
    for line in _BREAK.split(text):
        heading = _HEADING.fullmatch(s) if (s := line.strip(BLANKS)).startswith("#") else None
        if heading:
            found.append((len(found), heading[1].strip(BLANKS), []))
        else:
            found[-1][2].append(line.rstrip(BLANKS))
    return [(n, name, body) for n, name, held in found if (body := "\n".join(held).strip(BLANKS))]


def block_texts(text: str) -> list[tuple[str, str]]:
    """(type, text) of a section's blocks as in blocks()."""
    found: list[tuple[str, list[str]]] = []
    last = ""
    for line in text.split("\n"):
        s = line.strip(BLANKS)
        kind = "" if not s else "table" if s[0] == s[-1] == "|" else "paragraph"
        if kind and kind == last:
            found[-1][1].append(line)
        elif kind:
            found.append((kind, [line]))
        last = kind
    return [(kind, "\n".join(held).strip(BLANKS)) for kind, held in found]


def unit_texts(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(type, text) of the blocks' units as in units()."""
    out: list[tuple[str, str]] = []
    for kind, text in found:
        parts = [s for x in _UNIT.split(text) if (s := x.strip(BLANKS))] if kind == "paragraph" else []
        out += [("sentence", s) for s in parts] if len(parts) > 1 else [(kind, text)]
    return out


def by_document(docs: DataFrame, rows_of: Callable[[str], Iterable[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """(doc_id, *schema): the rows of every text, made in the task that reads it; DOCUMENTS at a time."""
    names = ["doc_id", *(c.strip().split(" ")[0] for c in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(start, DOCUMENTS)
                rows = [(key, *row) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text for row in rows_of(text)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *types], strict=True)], names=names)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, f"doc_id long, {schema}")


_CHUNKED = "chunk_index int, section_no int, part_no int, section string, token_count int, block_types array<string>, boundary_distance double, text string"
_CHUNKED_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.float64(), pa.string()]


def document_blocks(docs: DataFrame) -> DataFrame:
    """As blocks(sections(docs))."""

    def rows(text: str) -> Iterator[tuple]:
        for number, name, body in section_texts(text):
            for n, (kind, block) in enumerate(block_texts(body), 1):
                yield number, name, n, kind, block

    return by_document(docs, rows, "section_no int, section string, block_no int, type string, text string", [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()])


def _numbered(text: str, chunks: Callable[[str, list[tuple[str, str]]], list[tuple]]) -> Iterator[tuple]:
    found = ((number, chunk) for number, name, body in section_texts(text) for chunk in chunks(name, block_texts(body)))
    for index, (number, chunk) in enumerate(found):
        yield index, number, *chunk


def document_semantic_chunks(docs: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """As semantic_chunks(units(blocks(sections(docs))))."""
    return by_document(docs, lambda text: _numbered(text, lambda name, found: fold(name, unit_texts(found), most, least)), _CHUNKED, _CHUNKED_TYPES)


def document_structure_chunks(docs: DataFrame, most: int = 400, least: int = 120) -> DataFrame:
    """As structure_chunks(blocks(sections(docs)))."""
    return by_document(docs, lambda text: _numbered(text, lambda name, found: packed_blocks(name, found, most, least)), _CHUNKED, _CHUNKED_TYPES)
