"""Near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint is a 64-bit majority vote of shingle hashes. To find all pairs within a
Hamming radius r, a fingerprint is cut into bands; two fingerprints within r differ by at
most r // bands bits in at least one band. A band is embedded as the vector of bit counts
of its segments: the Manhattan distance of two vectors never exceeds the Hamming distance
of the bands, so it bounds it from below. The vectors are the cells of a grid, and a range
join over it brings each fingerprint to its own cell and, in one direction, to the cells
within the band's radius. Candidates in a cell are verified on all 64 bits.

Fingerprints may have several words: the grid then holds every word, each in bands of its
own, and the verification compares all bits. Where a similarity asks for a radius that is a
large share of the bits, only own cells are visited, in as many bands as such pairs need.

Only distinct fingerprints are joined, so a group of copies is a single point. The grid is
chosen by their number. A cell that holds more than ``cell_rows`` points is dealt out to
several tasks; inside a task a breadth first search emits a spanning forest, never all
pairs. The forest's components are the classes of near-duplicates. Where a similarity of
texts is asked for, they are only candidates: inside them the exact Jaccard similarity of
the shingles decides on links.

Defined results: a null text is the empty text; texts without words have fingerprint zero
and are linked like any other; an empty table gives no rows; repeated rows are rows of one
class each; a class of rows without ids has a null id; columns other than id and text are
not read by ``classes`` and pass through ``one_of_each`` untouched, whatever their names. Of
a class ``one_of_each`` keeps all rows with its smallest id, or with a null id where there
is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import bounded_batches, join_with_hot_keys, materialise, partitions, whole_text
from rillstone.llm.components import components

BITS = 64
SEED = 42
BANDS = 3
SEGMENT_BITS = 2
CELL_ROWS = 8192
#: Cells that are dealt out at most; the rest then hold no more rows than the smallest of these.
CROWDED_CELLS = 200_000
#: What a visit of a cell costs, in comparisons.
VISIT_COST = 500.0
#: Places of the table of shingle counts, and of a row that a task writes of it.
COUNT_PLACES = 1 << 18
COUNT_ROW = 1 << 12
#: A shingle is common whose place counts more than this and four times the mean.
COMMON = 1000
#: Share of a text's shingles that must not be common, for smallest hashes of those to do.
RARE_SHARE = 0.75
#: Share of pairs that may agree in none of these, at the least similarity of their rare shingles.
KEY_LOSS = 2e-6
#: Share of pairs of texts at a similarity's mean distance that may have no cell of the grid of candidates in common.
GRID_LOSS = 1e-4
#: Cells of that grid a fingerprint, beyond which a grid is taken only if there is none of fewer: each is a row to shuffle.
GRID_CELLS = 80
#: Rows compared at once; the matrix of a block stays within some 32 MB.
BLOCK = 2048
#: Texts and characters of a candidate class that one task compares; larger classes are dealt out.
PART_ROWS = 2048
PART_CHARS = 1 << 22


def _rehash(values: np.ndarray, word: int) -> np.ndarray:
    """The hashes that vote on a further word of a fingerprint."""
    x = values + np.uint64(0x9E3779B97F4A7C15 * word % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's word shingles in order; of all its words where they are fewer than a shingle's."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    whole, n = b" ".join(found), len(found)
    if n <= width:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends, at = [], -1
        for w in found:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: n - width]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)]
    return np.array(hashes, np.uint64)


def shingle_votes(text: str | None, width: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """Majority fingerprint of a text's word shingles, each counted once if distinct, in words of 64 bits; zero for a text without words."""
    values = shingle_hashes(text, width)
    return majority(np.unique(values) if distinct else values, words)


def majority(values: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits that over half of the hashes have set, in words of 64 bits; zero for none."""
    votes = np.zeros((words, BITS), np.int64)
    for k in range(0, len(values), 1 << 16):
        part = values[k : k + (1 << 16)]
        for word in range(words):
            own = _rehash(part, word) if word else part
            votes[word] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(values), axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_fingerprint(text: str | None, width: int) -> int:
    return int(shingle_votes(text, width)[0])


def shingle_counts(docs: DataFrame, text_col: str = "text", width: int = 5) -> np.ndarray:
    """How many shingles of all texts fall on each of COUNT_PLACES places of their hashes: a table of fixed size."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_PLACES, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount((shingle_hashes(text.as_py(), width) % np.uint64(COUNT_PLACES)).astype(np.int64), minlength=COUNT_PLACES)
        yield _count_rows(total.reshape(-1, COUNT_ROW), np.arange(COUNT_PLACES // COUNT_ROW))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(counts, np.int64)
        if total:
            yield _count_rows(np.stack(list(total.values())), np.array(list(total)))

    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "at long, counts binary")
    rows = parts.repartition(partitions(spark), "at").mapInArrow(add, "at long, counts binary").collect()  # COUNT_PLACES / COUNT_ROW rows
    found = np.zeros((COUNT_PLACES // COUNT_ROW, COUNT_ROW), np.int64)
    for row in rows:
        found[row["at"]] = np.frombuffer(row["counts"], np.int64)
    return found.ravel()


def _count_rows(rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["at", "counts"])


class Keys:
    """Keys of a set of shingle hashes, of which sets of at least a similarity share one.

    The shingles that are not common give the smallest of their hashes under several orders.
    Where RARE_SHARE of either set of a pair is rare, the rare parts have a similarity of at
    least 1 - (1 - s) / (RARE_SHARE s), and they agree in one key but for KEY_LOSS. A set with a
    smaller rare part also gives its prefix: the n - ceil(s n) + 1 of its n shingles that come
    first in the order of their counts, of which two such sets surely share one. All empty
    sets have the one key zero.
    """

    def __init__(self, counts: np.ndarray, similarity: float):
        self.ranks = np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8)
        self.common = int(min(8 * np.log2(COMMON + 4 * counts.mean() + 1), 254))
        self.similarity = similarity
        apart = (1 - similarity) / (RARE_SHARE * similarity)
        #: At low similarities hashes of the rare part would have to be many; there all sets give their prefix.
        self.orders = 0 if apart > 0.5 else max(1, int(np.ceil(np.log(KEY_LOSS) / np.log(max(apart, KEY_LOSS)))))

    def of(self, values: np.ndarray) -> list[int]:
        n = len(values)
        if not n:
            return [0]
        ranks = self.ranks[values % np.uint64(COUNT_PLACES)]
        rare = values[ranks <= self.common]
        found = [int(_rehash(rare, -1 - k).min().view(np.int64)) for k in range(self.orders)] if len(rare) else []
        if len(rare) < RARE_SHARE * n or not self.orders:
            first = np.lexsort((values, ranks))[: n - int(np.ceil(self.similarity * n - 1e-9)) + 1]
            found += values[first].view(np.int64).tolist()
        return found


def _to_arrow(prints: np.ndarray) -> pa.Array:
    """Fingerprints as longs, or as binary where they have several words."""
    if prints.shape[1] == 1:
        return pa.array(prints[:, 0].view(np.int64))
    return pa.array([p.tobytes() for p in prints], pa.binary())


def _from_arrow(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = 1, distinct: bool = False, keys: Keys | None = None) -> DataFrame:
    """(id, fp): one row per input row; fp is a long of 64 bits, or binary for a fingerprint of several words.

    keys adds a column keys: those of the text's distinct shingles.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), width) for t in batch.column(1)]
            if distinct or keys:
                unique = [np.unique(h) for h in hashes]
            prints = np.array([majority(h, words) for h in (unique if distinct else hashes)], np.uint64).reshape(batch.num_rows, words)
            columns = [batch.column(0), _to_arrow(prints)]
            if keys:
                columns.append(pa.array([keys.of(u) for u in unique], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "keys"][: len(columns)])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp {'long' if words == 1 else 'binary'}{', keys array<long>' if keys else ''}")


def _bands(bands: int, segment_bits: int) -> list[list[tuple[int, int]]]:
    """The segments (first bit, width) of each band; bands and segments cover all bits once."""
    cuts = [BITS * k // bands for k in range(bands + 1)]
    return [[(at, min(segment_bits, end - at)) for at in range(start, end, segment_bits)] for start, end in zip(cuts, cuts[1:], strict=False)]


def _offsets(dims: int, radius: int) -> list[tuple[int, ...]]:
    """The steps from a cell to cells within the radius, one of each pair of opposite steps."""
    found: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if len(prefix) == dims:
            lead = next((x for x in prefix if x), 0)
            if lead > 0:
                found.append(prefix)
            return
        for step in range(-left, left + 1):
            grow((*prefix, step), left - abs(step))

    grow((), radius)
    return found


def grid_visits(fp: np.ndarray, bands: int, segment_bits: int, radius: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, bool]]:
    """The cells that fingerprints visit: (rows of the fingerprints, band, their cells, whether these are their own cells)."""
    rows = np.arange(len(fp))
    for band, segments in enumerate(_bands(bands, segment_bits)):
        counts = np.stack([np.bitwise_count((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)) for at, width in segments], axis=1).astype(np.int64)
        weights = (segment_bits + 1) ** np.arange(len(segments), dtype=np.int64)
        own, widths = counts @ weights, np.array([w for _, w in segments])
        yield rows, band, own, True
        for step in _offsets(len(segments), radius):
            moved = np.array(step)
            inside = ((counts + moved >= 0) & (counts + moved <= widths))[:, moved != 0].all(axis=1)
            yield rows[inside], band, own[inside] + int(moved @ weights), False


def turned(prints: np.ndarray, turn: int) -> np.ndarray:
    """Fingerprints with their bits in the order of a turn, over all words; turn 0 leaves them."""
    if not turn:
        return prints
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    order = np.random.default_rng(SEED + turn).permutation(bits.shape[1])
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view(np.uint64)


def visits(distinct: DataFrame, bands: int, segment_bits: int, radius: int, turns: int = 1) -> DataFrame:
    """(fp, band, cell, home) for every cell that a fingerprint visits; each word of each turn has bands of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0)
            own = _from_arrow(prints)
            for word, values in enumerate(np.concatenate([np.ascontiguousarray(turned(own, t).T) for t in range(turns)])):
                for at, band, cell, home in grid_visits(values, bands, segment_bits, radius):
                    yield pa.RecordBatch.from_arrays([prints.take(pa.array(at)), pa.array(np.full(len(at), word * bands + band, np.int32)), pa.array(cell), pa.array(np.full(len(at), home))], names=["fp", "band", "cell", "home"])

    kind = distinct.schema["fp"].dataType.simpleString()
    return distinct.select("fp").mapInArrow(run, f"fp {kind}, band int, cell long, home boolean")


def shared_keys(distinct: DataFrame) -> DataFrame:
    """(fp, band, cell, home) for rows (fp, keys): a cell for each key, in which all who have it are at home, in no band of a grid."""
    return distinct.select("fp", F.lit(-1).alias("band"), F.explode("keys").alias("cell"), F.lit(True).alias("home"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances over all words: a row for each row of a, a column for each of b."""
    return sum((np.bitwise_count(a[:, None, word] ^ b[None, :, word]).astype(np.uint16) for word in range(1, a.shape[1])), np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16))


def forest(homes: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows of fingerprints on both sides) that connect what all links between homes and anything in the cell connect.

    Where links are few, all of them; where a cluster makes them many, a breadth-first
    search from the homes, in which a row that has been reached is not compared again.
    """
    every = np.concatenate([homes, others])
    left, right, most = [], [], 4 * len(every)
    step = max(1, BLOCK * BLOCK // max(1, len(every)))
    for s in range(0, len(homes), step):
        i, j = np.nonzero(_distances(homes[s : s + step], every) <= radius)
        i += s
        first = j > i
        i, j = i[first], j[first]
        most -= len(i)
        if most < 0:
            break
        left.append(i)
        right.append(j)
    else:
        return every[np.concatenate(left)], every[np.concatenate(right)]
    left, right = [], []
    waiting = np.arange(len(every))
    while len(waiting) and waiting[0] < len(homes):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            hit = _distances(every[x : x + 1], every[waiting])[0] <= radius
            if hit.any():
                found, waiting = waiting[hit], waiting[~hit]
                left.append(np.full(len(found), x))
                right.append(found)
                queue += found.tolist()
    return every[np.concatenate(left)], every[np.concatenate(right)]


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link a row: from each row to the smallest of its component."""
    if not len(left):
        return left, right
    width = left.shape[1]
    values, at = np.unique(np.concatenate([left, right]).view([("", np.uint64)] * width).ravel(), return_inverse=True)
    root = list(range(len(values)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(at[: len(left)].tolist(), at[len(left) :].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    tops = np.array([top(x) for x in range(len(values))])
    rows = values.view(np.uint64).reshape(-1, width)
    apart = tops != np.arange(len(values))
    return rows[apart], rows[tops[apart]]


def grid_odds(segments: list[tuple[int, int]], reach: int, share: float) -> float:
    """How likely the counts of two bands, in which a bit differs with the chance share, lie within the reach."""
    odds = np.eye(1, reach + 1)[0]
    for _, width in segments:
        apart = np.ones(1)
        for _ in range(width):
            apart = np.convolve(apart, [share / 2, 1 - share, share / 2])
        apart = apart[width:] * np.where(np.arange(width + 1) > 0, 2.0, 1.0)
        odds = np.convolve(odds, apart[: reach + 1])[: reach + 1]
    return float(odds.sum())


def similarity_grid(n: int, similarity: float, words: int) -> tuple[int, int, int]:
    """Bands and bits of a segment, and turns, of the grid with the least work that brings texts of a similarity together but for GRID_LOSS.

    Only own cells are visited: at the distance of such texts, a fixed share of all bits, the
    cells within a radius that is sure to hold both would bring most pairs together. More
    fingerprints call for longer bands, of which two agree more rarely, so for more turns.
    """
    share = _bit_share(similarity)
    grids = []
    for bands in range(3, 9):
        for bits in (1, 2):
            cut = _bands(bands, bits)
            missed = np.prod([1 - grid_odds(segments, 0, share) for segments in cut]) ** words
            turns = max(1, int(np.ceil(np.log(GRID_LOSS) / np.log(min(max(missed, 1e-300), 1 - 1e-12)))))
            partners = n * sum(grid_odds(segments, 0, 0.5) for segments in cut)
            cells = turns * words * bands
            grids.append((max(cells, GRID_CELLS), VISIT_COST * cells + turns * words * partners, (bands, bits, turns)))
    return min(grids)[2]


def grid_cost(n: float, radius: int, bands: int, segment_bits: int, words: int = 1) -> float:
    """Work of a grid a fingerprint, of n at random: its visits, and the fingerprints that it is compared with."""
    visits = partners = 0.0
    for segments in _bands(bands, segment_bits):
        reach = radius // (bands * words)
        # How likely the counts of two random segments differ by d, and the steps there are: polynomials up to the reach.
        odds, steps = np.eye(1, reach + 1)[0], np.eye(1, reach + 1)[0]
        for _, width in segments:
            counts = np.array([comb(width, k) for k in range(width + 1)]) / 2.0**width
            apart = np.convolve(counts, counts[::-1])[width:] * np.where(np.arange(width + 1) > 0, 2.0, 1.0)
            odds = np.convolve(odds, apart[: reach + 1])[: reach + 1]
            steps = np.convolve(steps, np.where(np.arange(reach + 1) > 0, 2.0, 1.0))[: reach + 1]
        visits += (1 + steps.sum()) / 2
        partners += n * odds.sum()
    return words * (VISIT_COST * visits + partners)


def best_grid(n: int, radius: int) -> tuple[int, int]:
    """Bands and bits of a segment with the least work for n distinct fingerprints of 64 bits; all such grids find the same links.

    More fingerprints call for fewer and longer bands, whose cells they fill less, so the
    comparisons of a fingerprint do not grow with n as those of one fixed grid do.
    """
    return min(((bands, bits) for bands in range(1, radius + 1) for bits in (2, 3)), key=lambda g: (grid_cost(n, radius, *g), g))


def links(distinct: DataFrame, radius: int = 4, bands: int = BANDS, segment_bits: int = SEGMENT_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints fp that connect exactly what all links within the radius connect.

    The radius is over all words, the bands are those of each word.
    """
    bounded_batches(distinct.sparkSession, 1 << 14)
    return links_in_cells(visits(distinct, bands, segment_bits, radius // bands), radius, cell_rows)


def links_in_cells(placed: DataFrame, radius: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): pairs of fingerprints that connect what all links within the radius in some cell of (fp, band, cell, home) connect.

    A task reduces its verified links to stars, so a crowded class leaves a row for each
    member and task at most.

    A cell with more than cell_rows visits is dealt out by pairs of parts of its homes and
    visitors, so that a task holds no more than three parts. The table of such cells is
    broadcast; it has at most CROWDED_CELLS rows, as beyond it only larger cells are dealt.
    """
    spark = placed.sparkSession
    bounded_batches(spark, 1 << 14)
    per_cell = placed.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where(F.col("n") > cell_rows)
    per_cell = per_cell.select("band", "cell", F.ceil(F.greatest("homes", F.col("n") - F.col("homes")) / cell_rows).cast("int").alias("parts"), (F.col("n") > F.col("homes")).alias("visited"))
    crowded = per_cell.orderBy(F.desc("parts"), "band", "cell").limit(CROWDED_CELLS)
    placed = placed.join(F.broadcast(crowded), ["band", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # Task (i, j) of a crowded cell: homes of part i meet the visitors of part j and, where i <= j, its homes.
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    spot = lambda i, j, home: F.struct((i.cast("long") * (1 << 31) + j.cast("long")).alias("part"), home.alias("home"))
    among = F.transform(each, lambda k: spot(F.least(k, own), F.greatest(k, own), own <= k))
    earlier = F.transform(F.filter(each, lambda k: (k < own) & F.col("visited")), lambda k: spot(own, k, F.lit(True)))
    spots = F.when(F.col("home"), F.concat(among, earlier)).otherwise(F.transform(each, lambda k: spot(k, own, F.lit(False))))
    dealt = placed.select("fp", "band", "cell", F.inline(spots))
    dealt = dealt.repartition(partitions(spark), "band", "cell", "part").sortWithinPartitions("band", "cell", "part", F.desc("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            fp, band, cell, part, home = columns
            starts = np.concatenate([[0], np.flatnonzero((np.diff(band) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)) + 1])
            ends = np.concatenate([starts[1:], [len(fp)]])
            settled = np.add.reduceat(home.astype(np.int64), starts)
            found = [(fp[:0], fp[:0])]
            busy = (ends - starts > 1) & (settled > 0)
            for s, m, e in zip(starts[busy].tolist(), (starts + settled)[busy].tolist(), ends[busy].tolist(), strict=True):
                a, b = forest(fp[s:m], fp[m:e], radius)
                if len(a):
                    found.append((a, b))
            a, b = stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([_to_arrow(a), _to_arrow(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((_from_arrow(batch.column(0)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))))
            joined = tuple(np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
            fp, band, cell, part, _ = joined
            last = int(np.flatnonzero((band != band[-1]) | (cell != cell[-1]) | (part != part[-1])).max(initial=-1)) + 1
            if last:
                yield emit(tuple(x[:last] for x in joined))
                held = [tuple(x[last:] for x in joined)]
        if held:
            yield emit(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    kind = placed.schema["fp"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 4, bands: int | None = None) -> DataFrame:
    """(id, fp, component_id): the smallest id that a row reaches over links within the radius, itself included.

    Null and empty texts have fingerprint zero and are linked like any other; rows with a
    null id take part and get their class's smallest id, null where no row of it has one.
    bands: of a fixed grid; without it the grid is chosen by the number of fingerprints.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    grid = (bands, SEGMENT_BITS) if bands else best_grid(distinct.count(), radius)
    roots = components(links(distinct.select("fp"), radius, *grid))
    rooted = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = join_with_hot_keys(rooted.select("fp", "root"), lowest, "root").select("fp", "component_id")
    return join_with_hot_keys(prints, materialise(named, "named"), "fp").select("id", "fp", "component_id")


def _bit_share(similarity: float) -> float:
    """Share of the bits in which fingerprints of sets of a similarity differ, in the mean of many shingles."""
    return float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)


def radius_of(similarity: float, bits: int) -> int:
    """Hamming distance that fingerprints of texts with at least this Jaccard similarity of shingles hardly exceed.

    Sets of similarity j have a cosine of 2j / (1 + j), and a bit differs with the angle's
    share of pi, by up to a quarter more where shingles are few (3/16 for 4 of 5). Three
    standard deviations above that mean.
    """
    share = min(0.5, 1.25 * _bit_share(similarity))
    return int(bits * share + 3 * np.sqrt(bits * share * (1 - share)))


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows on both sides) that connect what all pairs of sets of at least this Jaccard similarity connect; two empty sets are alike.

    A breadth-first search, in which a row that has been reached is not compared again.
    """
    sizes = np.array([len(s) for s in sets])
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(ids, kind="stable")
    owners, first = np.repeat(np.arange(len(sets)), sizes)[order], np.searchsorted(ids[order], np.arange(len(known) + 1))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting = np.arange(len(sets))
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            own = ids[starts[x] : starts[x + 1]]
            counts = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shared = np.bincount(owners[at], minlength=len(sets))[waiting]
            union = sizes[x] + sizes[waiting] - shared
            hit = shared / np.maximum(union, 1) >= np.where(union > 0, similarity, 0)
            found, waiting = waiting[hit], waiting[~hit]
            left.append(np.full(len(found), x))
            right.append(found)
            queue += found.tolist()
    return np.concatenate(left), np.concatenate(right)


def confirmed(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): keys of texts that connect what the pairs of at least this similarity connect within each class.

    Members are rows (key, text, class, parts). A class of several parts is compared by
    pairs of parts, so that no task holds more than two of them.
    """
    spark = members.sparkSession
    bounded_batches(spark)
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != own) | (F.col("parts") == 1))
    spots = F.transform(others, lambda p: F.struct(F.least(p, own).alias("p"), F.greatest(p, own).alias("q")))
    dealt = members.select("key", "text", "class", F.inline(spots))
    dealt = dealt.repartition(partitions(spark), "class", "p", "q").sortWithinPartitions("class", "p", "q", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, keys, sets = None, [], []
        found: list[tuple[bytes, bytes]] = []

        def compare() -> None:
            if len(keys) > 1:
                found.extend((keys[a], keys[b]) for a, b in zip(*jaccard_forest(sets, similarity), strict=True))

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for key, text, *now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != spot:
                    compare()
                    spot, keys, sets = now, [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    sets.append(np.unique(shingle_hashes(text, width)))
            yield emit()
        compare()
        yield emit()

    return dealt.mapInArrow(run, "a binary, b binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, part_rows: int = PART_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows of docs that stay: of each class of near-duplicates the smallest id, all columns as they are.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least the
    given one. Candidates have a cell of similarity_grid in common and fingerprints of 256
    bits within radius_of; their components are compared text by text. As the grid cannot be
    sure of every pair at such a radius, those that share one of their Keys are verified too.
    """
    text = whole_text(f"`{text_col}`")
    key = F.unhex(F.md5(text))
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), key.alias("key"), F.length(text).cast("long").alias("chars")).alias("row"), text.alias("text"))
    keys = Keys(shingle_counts(docs, text_col, width), similarity)
    prints = materialise(fingerprints(rows, "row", "text", width, words=4, distinct=True, keys=keys).select("id.*", "fp", "keys"), "fingerprints")
    distinct = materialise(prints.select("fp", "keys").distinct(), "distinct-fingerprints")
    points = distinct.select("fp").distinct()
    bands, bits, turns = similarity_grid(distinct.count(), similarity, 4)
    placed = visits(points, bands, bits, 0, turns).union(shared_keys(distinct))
    roots = components(links_in_cells(placed, radius_of(similarity, 4 * BITS), cell_rows))
    texts = prints.select("key", "chars", "fp").distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    texts = materialise(texts.select("key", "chars", F.xxhash64(F.coalesce("root", "fp")).alias("class")), "candidates")
    sizes = texts.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).where("n > 1")
    sizes = materialise(sizes.select("class", F.greatest(F.ceil(F.col("n") / part_rows), F.ceil(F.col("chars") / PART_CHARS)).cast("int").alias("parts")), "candidate-classes")
    chosen = join_with_hot_keys(texts.select("key", "class"), sizes, "class")
    members = docs.select(key.alias("key"), text.alias("text")).join(chosen.select("key", "class", "parts"), "key")
    linked = components(confirmed(members, width, similarity))
    lows = materialise(prints.groupBy("key").agg(F.min("id").alias("low")), "lows")
    linked = materialise(lows.join(linked.withColumnRenamed("node", "key"), "key"), "linked")
    lowest = linked.groupBy("root").agg(F.min("low").alias("least"))
    named = join_with_hot_keys(linked.select("key", "root"), lowest, "root").select("key", "least")
    stay = lows.join(named, "key", "left").select(F.col("key").alias("_key"), F.coalesce("least", "low").alias("_stay"))
    return docs.join(stay, (key == stay["_key"]) & docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")


__all__ = ["classes", "confirmed", "fingerprints", "forest", "jaccard_forest", "links", "one_of_each", "shingle_fingerprint", "shingle_votes"]
