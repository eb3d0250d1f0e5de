"""Packing documents into fixed-size sequences by cutting-stock column generation.

A document's ids end with an end id and are cut into whole sequences and one rest. What
remains is a cutting-stock problem over the histogram of piece lengths, which has at most
``size`` rows however large the corpus is: a linear program over patterns (multisets of
lengths that share a sequence) is solved by column generation, a knapsack dynamic program
prices new patterns, the solution is rounded down, and the few pieces beyond it are packed
best-fit. Ranked pieces of each length are then assigned to the slots of the patterns.

A sequence is padded to ``size`` unless its fill is a power of two, so a pattern costs its
fill where that is a power of two and ``size`` otherwise.

Tokens are computed once; the pieces (narrow rows, no ids) go to the shared folder. A
piece's rank within its length is its rank within (map task, length), counted while
tokenising, plus the tasks' prefix sums: no task ever sees all pieces of a length.

Defined results: a null text is the empty text and yields the end id alone; an empty table
gives no rows; rows with the same or a null id are packed as separate documents; other
columns are not read.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import bounded_batches, materialise

SIZE = 1024
END_ID = 0
#: Rounds of pricing that must save half a sequence together for more to follow.
TAIL = 10
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 250_000


class ByteBpe:
    """Ids of a byte-level BPE as little-endian unsigned 32-bit bytes.

    The pre-tokeniser never crosses a single space between two non-space characters, so a
    text is cut there and each distinct word is encoded once. A text with a double or
    trailing space, where that does not hold, is encoded as a whole; one that names a
    special token goes through the tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: str = "<|endoftext|>") -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json_path, self.special = json_path, special
        plain = self.plain
        assert sys.byteorder == "little" and array("I").itemsize == 4

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                found = self[word] = array("I", plain(" " + word)).tobytes()
                return found

        self.words = Words()

    @cached_property
    def full(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> bytes:
        if self.special in text:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text or text.endswith(" "):
            return np.array(self.plain(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return np.array(self.plain(head), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


def public_byte_bpe(name: str = "byte_bpe_50k") -> ByteBpe:
    import public_tokenizers

    return ByteBpe(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(name: str) -> ByteBpe:
    """One encoder a worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = public_byte_bpe(name)
    return _ENCODERS[name]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Cut documents: (id, start, length, ids_crc32, doc_tokens, task, task_rank), rank counted by task and length."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen, tail = [0] * (size + 1), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + tail)
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    at.append(k)
                    rows.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, seen[length]))
                    seen[length] += 1
            found = np.array(rows, np.int64).reshape(-1, 5)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(found[:, c]) for c in range(4)), pa.array(np.full(len(rows), task, np.int32)), pa.array(found[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, task_rank long")


# -- the plan, over the histogram alone --------------------------------------------------


def _fill_cost(size: int) -> np.ndarray:
    """Tokens that a sequence of each fill takes up."""
    fills = np.arange(size + 1)
    return np.where((fills & (fills - 1)) == 0, fills, size).astype(float)


def _best_values(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over exact fills: the best value of each fill, and the last length that it takes."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0.0
    usable = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for fill in range(int(lengths[0]), size + 1):
        n = usable[fill]
        got = best[fill - lengths[:n]] + values[:n]
        k = int(np.argmax(got))
        if got[k] > -np.inf:
            best[fill], last[fill] = got[k], k
    return best, last


def _pattern(last: np.ndarray, lengths: np.ndarray, fill: int, first: int | None = None) -> dict[int, int]:
    """The pattern of a fill, as {index of length: copies}; first is a length that it holds besides."""
    pattern = {} if first is None else {first: 1}
    while fill > 0:
        k = int(last[fill])
        pattern[k] = pattern.get(k, 0) + 1
        fill -= int(lengths[k])
    return pattern


def price(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The pattern of least cost minus value, with that difference."""
    best, last = _best_values(values, lengths, size)
    reduced = _fill_cost(size) - best
    reduced[0] = np.inf
    fill = int(np.argmin(reduced))
    return float(reduced[fill]), _pattern(last, lengths, fill)


def priced(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Farley's ratio of the values, and patterns (rows of copies): the best one, and the best full one that holds each length.

    Values divided by the ratio, the largest value of a pattern over its cost, are feasible
    duals, so they bound the linear program from below.
    """
    best, last = _best_values(values, lengths, size)
    cost = _fill_cost(size)
    found = [_pattern(last, lengths, 1 + int(np.argmin((cost - best)[1:])))]
    for k, length in enumerate(lengths.tolist()):
        if best[size - length] > -np.inf:
            found.append(_pattern(last, lengths, size - length, k))
    rows = np.zeros((len(found), len(lengths)))
    for n, pattern in enumerate(found):
        rows[n, list(pattern)] = list(pattern.values())
    return float((best[1:] / cost[1:]).max()), rows


def _fullest(left: np.ndarray, lengths: np.ndarray, size: int) -> dict[int, int]:
    """One pattern from what is left: the longest pieces first, each as often as it is there and fits."""
    room, pattern = size, {}
    at = len(lengths) - 1
    while at >= 0 and room:
        at = min(at, int(np.searchsorted(lengths, room, side="right")) - 1)
        while at >= 0 and left[at] <= 0:
            at -= 1
        if at >= 0:
            n = min(int(np.ceil(left[at])), room // int(lengths[at]))
            pattern[at] = n
            room -= n * int(lengths[at])
            at -= 1
    return pattern


def _best_fit(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a multiset given by its counts: patterns and their repeats."""
    left, found = counts.copy(), []
    while left.any():
        pattern = _fullest(left, lengths, size)
        times = min(int(left[k]) // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
        found.append((pattern, times))
    return found


def _first_basis(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[dict[int, int]]:
    """A column for each length.

    Best-fit patterns, each repeated until it uses up a length, which the column then
    stands for; lengths used up by the way get a pattern of their own. In the order in
    which lengths are used up the columns are triangular, so they are a feasible basis.
    """
    left = demand.copy()
    columns: list[dict[int, int]] = [{k: size // int(x)} for k, x in enumerate(lengths)]
    while (left > 0).any():
        pattern = _fullest(left, lengths, size)
        spent = min(pattern, key=lambda k: left[k] / pattern[k])
        times = left[spent] / pattern[spent]
        columns[spent] = pattern
        left[spent] = 0.0
        for k, n in pattern.items():
            if k != spent:
                left[k] -= n * times
                left[k] = left[k] if left[k] > 1e-9 else 0.0
    return columns


class LinearProgram:
    """The cutting-stock program's restricted master: a basis with its inverse, improved by priced patterns.

    It starts from best-fit patterns. Demands are raised by a thousandth of a piece at most,
    drawn with a fixed seed, so that no step of the simplex method is degenerate.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, size: int = SIZE) -> None:
        self.lengths, self.size, self.cost_of = lengths, size, _fill_cost(size)
        self.demand = counts + 1e-3 * np.random.default_rng(0).random(len(counts))
        columns = _first_basis(lengths, self.demand, size)
        self.basis = np.zeros((len(columns), len(columns)))  # a row for each pattern
        for n, pattern in enumerate(columns):
            self.basis[n, list(pattern)] = list(pattern.values())
        self.bound, self.rounds, self.pivots = 0.0, 0, 0
        self._bounded_by(lengths.astype(float))  # a length's own tokens are its value: a first bound
        self._factor()

    def _factor(self) -> None:
        self.costs = self.cost_of[(self.basis @ self.lengths).astype(int)]
        self.inverse = np.linalg.inv(self.basis.T)
        self.amounts = np.maximum(self.inverse @ self.demand, 0.0)
        self.duals = self.costs @ self.inverse

    @property
    def cost(self) -> float:
        return float(self.costs @ self.amounts)

    def _enter(self, pattern: np.ndarray, cost: float, reduced: float) -> None:
        step = self.inverse @ pattern
        able = step > 1e-7
        out = int(np.argmin(np.where(able, self.amounts / np.where(able, step, 1.0), np.inf)))
        times = self.amounts[out] / step[out]
        pivot = self.inverse[out] / step[out]
        rows, columns = np.flatnonzero(step), np.flatnonzero(pivot)
        self.duals += reduced * pivot
        self.inverse[np.ix_(rows, columns)] -= np.outer(step[rows], pivot[columns])
        self.inverse[out] = pivot
        self.amounts = np.maximum(self.amounts - times * step, 0.0)
        self.amounts[out], self.basis[out], self.costs[out] = times, pattern, cost
        self.pivots += 1
        if self.pivots % 200 == 0:
            self._factor()

    def _bounded_by(self, values: np.ndarray) -> np.ndarray:
        """Patterns priced by the values, which also bound the optimum from below."""
        ratio, found = priced(values, self.lengths, self.size)
        self.bound = max(self.bound, float(values @ self.demand) / max(ratio, 1e-12))
        return found

    def improve(self) -> bool:
        """Price patterns by the duals and let in what lowers the cost; false where no pattern does."""
        found = self._bounded_by(self.duals)
        self.rounds += 1
        costs = self.cost_of[(found @ self.lengths).astype(int)]
        least = -1e-6  # later a tenth of the first one's reduction: what is worth less waits for fresh prices
        for _ in range(len(found)):
            reduced = costs - found @ self.duals
            k = int(np.argmin(reduced))
            if reduced[k] > least:
                break
            least = min(least, float(reduced[k]) / 10)
            self._enter(found[k], float(costs[k]), float(reduced[k]))
        return least < -1e-6


def _rounded(patterns: np.ndarray, amounts: np.ndarray, counts: np.ndarray, up: bool) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole repeats of the patterns, with up one more of those with the largest fractions as long as their pieces last; what is left."""
    left, times = counts.copy(), np.zeros(len(patterns), np.int64)
    whole = np.floor(amounts + 1e-6).astype(np.int64)
    for extra in (False, True) if up else (False,):
        for k in np.argsort(-(amounts - whole if extra else amounts), kind="stable").tolist():
            held = np.flatnonzero(patterns[k])
            copies = patterns[k, held].astype(np.int64)
            n = min(1 if extra else int(whole[k]), int((left[held] // copies).min()))
            left[held] -= n * copies
            times[k] += n
    plan = [({int(i): int(patterns[k, i]) for i in np.flatnonzero(patterns[k])}, int(times[k])) for k in np.flatnonzero(times)]
    return plan, left


def padding(plan: list[tuple[dict[int, int], int]], lengths: np.ndarray, size: int = SIZE) -> float:
    """Tokens of a plan's sequences that no piece fills."""
    fills = [(sum(int(lengths[k]) * n for k, n in pattern.items()), times) for pattern, times in plan]
    return float(sum((_fill_cost(size)[fill] - fill) * times for fill, times in fills))


def solve(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE, gap: float = 1e-4, sequences: float = 2.0) -> list[tuple[dict[int, int], int]]:
    """Patterns with their repeats that cover the histogram exactly: column generation, then rounding.

    lengths ascend. Patterns are priced until none lowers the cost, or Farley's bound proves
    it to be within the fraction gap of the linear program's optimum or within so many
    sequences of it, which rounding costs anyway, or the last TAIL rounds together saved less
    than half a sequence: the long tail of column generation that rounding would undo. Best-fit decreasing packs what rounding
    leaves over. It is also the fallback: the result is never worse than it alone.
    """
    if not len(lengths):
        return []
    program = LinearProgram(lengths, counts, size)
    costs = [program.cost]
    while program.improve():
        costs.append(program.cost)
        if program.cost - program.bound <= max(gap * program.bound, sequences * size) or len(costs) > TAIL and costs[-1 - TAIL] - costs[-1] < size / 2:
            break
    plans = []
    for up in (True, False):
        plan, left = _rounded(program.basis, program.amounts, counts, up)
        plans.append(plan + _best_fit(lengths, left, size))
    return min([*plans, _best_fit(lengths, counts, size)], key=lambda x: padding(x, lengths, size))


def slots(plan: list[tuple[dict[int, int], int]], lengths: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: a run of ranks takes one slot of a pattern's repeats."""
    rows, used, sequence = [], {int(x): 0 for x in lengths}, 0
    for pattern, times in plan:
        offset = 0
        for k, n in sorted(pattern.items(), key=lambda x: -lengths[x[0]]):
            length = int(lengths[k])
            for _ in range(n):
                rows.append((length, used[length], sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    found = np.array(rows, np.int64).reshape(-1, 4)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The histogram has at most ``size`` rows and the slot table as many as its patterns
    have slots, both whatever the corpus; only these reach the driver and the tasks.
    """
    cut = materialise(pieces(docs, id_col, text_col, size, tokenizer), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    lengths = np.array(sorted(r["length"] for r in histogram), np.int64)
    counts = np.array([n for _, n in sorted((r["length"], r["n"]) for r in histogram)], np.int64)
    table = slots(solve(lengths, counts, size), lengths)
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    keys = (table[:, 0] << 48) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            slot = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            sequence = table[slot, 2] + rank - table[slot, 1]
            kept = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(table[slot, 3])], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return narrow.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
