"""SimHash document fingerprints and a Hamming search over permuted block tables.

The terms of a text are its pairs of neighbouring words (a lone word is a term itself),
lower-cased in A-Z. Each occurrence of a term votes on every bit of the fingerprint, for
the bits set in the term's hash and against the others, with a weight that is the pair's
length in bytes, at most ``MAX_WEIGHT``: long words say more about a text than short ones.
A bit is set where the signed votes are positive.

All fingerprints within a Hamming radius r are found by cutting the bits into r + ``SPARE``
blocks: two fingerprints within r agree on at least ``SPARE`` blocks, so for every choice
of ``SPARE`` blocks there is a table keyed by them (the permuted fingerprint's leading
bits). Only equal keys are compared, and each comparison is on all bits. A pair counts in
the first table that it agrees in, so nothing has to be made distinct afterwards. A key
with many fingerprints is dealt out to several tasks.

Defined results: a null text is the empty text; a text without words has fingerprint zero;
equal texts have equal fingerprints; an empty table gives no rows; rows follow each other
by id descending, null ids last, repeated ids by a hash of their texts; ids that are no
integers raise a TypeError where the order matters; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rillstone.llm.common import bounded_batches, join_with_hot_keys, materialise, partitions, whole_text

BITS = 128
MAX_WEIGHT = 15
SPARE = 2
#: Fingerprints of a key that one task compares; keys with more are dealt out, so many at most.
KEY_ROWS, CROWDED_KEYS = 8192, 200_000
#: Bytes that are voted on at once, and terms whose weights surely fit a 16-bit lane.
CHUNK = 1 << 21
LANE = 65535 // MAX_WEIGHT

_GAP = re.compile(rb"[\x09-\x0d\x20]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Four bits of a hash, each in a 16-bit lane.
_LANES = np.array([sum(((n >> k) & 1) << (16 * k) for k in range(4)) for n in range(16)], np.uint64)
_LOW, _HIGH = _LANES[np.arange(256) & 15], _LANES[np.arange(256) >> 4]
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cut(text: bytes) -> list[bytes]:
    """Pieces of about CHUNK bytes, cut at white space only, each starting with the last word of the one before."""
    found, start = [], 0
    while len(text) - start > CHUNK:
        gap = _GAP.search(text, start + CHUNK)
        if gap is None:
            break
        end = gap.start()
        words = text[start:end].rsplit(None, 1)
        if not words:  # white space alone
            start = gap.end()
            continue
        last = end - len(words[-1])
        if len(words) < 2:  # one long word: the next piece starts with it and the word after it
            after = _GAP.search(text, gap.end())
            if after is None:
                break
            end, last = after.start(), gap.end()
        found.append(text[start:end])
        start = last
    return [*found, text[start:]]


def _votes(texts: list[bytes], bits: int) -> np.ndarray:
    """Signed votes (doubled set bits less all) of each text, all together at most a few CHUNKs long."""
    n, out = len(texts), np.zeros((len(texts), bits), np.int64)
    buf = _LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
    space = _SPACE[buf]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turn[::2], turn[1::2]
    if not len(starts):
        return out
    sizes = ends - starts
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="left")
    letters = np.flatnonzero(~space)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(len(letters)) - np.repeat(first, sizes)
    powers = _POWERS if sizes.max() <= len(_POWERS) else _powers(int(sizes.max()))
    words = _mix(np.add.reduceat((buf[letters].astype(np.uint64) + np.uint64(1)) * powers[within], first))
    paired = owner[1:] == owner[:-1]
    terms = words[:-1][paired] * np.uint64(3) + words[1:][paired]
    weights, of = np.minimum(sizes[:-1] + sizes[1:], MAX_WEIGHT)[paired], owner[1:][paired]
    count = np.bincount(owner, minlength=n)
    if (count == 1).any():
        lone = count[owner] == 1
        terms, weights, of = (np.concatenate(x) for x in ((terms, words[lone]), (weights, np.minimum(sizes[lone], MAX_WEIGHT)), (of, owner[lone])))
        order = np.argsort(of, kind="stable")
        terms, weights, of = terms[order], weights[order], of[order]
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    rank = np.arange(len(of)) - np.repeat(begin, np.diff([*begin, len(of)]))
    lanes = np.flatnonzero(rank % LANE == 0)
    scale = weights.astype(np.uint64)
    for k in range(bits // 64):
        octets = _mix(terms + np.uint64((_BASE * (k + 1)) % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            for half, table in enumerate((_LOW, _HIGH)):
                sums = np.add.reduceat(table[octets[:, byte]] * scale, lanes).view(np.uint16).reshape(-1, 4)
                at = 64 * k + 8 * byte + 4 * half
                np.add.at(out[:, at : at + 4], of[lanes], sums.astype(np.int64))
    return 2 * out - np.bincount(of, weights=weights, minlength=n).astype(np.int64)[:, None]


def simhash(texts: list[bytes], bits: int = BITS) -> np.ndarray:
    """Fingerprints as rows of bits // 8 bytes."""
    out = np.zeros((len(texts), bits), np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if held:
            np.add.at(out, [k for k, _ in held], _votes([t for _, t in held], bits))
            held.clear()

    for k, text in enumerate(texts):
        for piece in _cut(text):
            held.append((k, piece))
            size += len(piece) + 1
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    return np.packbits(out > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / (8.0 * a.shape[1])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fingerprint) of every row, the fingerprint in lower-case hex."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = simhash([(t.as_py() or "").encode() for t in batch.column(1)], bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes().hex() for p in prints], pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


# -- documents beside their successors ----------------------------------------------------


def _bucket(id_: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the id, in two steps of a square root of them each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < id_))
    heads = below(F.array(*[F.lit(r[0]) for r in rows]))
    inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows]), F.greatest(heads, F.lit(1)))
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + below(inner)).cast("int")


def in_sequence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, carrier) in partitions that hold runs of ids, descending, each followed by a copy of its successor.

    The texts are shuffled once. The runs' bounds are quantiles of the ids, as many as
    there are shuffle partitions; only these and each run's largest id reach the driver.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError("ids must be integers")
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(f"`{text_col}`").alias("text"))
    cuts = rows.stat.approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    runs = rows.withColumn("run", F.coalesce(_bucket(F.col("id"), sorted({int(c) for c in cuts})), F.lit(0)))
    tops = sorted((r["run"], r["top"]) for r in runs.groupBy("run").agg(F.max("id").alias("top")).collect())
    firsts = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    carriers = docs.sparkSession.createDataFrame(firsts, "top long, target int")
    sent = runs.join(F.broadcast(carriers), F.col("id").eqNullSafe(F.col("top")), "left")
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("carrier"))
    copy = F.struct(F.col("target").alias("run"), F.lit(True).alias("carrier"))
    placed = sent.select("id", "text", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at"))
    placed = placed.select("id", "text", "at.run", "at.carrier")
    return placed.repartitionById(n, "run").sortWithinPartitions("carrier", F.desc_nulls_last("id"), F.xxhash64("text"), "text").select("id", "text", "carrier")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of every text, of the text whose last third the next document's head replaces, and their likeness."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        done = False
        for batch in batches:
            carrier = batch.column(2).to_numpy(zero_copy_only=False)
            end = batch.num_rows
            if done:
                break
            if carrier.any():
                end, done = int(np.argmax(carrier)) + 1, True
            ids += batch.column(0).to_pylist()[:end]
            texts += batch.column(1).to_pylist()[:end]
            if len(texts) < 2:
                continue
            n = len(texts) - 1
            edited = []
            for text, after in zip(texts[:n], texts[1:], strict=True):
                k = len(text) // 3
                edited.append((text[: len(text) - k] + after[:k]).encode())
            prints, changed = simhash([t.encode() for t in texts], bits), simhash(edited, bits)
            hexed = [p.tobytes().hex() for p in prints[:n]]
            columns = [
                pa.array(ids[:n], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                pa.array(hexed, pa.string()),
                pa.array([p.tobytes().hex() for p in changed], pa.string()),
                pa.array(likeness(prints[:n], changed)),
                pa.array(likeness(prints[:n], prints[1:])),
            ]
            ids, texts = ids[n:], texts[n:]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_sequence(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


# -- the search ----------------------------------------------------------------------------


def block_tables(fingerprint: Column, radius: int, bits: int = BITS, spare: int = SPARE) -> Column:
    """Keys of a hex fingerprint in every table: (table, key), the key holding the chosen blocks' hex digits.

    Blocks are whole hex digits, so bits must be a multiple of 4 and radius + spare at most bits / 4.
    """
    digits = bits // 4
    cuts = [digits * k // (radius + spare) for k in range(radius + spare + 1)]
    blocks = [F.substring(fingerprint, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(t).alias("table"), F.concat(*[blocks[k] for k in chosen]).alias("key")) for t, chosen in enumerate(combinations(range(radius + spare), spare))])


def _masks(radius: int, bits: int, spare: int) -> np.ndarray:
    """Of each block, its bits in the fingerprint's big-endian words."""
    digits, cuts = bits // 4, [bits // 4 * k // (radius + spare) for k in range(radius + spare + 1)]
    whole = [int("".join("f" if a <= d < b else "0" for d in range(digits)), 16) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.array([[(m >> (bits - 64 * (k + 1))) & (2**64 - 1) for k in range(bits // 64)] for m in whole], np.uint64)


def _meetings(queries: DataFrame, prints: DataFrame, radius: int, bits: int, spare: int, key_rows: int) -> DataFrame:
    """(table, key, part, asks, fp): every query and fingerprint in every table, the queries of a key with many fingerprints in each of its parts."""
    spark = prints.sparkSession
    keys = lambda frame: frame.select("fingerprint", F.inline(block_tables(F.col("fingerprint"), radius, bits, spare))).select("table", F.xxhash64("key").alias("key"), F.unhex("fingerprint").alias("fp"))
    members, asked = keys(prints.select("fingerprint").distinct()), keys(queries.select("fingerprint").distinct())
    sizes = members.groupBy("table", "key").count().where(F.col("count") > key_rows)
    # At most CROWDED_KEYS rows, so it can be broadcast; beyond them only larger keys are dealt out.
    crowded = sizes.orderBy(F.desc("count"), "table", "key").limit(CROWDED_KEYS).select("table", "key", F.ceil(F.col("count") / key_rows).cast("int").alias("parts"))
    parts = lambda frame: frame.join(F.broadcast(crowded), ["table", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = parts(members).select("table", "key", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "fp")
    sent = parts(asked).select("table", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "fp")
    return held.unionByName(sent).repartition(partitions(spark), "table", "key", "part").sortWithinPartitions("table", "key", "part", F.desc("asks"))


def _compared(queries: DataFrame, prints: DataFrame, radius: int, bits: int, spare: int, key_rows: int, pairs: bool) -> DataFrame:
    bounded_batches(prints.sparkSession, 1 << 13)
    masks, tables = _masks(radius, bits, spare), list(combinations(range(radius + spare), spare))

    def near(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
        """Distances of all of a to all of b; 255 where they are beyond the radius or meet in an earlier table too."""
        apart = a[:, None] ^ b[None]
        distance = np.bitwise_count(apart).sum(axis=2, dtype=np.uint8)
        rows, columns = np.nonzero(distance <= radius)
        equal = ((apart[rows, columns][:, None] & masks[None]) == 0).all(axis=2)
        first = np.array([next(t for t, chosen in enumerate(tables) if e[list(chosen)].all()) == table for e in equal], bool)
        out = np.full(distance.shape, 255, np.uint8)
        out[rows[first], columns[first]] = distance[rows[first], columns[first]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, asking = None, np.zeros((0, bits // 64), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            table, key, part, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp = np.frombuffer(b"".join(batch.column(4).to_pylist()), ">u8").astype(np.uint64).reshape(len(table), -1)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(part) != 0)) + 1, [len(table)]])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                now = (int(table[s]), int(key[s]), int(part[s]))
                fresh = fp[s:e][asks[s:e]]
                asking = fresh if now != spot else np.concatenate([asking, fresh])
                spot, held = now, fp[s:e][~asks[s:e]]
                for k in range(0, len(asking) if len(held) else 0, 512):
                    distance = near(asking[k : k + 512], held, now[0])
                    rows, columns = np.nonzero(distance <= radius)
                    if pairs:
                        found.append((asking[k + rows], held[columns], distance[rows, columns]))
                    else:
                        n = np.bincount(rows, weights=distance[rows, columns] > 0, minlength=len(distance)).astype(np.int64)
                        found.append((asking[k : k + 512][n > 0], asking[:0], n[n > 0]))
            if found:
                a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
                words = lambda x: pa.array([r.astype(">u8").tobytes().hex() for r in x], pa.string())
                yield pa.RecordBatch.from_arrays([words(a), *([words(b)] if pairs else []), pa.array(n.astype(np.int64))], names=["query", *(["fingerprint"] if pairs else []), "n"])

    return _meetings(queries, prints, radius, bits, spare, key_rows).mapInArrow(run, f"query string, {'fingerprint string, ' if pairs else ''}n long")


def search(queries: DataFrame, prints: DataFrame, radius: int, bits: int = BITS, spare: int = SPARE, key_rows: int = KEY_ROWS) -> DataFrame:
    """(query, fingerprint, distance): for each distinct query fingerprint all distinct fingerprints within the radius, itself too.

    Both frames have a column fingerprint.
    """
    return _compared(queries, prints, radius, bits, spare, key_rows, True).select("query", "fingerprint", F.col("n").cast("int").alias("distance"))


def near_counts(queries: DataFrame, prints: DataFrame, radius: int, bits: int = BITS, spare: int = SPARE, key_rows: int = KEY_ROWS) -> DataFrame:
    """(query, n_near): of each distinct query fingerprint that has any, how many other distinct fingerprints lie within the radius."""
    return _compared(queries, prints, radius, bits, spare, key_rows, False).groupBy("query").agg(F.sum("n").alias("n_near"))


def report(docs: DataFrame, radius: int = 4, bits: int = BITS, every: int = 20) -> DataFrame:
    """edited_likeness with n_near: for the query set, rows whose id is divisible by every, how many other distinct fingerprints of the whole table lie within the radius; null for others."""
    rows = materialise(edited_likeness(docs, bits=bits), "fingerprints")
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    near = materialise(near_counts(rows.where(asks), rows, radius, bits), "neighbours")
    joined = join_with_hot_keys(rows.where(asks), near.withColumnRenamed("query", "fingerprint"), "fingerprint", "left")
    return joined.withColumn("n_near", F.coalesce("n_near", F.lit(0))).unionByName(rows.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
