"""What larger tables and odd texts showed: each case gave other results or grew beyond its bounds before."""

import math
import random
import re
import time
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import bm25, chunking, dense, lexicon, metrics


def one(spark, column, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"x{k} string" for k in range(len(values))))
    return row.select(column(*[F.col(f"x{k}") for k in range(len(values))]).alias("r")).first().r


def test_upper_maps_letter_by_letter_as_sql_does(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["", "Straße\nﬁn ŉ ᾳᾀ ǰ é", "ß", "abc ÿ ς", *map(chr, [*range(0x80, 0x530), *range(0x580, 0x590), *range(0x1C80, 0x2000), 0xA7CD, 0xA7DB, *range(0xFB00, 0xFB18), 0x10D70])]
    want = [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", T.upper(F.col("t")).alias("u")).orderBy("n").collect()
    assert [r.u for r in rows] == want
    assert one(spark, T.upper, None) is None


def test_nearest_holds_few_scores_and_agrees_with_a_full_sort():
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(700, 16)).astype(np.float32).astype(float)
    matrix[300:600] = matrix[:300]  # ties, of which the earlier row is first
    matrix[650:] = 0
    asked = np.vstack([matrix[:40], np.zeros((1, 16)), rng.normal(size=(30, 16)) * 1e6])
    full = np.round(np.einsum("qd,nd->qn", asked, matrix, optimize=False), 12)
    at = np.argsort(-np.round(full, 9), axis=1, kind="stable")
    for k in (1, 10, 700, 900):
        q, d, score = dense.nearest(matrix, asked, k)
        width = min(k, 700)
        assert q.tolist() == np.repeat(np.arange(71), width).tolist()
        small = q < 41  # beyond 12 places of large scores the order of additions may show
        assert d[small].tolist() == at[:41, :width].ravel().tolist()
        assert np.allclose(score, np.take_along_axis(full, at[:, :width], 1).ravel(), rtol=1e-12)


def test_dense_blocks_stay_within_their_memory(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6000, 8)).astype(np.float32)
    base = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "doc_id long, vector array<float>")
    asked = base.select(F.col("doc_id").alias("query_id"), "vector")
    peaks = []

    def spied(*args):
        tracemalloc.start()
        try:
            return nearest(*args)
        finally:
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    nearest = dense.nearest
    step = dense.CELLS // len(vectors)
    spied(vectors.astype(float), vectors[:step].astype(float), 10)
    assert max(peaks) < 64 << 20  # 6000 x 6000 scores alone are 288 MB
    got = {(r.query_id, r["rank"]): r.doc_id for r in dense.topk(base, asked, 2).where("query_id < 50").collect()}
    full = np.argsort(-np.round(vectors[:50].astype(float) @ vectors.T.astype(float), 9), axis=1, kind="stable")
    assert got == {(q, r + 1): full[q, r] for q in range(50) for r in range(2)}


def test_token_windows_tokenise_a_long_text_once(spark):
    text = "ab, " * 40_000
    rows = spark.createDataFrame([(text,), (None,), ("",), (" \n",)], "t string").select(T.token_windows(T.count_tokens(F.coalesce("t", F.lit(""))), 100).alias("w"))
    start = time.perf_counter()
    got = [r.w for r in rows.collect()]
    assert time.perf_counter() - start < 20  # 1200 windows, each of which cut the whole text anew
    assert [len(w) for w in got] == [1200, 0, 0, 0] and "".join(got[0]).replace(" ", "") == "ab," * 40_000


def _odd_texts():
    rng = random.Random(7)
    bits = ["# A", "##  b ", "#x", "####### no", "　# wide", "#  ", "|a|b|", "|", "| x |  ", "", " \t", "one. two!three?  four", "。中文。句子！ ", "a..b", "x" * 900, "w " * 700 + ".", "s. " * 500, "|c|d|\n" * 300, " ", "\x1c", "\x1f", "\x85", "\r", "\r\n", "\x0b", " p ", "...", " q. r "]
    return ["", " \n ", *["\n".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(250)], *["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(150)]]


def test_chunks_of_whole_documents_equal_those_of_shuffled_lines(spark):
    docs = spark.createDataFrame([*enumerate(_odd_texts()), (9000, None)], "doc_id long, text string").cache()
    cut = chunking.blocks(chunking.sections(docs)).cache()
    for new, old, key in (
        (chunking.document_blocks(docs), cut, "block_no"),
        (chunking.document_structure_chunks(docs), chunking.structure_chunks(cut), "chunk_index"),
        (chunking.document_semantic_chunks(docs), chunking.semantic_chunks(chunking.units(cut)), "chunk_index"),
    ):
        rows = lambda df, names=sorted(old.columns), key=key: sorted(map(tuple, df.select("doc_id", "section_no", key, *names).collect()), key=lambda r: r[:3])
        assert sorted(new.columns) == sorted(old.columns) and {f.name: f.dataType for f in new.schema} == {f.name: f.dataType for f in old.schema}
        want = rows(old)
        assert len(want) > 500 and rows(new) == want
        plan = new._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and "FlatMapGroups" not in plan


def test_nfc_stays_out_of_python(spark):
    texts = [None, "", "  \x1c\n", "é x ", " \x1få b\x1e　\n", "가 가", "Å", "a\n", "x" * 10, "ﬁ", "\U0001d15e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", T.nfc(F.col("t")).alias("r"))
    assert [r.r for r in rows.orderBy("n").collect()] == [None if t is None else unicodedata.normalize("NFC", t).strip() or None for t in texts]
    assert "Python" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert spark.sql("SELECT cast(X'61EDA080' AS string) AS t").select(T.nfc(F.col("t")).alias("r")).first().r is None


def test_postings_hold_few_documents_at_once(spark, monkeypatch):
    """A task keeps the words of DOCUMENTS documents, not those of an Arrow batch of 10,000."""
    seen = {}
    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.setdefault("run", run))
    bm25._postings(docs, ["a", "b"], T.bm25_tokens)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array([["a", "b", "a", "c"]] * 5000)], names=["doc_id", "tokens"])
    out = list(seen["run"](iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 5000
    assert out[-1].to_pylist()[-1] == {"doc_id": 4999, "length": 4, "terms": [0, 1], "counts": [2, 1]}


def test_normalised_markdown_is_linear_and_as_line_by_line(spark):
    drop = ("Source: ", "Raw output directory: ", "## Source file: ")
    bits = ["Source: x", "Source: ", " Source: y", "# Cleaned Magic-PDF / MinerU Text", "# Cleaned Magic-PDF / MinerU Text x", "## Source file:  z", "a ![x](y) b", "![a", "b](c)", "t  ", "　u　", "", " ", "\r", "\r\n", "\x1c", "\x85", "\n", "\n\n\n", "Raw output directory: q"]
    rng = random.Random(11)
    texts = ["", *["\n".join(rng.choices(bits, k=rng.randint(1, 8))) for _ in range(400)], "a" + " " * 300_000 + "b"]

    def plain(text):
        kept = [x for x in chunking._BREAK.split(text) if (s := x.strip(chunking.BLANKS)) != "# Cleaned Magic-PDF / MinerU Text" and not s.startswith(drop)]
        out = re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"!\[[^\]]*\]\(([^)]+)\)", r"[Image: \1]", x).rstrip(chunking.BLANKS) for x in kept).strip(chunking.BLANKS))
        return out + "\n" if out else ""

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", T.normalise_markdown(F.col("t")).alias("r")).orderBy("n")
    start = time.perf_counter()
    assert [r.r for r in rows.collect()] == list(map(plain, texts))
    assert time.perf_counter() - start < 20  # the long run of blanks alone took its square


def test_percentiles_equal_sparks_own_without_its_one_task(spark):
    rng = random.Random(13)
    rows = [("a", rng.gauss(0, 5)) for _ in range(30_000)] + [("b", float(rng.randint(0, 3))) for _ in range(5000)] + [("c", 1.5), ("d", None), (None, 2.0), (None, 4.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = {"low": 0.0, "median": 0.5, "p95": 0.95, "top": 1.0}
    want = df.groupBy("g").agg(F.avg("v").alias("mean"), *[F.percentile("v", p).alias(n) for n, p in shares.items()])
    found = metrics.grouped_percentiles(df, "g", "v", shares)
    key = lambda r: str(r.g)
    for x, y in zip(sorted(found.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert x.g == y.g and all((x[n] is None and y[n] is None) or math.isclose(x[n], y[n], rel_tol=1e-12) for n in ("mean", *shares)), (x, y)
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_top_terms_equal_the_best_mined_terms_without_a_row_per_term_and_document(spark):
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = ["".join(rng.choices(letters, k=4)) for _ in range(25)]
    texts = ["" for _ in range(60)]
    for k, stem in enumerate(stems):  # a stem lies in words of many beginnings and ends, in 1 to 25 documents
        for n in rng.sample(range(60), k + 1):
            texts[n] += "".join(f" {rng.choice(letters)}{stem}{rng.choice(letters)}" for _ in range(6))
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").cache()
    every = lexicon.mined_terms(docs)
    order = lambda df: df.orderBy(F.round("score", 9).desc(), "term")
    columns = ["term", "frequency", "document_count", F.round("score", 9)]
    want = order(every).select(*columns).collect()
    assert len(want) > 10 and len({r.document_count for r in want}) > 3
    for n in (10, 10_000):
        assert order(lexicon.top_terms(docs, n)).select(*columns).collect() == want[:n]
    valid = lexicon.valid_terms(docs)
    assert sorted(r.term for r in valid.collect()) == sorted(r.term for r in want)
    assert "document_count" not in valid.columns and "doc_id" not in valid._jdf.queryExecution().optimizedPlan().toString()
