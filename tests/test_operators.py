"""The library's operators on small hand-made tables: tie-breaks, edges and folds."""

import importlib
import math
import random
import re
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import bm25, chunking, conversation, dense, evaluation, fusion, lexicon, metrics, planning, rules
from rillstone.plans import catalogue, evaluation_catalogue, sqlguard
from rillstone.sources import files
from rillstone.streaming import events


def one(spark, column, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"x{k} string" for k in range(len(values))))
    return row.select(column(*[F.col(f"x{k}") for k in range(len(values))]).alias("r")).first().r


def test_sections_blocks_and_units(spark):
    text = "intro\n# A\n\n  ## B\none. two!\n#x not\n|a|b|\n|--|--|\n\n|c|\ntail\n# B\nlast"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = chunking.sections(docs)
    assert [(r.section, r.text.split("\n")[0]) for r in parts.orderBy("section_no").collect()] == [("Document", "intro"), ("B", "one. two!"), ("B", "last")]
    found = chunking.blocks(parts).where("section_no = 2").orderBy("block_no").collect()
    assert [r.type for r in found] == ["paragraph", "table", "table", "paragraph"]
    units = chunking.units(chunking.blocks(parts)).where("section_no = 2").orderBy("unit_no").collect()
    assert [r.text for r in units][:3] == ["one.", "two!", "#x not"]


def test_sentences_cut_decimals(spark):
    assert one(spark, T.sentences, "A 3.5%! B? C. ") == ["A 3.", "5%!", "B?", "C."]


def test_markdown_clean_up(spark):
    got = one(spark, T.normalise_markdown, "Source: x\r\n# T  \r\n\r\n\r\n\r\n![a](b.png) z  \n")
    assert got == "# T\n\n[Image: b.png] z\n"
    assert one(spark, T.flatten_markdown, "# T\n|a| b |\n|---|:---|\nx") == "T\na；b\nx\n"
    html = "<p>x</p><table><tr><th>a|b</th><th>c</th></tr><tr><td>1</td></tr></table><img src=\"u\">y"
    assert one(spark, T.html_to_text, html) == "x\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |\n\n[Image omitted: u]\ny"


def test_small_text_functions(spark):
    assert one(spark, lambda x: T.page_set(x, F.lit(6)), "1-3, 7,5") == [0, 1, 2, 4]
    assert one(spark, T.preview, "a  " * 300).endswith("...") and one(spark, T.preview, " a  b ") == "a b"
    assert one(spark, T.question_key, "Wie_geht's, Ü?") == "wiegehtsü"
    assert one(spark, T.json_object, "x ```json\n{\"a\": 1}\n``` y") == '{"a": 1}'
    assert one(spark, T.keywords, "a, b，c；d/e\n f  g ") == ["a", "b", "c", "d", "e", "f g"]
    assert one(spark, T.percent_encoded, "a b/é") == "a%20b%2F%C3%A9"
    assert one(spark, T.nfc, " é ") == "é"
    assert one(spark, T.front_matter, "---\nname: x\ndescription: a: b\n---\nbody") == {"name": "x", "description": "a: b"}
    assert one(spark, T.amount, "1.5万") == 15000.0
    odd = "ab 1cd a bbad1ecab5a43ebe9f8f ABCDEFGHIJKLMNOP x2"
    assert one(spark, T.ascii_terms, odd) == [t.upper() for t in re.findall(r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9]{1,11}", odd)]


def test_index_page_records(spark):
    page = "2024-01-01 ~ 2024-01-07\n同比 +1.5%｜环比 -2% 平均值 3.4万\n按涨幅\na\n9\nb\n8\nc\n7.5\n4\nd\n6\n5\ne\nx"
    assert [tuple(x) for x in one(spark, T.date_periods, page)] == [("2024-01-01", "2024-01-07")]
    assert [tuple(x) for x in one(spark, T.index_summaries, page)] == [("+1.5%", "-2%", "3.4万")]
    assert [(x.rank, x.term) for x in one(spark, T.relevance_ranking, page)] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


@pytest.mark.parametrize(("n", "count"), [(0, 0), (4, 1), (5, 2), (10, 3), (11, 4)])
def test_fixed_windows(spark, n, count):
    docs = spark.createDataFrame([(1, ",".join("a" * ((n + 1) // 2))[:n])], "doc_id long, text string")
    assert chunking.fixed_chunks(docs, 4, 1).count() == count


@given(st.lists(st.text("ab. ", min_size=1, max_size=60).filter(str.strip), min_size=1, max_size=12))
@settings(max_examples=40, deadline=None)
def test_fold_keeps_text_and_limits(texts):
    rows = [("sentence", t.strip()) for t in texts]
    chunks = chunking.fold("S", rows, most=30, least=8)
    assert re.sub(r"\s", "", "".join(c[5].removeprefix("Section: S") for c in chunks)) == re.sub(r"\s", "", "".join(texts))
    assert all(c[2] == chunking.token_count(c[5]) <= 30 for c in chunks)
    packed = chunking.packed_blocks("S", rows, most=30, least=8)
    assert re.sub(r"\s", "", "".join(c[5].removeprefix("Section: S") for c in packed)) == re.sub(r"\s", "", "".join(texts))


def test_cut_and_table_rules():
    units = chunking.Lengths([".".join("a" * 5) + "."] * 4, 0)  # ten tokens each
    assert [units(0, k) for k in range(5)] == [0, 10, 20, 30, 40]
    assert chunking.best_cut(units, [0.5, 0.5, 0.1], 0, 4, 5) == 1
    assert chunking.best_cut(units, [None, None, None], 0, 4, 25) == 3
    assert chunking.best_cut(units, [None, None, None], 0, 4, 99) == 3
    assert chunking.best_cut(units, [0.1, 0.9, 0.5], 0, 4, 15) == 2 and chunking.best_cut(units, [0.9, 0.1, 0.5], 0, 4, 25, by_gap=True) == 3
    parts = chunking.table_parts("|h|\n|-|\n" + "\n".join("|a b c|" for _ in range(4)) + "\n" + "|" + "x y " * 40 + "|", 30)
    assert all(t.startswith("|h|\n|-|") for k, t in parts if k == "table_split") and parts[-1][0] in ("table_token_fallback", "table_split")
    wide = chunking.table_parts("|h|\n|-|\n" + "|" + "x y " * 40 + "|\n|a|", 30)
    assert [k for k, _ in wide][-1] == "table_split" and wide[0][0] == "table_token_fallback" and wide[-1][1] == "|h|\n|-|\n|a|"
    text = "One two three. Four five six. Seven eight nine. " * 6
    groups = chunking.sized_units([("paragraph", text)], 40, 10)
    assert {k for k, _ in groups} == {"semantic_sentence_group"} and all(chunking.token_count(t) <= 40 for _, t in groups)
    assert "".join(t for _, t in groups) == "".join(chunking.split_sentences(text))
    assert [k for k, _ in chunking.sized_units([("paragraph", "x " * 60)], 40)] == ["token_fallback"] * 3


def test_bm25_fill_repeats_and_ties(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["x", "a b", "a", "y", "b b a", "z", None])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a a b")], "query_id long, text string")
    got = bm25.topk(docs, asked, 5).orderBy("rank").collect()
    assert [r.doc_id for r in got][3:] == [0, 3] and got[3].score == 0.0
    once, twice = ({r.doc_id: r.score for r in bm25.topk(docs, asked, fill=False, repeats=x).collect()} for x in (False, True))
    assert twice[2] == pytest.approx(2 * once[2]) and set(once) == {1, 2, 4}
    assert bm25.topk(docs.where("doc_id < 0"), asked, 5).count() == 0


def test_bm25_in_blocks_agrees_with_a_plain_sum(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(40)))) for k in range(300)]
    asked = [(q, " ".join(rng.choices([*words, "none"], k=5))) for q in range(12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    mean, want = sum(len(t.split()) for _, t in docs) / 300, []
    for q, text in asked:
        score = {}
        for term in set(text.split()):
            df = sum(term in t.split() for _, t in docs)
            for d, t in docs:
                if tf := t.split().count(term):
                    score[d] = score.get(d, 0.0) + math.log(1 + (300 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t.split()) / mean))
        want += [(q, d) for d, _ in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]]
    for block in (2048, 5):
        monkeypatch.setattr(bm25, "QUERIES", block)
        assert [(r.query_id, r.doc_id) for r in bm25.topk(*frames, 4, fill=False).orderBy("query_id", "rank").collect()] == want


def test_dense_blocks_agree_with_one_block(spark):
    rows = [(k, [float((k * 7) % 5), float(k % 3), 1.0]) for k in range(40)]
    base = spark.createDataFrame(rows, "doc_id long, vector array<float>").withColumn("vector", dense.normalised(F.col("vector")))
    asked = base.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    key = lambda df: [(r.query_id, r["rank"], r.doc_id) for r in df.orderBy("query_id", "rank").collect()]
    assert key(dense.topk(base, asked, 3)) == key(dense.topk(base, asked, 3, block=7))


def test_fusion_is_symmetric_and_breaks_ties_by_rank_then_id(spark):
    a = spark.createDataFrame([(1, 5, 1, 0.9), (1, 6, 2, 0.8)], "query_id long, doc_id long, rank int, score double")
    b = spark.createDataFrame([(1, 7, 1, 3.0), (1, 6, 2, 2.0)], "query_id long, doc_id long, rank int, score double")
    order = lambda x, y: [r.doc_id for r in fusion.fuse(x, y).orderBy("rank").collect()]
    assert order(a, b) == order(b, a) == [6, 5, 7]


def test_cache_merge_and_confusion(spark):
    cache = lambda label, why: spark.createDataFrame([(1, 1, label, why)], "query_id long, doc_id long, label int, reason string")
    got = metrics.merge_caches(cache(2, "first"), cache(2, "second"), cache(1, "third")).first()
    assert (got.label, got.reason, got.conflicts) == (2, "second", 1)
    rows = spark.createDataFrame([("a", "a"), ("b", "a")], "actual string, predicted string")
    assert sum(r.n for r in metrics.confusion(rows, "actual", "predicted", ["a", "b", "c"]).collect()) == 2
    by = {r.label: r for r in metrics.class_metrics(rows, "actual", "predicted", ["a", "b", "c"]).collect()}
    assert by["b"].precision == 0.0 and by["a"].recall == 1.0 and by["c"].f1 == 0.0


def test_quota_is_a_round_robin(spark):
    rows = spark.createDataFrame([(k, "fact", "d1" if k < 5 else "d2") for k in range(8)], "id long, kind string, doc string")
    assert sorted(r.id for r in metrics.quota_sample(rows, {"fact": 4}, "kind", "doc", "id").collect()) == [0, 1, 5, 6]


def test_fragments_entropy_and_segments(spark):
    terms = spark.createDataFrame([("ab", 10), ("abc", 9), ("abcde", 9)], "term string, frequency long")
    assert sorted(r.term for r in lexicon.without_fragments(terms).collect()) == ["ab", "abcde"]
    assert sorted((r.shorter, r.longer) for r in lexicon.nested_pairs(terms).collect()) == [("ab", "abc"), ("ab", "abcde"), ("abc", "abcde")]
    cut = lexicon.segmenter({"北京": 10, "大学": 8, "北京大学": 1, "生": 3})
    row = spark.createDataFrame([(["x1", "北京大学生"],)], "t array<string>").select(cut("t").alias("r")).first().r
    assert row == ["x1", "北京", "大学", "生"] or row == ["x1", "北京大学", "生"]


def test_turns_and_compaction(spark):
    def talk(turns):
        rows = [(1, 0, "system", "s")] + [(1, 1 + 2 * k + j, r, "t") for k in range(turns) for j, r in enumerate(("user", "assistant"))]
        return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    archived = lambda df, **k: conversation.compacted(df, **k).first().archived
    assert archived(talk(9)) == 3 and archived(talk(8)) == 0
    assert archived(talk(7), window_tokens=10) == 1 and archived(talk(5), window_tokens=10) == 0
    assert archived(talk(9), summarised=F.lit(False)) == 0
    assert conversation.router_history(talk(9)).count() == 12


def test_planning(spark):
    rows = spark.createDataFrame([(k,) for k in range(10)], "k long").withColumn("g", F.lit(1))
    assert [r["count"] for r in planning.batches(rows, 3, "g", "k").groupBy("batch_no").count().orderBy("batch_no").collect()] == [3, 3, 4]
    days = spark.createDataFrame([(f"2024-01-{1 + d:02d}",) for d in (4, 5, 9, 10)], "e string").select(F.lit("2024-01-01").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    assert [r.band for r in planning.period_band(spark, days, "s", "e").collect()] == ["7d", "7d"]
    status = spark.createDataFrame([("a", "success", "7d", 4, None), ("b", "partial", "30d", 0, None), ("c", "skipped", "30d", 0, "not_indexed"), ("e", "success", "30d", 4, None)], "keyword string, status string, requested_period string, succeeded_tabs int, skip_reason string")
    asked = spark.createDataFrame([(x,) for x in "abcde"], "keyword string")
    got = {r.keyword: (r.state, r.reason) for r in planning.readiness(asked, status, "30d").collect()}
    assert got == {"a": ("collect", "wrong_period"), "b": ("collect", "no_tabs"), "c": ("terminal", ""), "d": ("collect", "missing"), "e": ("usable", "")}
    brief = spark.createDataFrame([("t", "A, b", "B，c", "C")], "task string, first string, second string, no string")
    assert [r.keyword for r in planning.keyword_plan(brief, [("first", "x", True), ("second", "y", False)], "task", "no").orderBy("position").collect()] == ["A", "b"]


def test_sql_guard(spark):
    tables = {"brands": spark.createDataFrame([(1, "x;y -- z")], "id int, name string"), "posts": spark.createDataFrame([(1,)], "brand_id int")}
    good = ["SELECT * FROM brands", "```sql\nselect b.name from brands b join posts p on b.id = p.brand_id;\n```", "SELECT name FROM brands WHERE name = 'a;b -- from x'", "SELECT 1 UNION SELECT id FROM brands", "SELECT EXTRACT(YEAR FROM current_date()) AS y FROM brands"]
    bad = ["", "DELETE FROM brands", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT * FROM secrets", "SELECT * FROM brands, secrets", "SELECT * FROM other.brands", "SELECT REPLACE(name, 'a', 'b') FROM brands", "SELECT (", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM brands", "SELECT id FROM brands WHERE id IN (SELECT id FROM secrets)", "SELECT TRANSFORM(name) USING 'cat' AS x FROM brands", "SELECT * FROM range(3)", "SELECT * FROM parquet.`/etc`", "SELECT (SELECT max(java_method('a', 'b')) FROM brands)"]
    good += ["SELECT a.id FROM (SELECT id FROM brands) a WHERE EXISTS (SELECT 1 FROM posts WHERE brand_id = a.id)", "SELECT id, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM brands ORDER BY id LIMIT 3 OFFSET 0", "SELECT name, count(*) FROM brands GROUP BY name HAVING count(*) > 0"]
    for sql in good:
        sqlguard.run(spark, sql, tables).collect()
    for sql in bad:
        with pytest.raises(sqlguard.RejectedSql):
            sqlguard.checked(spark, sql, set(tables))
    found = sqlguard.envelope(spark, "q", good[0], tables)
    assert found["row_count"] == 1 and found["rows"].first().row == '{"id":1,"name":"x;y -- z"}'


def test_rules(spark):
    row = ("rag", "answer", False, None, "q", None, [], None, "r")
    report = ("report", "generate_report", False, None, "q", rules.REPORT_SKILL, ["k"], "p", "r")
    index = ("douyin", "collect", False, None, "q", None, ["k"], "p", "r")
    valid = [row, report, index, (" RAG ", None, *row[2:]), ("clarify", "answer", True, "what?", None, None, [], None, "r"), ("douyin", "answer", False, None, "q", None, ["k"], None, "r"), (*row[:6], [" "], None, "r")]
    broken = {
        "route_unknown": ("x", *row[1:]), "flag_missing": (*row[:2], None, *row[3:]), "flag_mismatch": (*row[:2], True, *row[3:]), "reason_missing": (*row[:8], " "), "retrieval_query_missing": (*row[:4], " ", *row[5:]), "clarification_question_unwanted": (*row[:3], "?", *row[4:]),
        "skill_unknown": (*row[:5], "other", *row[6:]), "skill_mismatch": (*report[:5], None, *report[6:]), "action_unfit": ("rag", "collect", *row[2:]), "keywords_unwanted": (*row[:6], ["k"], *row[7:]), "brief_missing": (*index[:7], " ", "r"), "brief_unwanted": (*row[:7], "p", "r"),
        "index_without_input": ("douyin", "answer", False, None, "q", None, [], None, "r"), "clarification_question_missing": ("clarify", "answer", True, "", None, None, [], None, "r"), "retrieval_query_unwanted": ("clarify", "answer", True, "?", "q", None, [], None, "r"),
    }
    got = spark.createDataFrame([*valid, *broken.values()], rules.ROUTE_FIELDS).select(rules.route_violation(("known",)).alias("v")).collect()
    assert [r.v for r in got] == [None] * len(valid) + list(broken)
    checks = {None: (True, "Answer ", [" a ", "", "a"], [], " r "), "action_mismatch": (True, "web", [], [], "r"), "action_unknown": (False, "stop", [], [], "r"), "flag_missing": (None, "answer", [], [], "r"), "reason_missing": (False, "answer_insufficient", [], [], "")}
    rows = spark.createDataFrame(list(checks.values()), rules.CHECK_FIELDS).select(rules.sufficiency_violation().alias("v"), rules.normalised_check().alias("n")).collect()
    assert [r.v for r in rows] == list(checks)
    assert rows[0].n.answerable_aspects == ["a"] and not rows[0].n.used_fallback and rows[1].n.next_action == "answer_insufficient" and rows[1].n.used_fallback
    assert one(spark, lambda a, b: rules.tools_left(a, F.array(b)), "rag_and_web", "web_search") == ["search_knowledge_base"] and one(spark, lambda a: rules.tools_left(a, F.lit(None).cast("array<string>")), "none") == []
    assert one(spark, rules.fallback_route, "q", "e").retrieval_query == "q" and one(spark, rules.tool_query, "q", " ") == "q"
    assert one(spark, lambda a: rules.insufficient_reply(F.array(a), F.array().cast("array<string>"), "no", "has: ", "lacks: "), "x") == "no\nhas: x"
    assert one(spark, lambda o, a, b: rules.distinct_queries(o, F.array(a, b)), "Q one", "q two", "Q-Two!") is False
    evidence = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id long, rank int, source string")
    asked = spark.createDataFrame([(1, "q", "r"), (2, "q2", None)], "query_id long, original_query string, retrieval_query string")
    found = {r.query_id: r for r in rules.search_envelope(evidence, asked).collect()}
    assert [x.source for x in found[1].evidence] == ["a", "b"] and found[2].retrieval_query == "q2" and found[2].evidence is None


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "b.md").write_text("# B\n")
    assert [r.source for r in files.markdown(spark, str(tmp_path / "md")).collect()] == ["b.md"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.markdown(spark, str(tmp_path / "none"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert files.append_missing(rows, str(tmp_path / "cache"), ["k"]) == 2 and files.append_missing(rows, str(tmp_path / "cache"), ["k"]) == 0
    files.write_index(rows, str(tmp_path / "index"), {"model": "m"})
    assert files.read_index(spark, str(tmp_path / "index"), {"model": "m"}).count() == 2
    assert files.read_index(spark, str(tmp_path / "index"), {"model": "n"}) is None
    review = spark.createDataFrame([("## QH01-1\n- **decision:** `yes`\n- **notes:** a\n## QH02-1\n- **decision:** no\n",)], "text string")
    assert {r.key: r.fields["decision"] for r in files.review_fields(review).collect()} == {"QH01-1": "yes", "QH02-1": "no"}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 10:00:00", k, "view", 1.5, "{}") for k in range(9)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, events.windowed(rows).collect()))


def test_evaluation_records_and_errors(spark):
    text = "## Q1: what?\n### Rank 1\n- label: 2\n- reason: `yes`\n- preview: p\n### Rank 2\n- label: x\n## Q2: why?\n### Rank 1\n- label: 0\n"
    got = evaluation.manual_annotations(spark.createDataFrame([(text,)], "text string")).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.rank, r.label) for r in got] == [("Q1", 1, 2), ("Q1", 2, None), ("Q2", 1, 0)] and got[0].reason == "yes"
    specs, questions = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "q")], "k long, question string")
    with pytest.raises(Exception, match="no source question: 2"):
        evaluation.from_specs(specs, questions, "k").collect()
    tasks = spark.createDataFrame([("a",), ("b",)], "task string")
    assert planning.single_task(tasks.where("task = 'a'")).count() == 1
    with pytest.raises(Exception, match="exactly one task"):
        planning.single_task(tasks).collect()
    with pytest.raises(Exception, match="unknown period"):
        tasks.select(planning.effective_period(F.lit("9d"), F.lit(None), F.lit(False))).collect()
    assert one(spark, lambda x: planning.tab_period(x, F.lit("30d")), "correlation") == "7d"
    with pytest.raises(ValueError, match="blank"):
        bm25.checked_request("  ", 3)
    with pytest.raises(ValueError, match="at least one"):
        bm25.checked_request("q", 0)


def test_layout_blocks_and_dictionaries(spark):
    blocks = spark.createDataFrame([([("text", " a ", [1, 2, 3, 4]), ("table", "", None), ("Image", "b", None)],)], "b array<struct<label: string, text: string, bbox: array<int>>>")
    row = blocks.select(T.layout_markdown(F.col("b")).alias("m"), T.media_blocks(F.col("b")).alias("k")).first()
    assert row.m == "## Block 1 (text) bbox=1,2,3,4\n\na\n\n## Block 3 (Image)\n\nb" and [x.label for x in row.k] == ["table", "Image"]
    assert one(spark, lambda x: T.summary_after(x, "年龄"), "性别 x 年龄 18-24 多\n\n兴趣") == "18-24 多" and one(spark, lambda x: T.summary_after(x, "年龄"), "x") is None
    record = spark.createDataFrame([({"status": "success", "html": "x"}, "s.png"), ({"tab": "a"}, "")], "r map<string,string>, shot string")
    assert [r.c for r in record.select(T.compact_record(F.col("r"), F.col("shot")).alias("c")).collect()] == [{"status": "success", "full_screenshot": "s.png"}, {"tab": "a"}]
    money = spark.createDataFrame([(1, "2024-01-02")], "a int, d string").select(F.col("a").cast("decimal(10,2)"), F.col("d").cast("date"), F.lit(None).cast("string").alias("n"))
    assert money.select(T.json_row(money.schema).alias("j")).first().j == '{"a":1.0,"d":"2024-01-02","n":null}'
    terms = spark.createDataFrame([("北京大学",), ("大学",)], "term string")
    got = {r.term: (r.changed, r.whole) for r in lexicon.segmentation_changes(terms, {"北京": 5, "大学": 5}, {"北京": 5, "大学": 5, "北京大学": 50}).collect()}
    assert got == {"北京大学": (True, True), "大学": (False, True)}
    assert one(spark, T.stripped, " \u00a0 a  b \n ") == "a  b" and one(spark, T.cell, None) == ""


def test_catalogue_has_an_oracle_for_all_but_the_folds():
    assert "judge_agreement" in catalogue.QUERIES and evaluation_catalogue.query is catalogue.query
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"ascii_terms", "section_blocks", "semantic_chunks", "structure_chunks"}


def test_entry_works_without_the_optional_package(tmp_path):
    code = "import sys\nsys.modules['rillstone.llm'] = None\nimport __spark_entry__ as e\nassert 'bm25_topk' in e.queries() and not any(n.startswith('op1') for n in e.queries())"
    root = importlib.import_module("pathlib").Path(__file__).parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=100)


def test_last30_activity_looks_back_30_days(spark, monkeypatch):
    rows = spark.sql("SELECT explode(array(0, 10, 30, 31)) AS back").selectExpr("timestamp'2024-03-31 12:00:00' - make_dt_interval(back) AS ts", "'click' AS event_type", "1.5D AS value")
    monkeypatch.setattr(catalogue, "read", lambda s, folder, name: rows)
    assert [tuple(r) for r in catalogue.QUERIES["last30_activity"](spark, "").collect()] == [("click", 3, 4.5)]
