"""Further named queries: text records, evaluation sets, planning and lexicon phrases. Registered by import.

Every query reads whole tables; long texts are reported by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import bm25, chunking, evaluation, lexicon, metrics, planning, rules
from rillstone.plans.catalogue import COUNT_TOK, FIXED_SQL, STRIP, _asked, _gold, _sparse, bm25_sql, longs, query, r6, read

BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _docs(spark: SparkSession, sf_dir: str, text: Column, name: str = "text_sha256") -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias(name))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


# -- text ----------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) > 2600 THEN length(rtrim(substr(text, 1, 2600), ' ' || chr(9) || chr(10) || chr(13))) + 4 ELSE length(text) END AS n_chars FROM documents")
def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.length(T.trimmed(F.col("text"))).cast("long").alias("n_chars"))


@query("SELECT doc_id, sha256(nullif(trim(nfc_normalize(text), ' ' || chr(9) || chr(10) || chr(13)), '')) AS text_sha256 FROM documents")
def nfc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, T.nfc(F.col("text")))


@query(r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim(p_name), '[^\p{L}\p{N}\p{M}_-]+', '_', 'g'), '_'), ''), 'untitled') AS name FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.safe_name(F.col("p_name")).alias("name"))


@query(rf"""WITH t AS (SELECT doc_id, len({COUNT_TOK})::BIGINT AS tokens, len(regexp_extract_all(coalesce(text, ''), '[\x{{4e00}}-\x{{9fff}}]'))::BIGINT AS cjk, len(regexp_extract_all(coalesce(text, ''), '(?i)\[Image(?: omitted)?:\s*[^\]]+\]'))::BIGINT AS images FROM documents)
    SELECT doc_id, tokens, cjk, images, tokens >= 80 AND cjk >= 60 AND NOT (images >= 2 AND cjk < 120) AS useful FROM t""")
def useful_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.count_tokens(_text()))
    rows = read(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), T.cjk_count(_text()).alias("cjk"), T.image_count(_text()).alias("images"), T.worth_asking_about(_text(), n).alias("useful"))
    return longs(rows, "tokens", "cjk", "images")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity + l_tax WHEN 1 THEN l_quantity - l_tax WHEN 2 THEN l_quantity * l_tax ELSE l_quantity::DOUBLE / (l_tax + 1)::DOUBLE END::DOUBLE AS result FROM lineitem")
def calculator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("add", "subtract", "multiply", "divide"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    a, b = F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.calculate(op, a, F.when(op == "divide", b + 1).otherwise(b)).alias("result"))


@query("""WITH p AS (SELECT p_partkey, p_size AS a, p_size + p_partkey % 5 AS b FROM part), e AS (SELECT p_partkey, unnest(list_concat(range(a - 1, b), [p_partkey % 60 - 1])) AS page FROM p)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM e WHERE page BETWEEN 0 AND 39 GROUP BY 1""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("%d-%d, %d", "p_size", F.col("p_size") + F.col("p_partkey") % 5, F.col("p_partkey") % 60)
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.page_set(text, F.lit(40)).cast("array<string>"), ",").alias("pages"))
    return rows.where("pages <> ''")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x FROM lineitem)
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(y / 20, 0) * 20, x, l_linenumber) AS place FROM b""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as blocks of a page, at a height of their price."""
    from pyspark.sql import Window

    order = T.reading_order(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double"))
    rows = read(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order, "l_linenumber")))
    return longs(rows.select("l_orderkey", "l_linenumber", "place"), "place")


@query(rf"""WITH t AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents),
    j AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: regexp_replace(x, '{BLANK}+$', '')), chr(10)) AS t FROM t), s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^{BLANK}+|{BLANK}+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM j)
    SELECT doc_id, sha256(CASE WHEN t <> '' THEN t || chr(10) ELSE '' END) AS text_sha256 FROM s""")
def normalised_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, T.normalise_markdown(_text()))


@query(rf"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM conversations)
    SELECT conv_id, sha256(coalesce(string_agg('## ' || role || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '')) AS text_sha256 FROM t GROUP BY 1""")
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a conversation as parts under the headings of their roles."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("name"), m["text"].alias("text"))).alias("parts"))
    return rows.select("conv_id", F.sha2(T.parts_joined(F.col("parts")), 256).alias("text_sha256"))


@query(rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g'), '[A-Za-z0-9_./:%+-]+', ' ', 'g')) AS text_sha256 FROM documents")
def ideograph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, T.ideographs_only(_text()))


@query(r"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]|[A-Za-z]+|\d+(?:\.\d+)?%?'))::BIGINT AS tokens, sha256(array_to_string(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]|[A-Za-z]+|\d+(?:\.\d+)?%?'), ' ')) AS tokens_sha256 FROM x""")
def char_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.char_tokens(_text()).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(f"SELECT conv_id, turn, ceil(len({COUNT_TOK}) * 1.2::DOUBLE)::BIGINT AS tokens FROM conversations")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.context_tokens(_text()).cast("long").alias("tokens"))


@query(rf"""WITH t AS (SELECT doc_id, {COUNT_TOK} AS tokens FROM documents), w AS (SELECT doc_id, list_transform(range(0, greatest(len(tokens), 1), 100), lambda i: {STRIP.format("array_to_string(tokens[i + 1 : i + 100], '')")}) AS w FROM t)
    SELECT doc_id, len(list_filter(w, lambda x: x <> ''))::BIGINT AS windows, sha256(array_to_string(list_filter(w, lambda x: x <> ''), '|')) AS windows_sha256 FROM w""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.token_windows(T.count_tokens(_text()), 100).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("windows"), F.sha2(F.array_join("w", "|"), 256).alias("windows_sha256"))


@query("SELECT event_id, to_json(map {'k': json_extract_string(props, '$.k')})::VARCHAR AS record FROM events")
def compact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, of which the key k is wanted."""
    record = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", F.to_json(T.compact_record(record, keys=("k",))).alias("record"))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(T.time_text(F.max("ts")).alias("last_seen"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ~ ' || strftime(o_orderdate + INTERVAL 6 DAY, '%Y-%m-%d') AS periods FROM orders")
def index_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    start, end = day(F.col("o_orderdate")), day(F.date_add(F.col("o_orderdate").cast("date"), 6))
    page = F.concat(F.lit("页面 "), start, F.lit("  ~ "), end, F.lit(" 更多 "), start, F.lit(" ~ "), end)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.periods_text(page), "|").alias("periods"))


@query("SELECT p_partkey, '+' || p_size || '%' AS year_on_year, '-' || (p_partkey % 7) || '.5%' AS month_on_month, p_size || '万' AS average, p_size * 10000.0::DOUBLE AS average_value FROM part")
def index_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.format_string("同比 +%d%% ｜ 环比 -%d.5%% 平均值 %d万 同比 +%d%%｜环比 -%d.5%% 平均值 %d万", *[F.col("p_size"), F.col("p_partkey") % 7, F.col("p_size")] * 2)
    rows = read(spark, sf_dir, "part").select("p_partkey", F.inline(T.index_summaries(page)))
    return rows.withColumn("average_value", T.amount(F.col("average")))


@query("SELECT n_nationkey, row_number() OVER () * 0 + 1 AS rank, '广东' AS province, (n_nationkey + 1)::DOUBLE AS share_percent, 100.0::DOUBLE + n_nationkey AS tgi FROM nation")
def audience_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.format_string("省份\n1 广东 %d%% %d\n", F.col("n_nationkey") + 1, F.col("n_nationkey") + 100)
    return longs(read(spark, sf_dir, "nation").select("n_nationkey", F.inline(T.provinces(page))), "rank")


@query("SELECT n_nationkey, g.gender, g.share + n_nationkey AS share_percent, 100.0::DOUBLE AS tgi FROM nation, (VALUES ('男性', 10.5::DOUBLE), ('女性', 20.0::DOUBLE)) AS g(gender, share)")
def audience_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.format_string("男性\n占比 %d.5%% TGI 100\n女性 占比%d%% TGI100", F.col("n_nationkey") + 10, F.col("n_nationkey") + 20)
    return read(spark, sf_dir, "nation").select("n_nationkey", F.inline(T.genders(page)))


@query("SELECT p_partkey, replace(url_encode(p_name), '+', '%20') AS url FROM part")
def encoded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.percent_encoded(F.col("p_name")).alias("url"))


# -- chunks --------------------------------------------------------------------------------------


@query(f"WITH {FIXED_SQL} SELECT d.source, count(*) AS chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 2) AS avg_tokens FROM fixed f JOIN documents d ON d.doc_id = f.doc_id GROUP BY 1")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return chunking.statistics(chunking.fixed_chunks(docs).join(docs.select("doc_id", "source"), "doc_id"), ["source"])


# -- retrieval -----------------------------------------------------------------------------------


def _char_sql() -> str:
    tok = r"regexp_extract_all(lower(coalesce({}, '')), '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z]+|\d+(?:\.\d+)?%?')"
    return f"""WITH tok AS (SELECT doc_id, {tok.format("text")} AS tokens FROM documents), st AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(tokens)::DOUBLE), 1.0::DOUBLE) AS mean FROM tok),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest({tok.format("text")}) AS term FROM benchmark), post AS (SELECT doc_id, term, length, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(tokens)::DOUBLE AS length, unnest(tokens) AS term FROM tok) GROUP BY 1, 2, 3),
    dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY 1), sc AS (SELECT query_id, doc_id, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


@query(f"{_char_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3")
def bm25_char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison tokenizer in place of the production one."""
    found = bm25.topk(read(spark, sf_dir, "documents"), _asked(spark, sf_dir), 3, fill=False, tokens=T.char_tokens)
    return longs(found.select("query_id", "doc_id", "rank", r6("score")), "rank")


TOP3 = "h AS (SELECT s.query_id, s.doc_id, s.rank, d.text, d.source FROM sparse s JOIN documents d ON d.doc_id = s.doc_id WHERE rank <= 3)"


def _top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return _sparse(spark, sf_dir, 3).select("query_id", "doc_id", "rank").join(docs, "doc_id")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a query: its first ten words."""
    return _asked(spark, sf_dir).select("query_id", F.array_distinct(F.slice(F.split("text", " "), 1, 10)).alias("keywords"))


KEYS = "k AS (SELECT item_id AS query_id, list_distinct(string_split(text, ' ')[1:10]) AS words FROM benchmark)"
COVERED = "x AS (SELECT query_id, string_agg(coalesce(text, ''), chr(10) ORDER BY rank) AS t FROM h GROUP BY 1), c AS (SELECT k.query_id, len(list_filter(words, lambda w: contains(t, w)))::BIGINT AS found, len(words)::BIGINT AS total FROM k JOIN x USING (query_id))"


@query(f"WITH {bm25_sql()}, {TOP3}, {KEYS}, {COVERED} SELECT query_id, found, total, CASE WHEN total > 0 THEN round(found::DOUBLE / total, 3) ELSE 0 END AS coverage FROM c")
def top3_keyword_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.joined_coverage(_top3(spark, sf_dir), "query_id", "text", "rank", _words(spark, sf_dir))


@query(f"WITH {bm25_sql()}, {TOP3}, {KEYS}, {COVERED} SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, count(*) AS questions, round(sum(found)::DOUBLE / sum(total), 3) AS top3_rate FROM c GROUP BY 1")
def micro_keyword_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.joined_coverage(_top3(spark, sf_dir), "query_id", "text", "rank", _words(spark, sf_dir))
    return evaluation.micro_rates(rows.withColumn("model", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")), "model", {"top3_rate": ("found", "total")})


@query(f"WITH {bm25_sql()}, {TOP3} SELECT query_id, bool_or(contains(source, '1')) AS section_hit FROM h GROUP BY 1")
def section_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _top3(spark, sf_dir).groupBy("query_id").agg(F.collect_list("source").alias("results"))
    return rows.select("query_id", evaluation.section_hit(F.lit("1"), F.col("results")).alias("section_hit"))


@query(f"WITH {bm25_sql()}, {TOP3}, {KEYS}, {COVERED} SELECT c.query_id, h.doc_id AS top1_doc_id, c.found AS n_found, c.total - c.found AS n_missing FROM c JOIN h ON h.query_id = c.query_id AND h.rank = 1")
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.result_rows(_top3(spark, sf_dir), _words(spark, sf_dir))
    return rows.select("query_id", "top1_doc_id", F.size("found").cast("long").alias("n_found"), F.size("missing").cast("long").alias("n_missing"))


@query(f"""WITH {bm25_sql()}, e AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids FROM sparse WHERE rank <= 3 GROUP BY 1)
    SELECT query_id, text AS original_query, CASE WHEN item_id % 2 = 0 THEN text ELSE upper(text) END AS retrieval_query, ids FROM e JOIN benchmark ON item_id = query_id""")
def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).select("query_id", F.col("text").alias("original_query"), F.when(F.col("query_id") % 2 == 1, T.upper(F.col("text"))).alias("retrieval_query"))
    found = rules.search_envelope(_sparse(spark, sf_dir, 3).select("query_id", "rank", "doc_id"), asked)
    return found.select("query_id", "original_query", "retrieval_query", F.array_join(F.transform("evidence", lambda x: x["doc_id"].cast("string")), ",").alias("ids"))


@query(f"""WITH {bm25_sql()}, hits AS (SELECT s.query_id, s.rank, contains(d.text, b.text) AS gold FROM (SELECT * FROM sparse WHERE rank <= 10) s JOIN documents d ON d.doc_id = s.doc_id JOIN benchmark b ON b.item_id = s.query_id),
    g AS (SELECT query_id, min(CASE WHEN gold THEN rank END) AS gold_rank FROM hits GROUP BY 1), x AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS method, CASE WHEN query_id % 3 = 0 THEN 'a' ELSE 'b' END AS v, query_id::DOUBLE / 10 AS secs FROM g)
    SELECT method, coalesce(v, 'all') AS variant, count(*) AS questions, round(avg((gold_rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0.0)), 6) AS mrr, round(avg((coalesce(gold_rank, 0) = 1)::INT), 6) AS gold_top1, round(avg(secs), 6) AS mean_seconds FROM x GROUP BY GROUPING SETS ((method), (method, v))""")
def two_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gold(spark, sf_dir).withColumn("method", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")).withColumn("v", F.when(F.col("query_id") % 3 == 0, "a").otherwise("b")).withColumn("secs", F.col("query_id") / 10.0)
    return evaluation.two_level_metrics(rows, "method", "v", "secs")


# -- labels --------------------------------------------------------------------------------------

JUDGED = "j AS (SELECT l.doc_id, d.source, l.quality + l.toxic AS first, l.quality * 2 AS second FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges' labels of 0 to 2, made from the label columns."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", "source", (F.col("quality") + F.col("toxic")).cast("int").alias("first"), (F.col("quality") * 2).cast("int").alias("second"))


AGREED = f"""WITH {JUDGED}, g AS (SELECT source, count(*) AS items, sum((first = second)::INT)::BIGINT AS agree, round(avg((first >= 1)::INT), 4) AS first_loose, round(avg((first = 2)::INT), 4) AS first_strict, round(avg((second >= 1)::INT), 4) AS second_loose, round(avg((second = 2)::INT), 4) AS second_strict FROM j GROUP BY 1)"""


@query(f"{AGREED} SELECT * FROM g")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement(_judged(spark, sf_dir), "first", "second", "source")[0]


@query(f"{AGREED} SELECT sum(items)::BIGINT AS items, round(sum(agree)::DOUBLE / sum(items), 4) AS agreement, round(avg(first_loose), 4) AS first_loose, round(avg(first_strict), 4) AS first_strict, round(avg(second_loose), 4) AS second_loose, round(avg(second_strict), 4) AS second_strict FROM g")
def judge_agreement_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement(_judged(spark, sf_dir), "first", "second", "source")[1]


@query("""WITH c AS (SELECT x, count(*) FILTER (quality = x AND toxic = x)::DOUBLE AS tp, count(*) FILTER (toxic = x)::DOUBLE AS said, count(*) FILTER (quality = x)::DOUBLE AS is_ FROM labels, (SELECT unnest([0, 1]) AS x) GROUP BY x),
    m AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN is_ > 0 THEN tp / is_ ELSE 0 END AS r FROM c), f AS (SELECT round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f, is_ FROM m)
    SELECT (SELECT count(*) FROM labels) AS questions, (SELECT count(*) FROM labels WHERE quality = toxic) AS correct, round((SELECT count(*) FROM labels WHERE quality = toxic)::DOUBLE / (SELECT count(*) FROM labels), 6) AS accuracy, round(avg(r), 6) AS balanced_accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(max(is_) / sum(is_), 6) AS majority_baseline FROM f""")
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.classification(read(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("SELECT 'quality' AS dimension, quality::VARCHAR AS score, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM labels GROUP BY 2")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.distribution(read(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"WITH {JUDGED} SELECT source, count(*) AS n, round(avg((first = 0)::INT), 6) AS irrelevant, round(avg((first >= 1)::INT), 6) AS relevant, round(avg((first = 2)::INT), 6) AS direct FROM j GROUP BY 1")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.label_rates(_judged(spark, sf_dir), "source", "first")


@query("SELECT lang, count(*) FILTER (source = 'web') AS web, count(*) FILTER (source = 'wiki') AS wiki FROM documents GROUP BY 1")
def pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    found = evaluation.pivoted(rows, "lang", "source", ["web", "wiki"], "n")
    return found.select("lang", F.coalesce("web", F.lit(0)).alias("web"), F.coalesce("wiki", F.lit(0)).alias("wiki"))


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def judge_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.work_list(read(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'cache' END AS label_source, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return evaluation.with_labels(read(spark, sf_dir, "documents").select("doc_id"), cache, ["doc_id"])[1]


@query("SELECT e.vec_id AS doc_id, CASE WHEN d.doc_id IS NULL OR d.text IS NULL THEN 'preview' ELSE 'chunk' END AS evidence_source, sha256(coalesce(d.text, e.label::VARCHAR)) AS text_sha256 FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 3")
def full_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id"), (F.col("vec_id") * 3).alias("doc_id"), F.col("label").cast("string").alias("preview"))
    found = evaluation.with_full_evidence(rows, read(spark, sf_dir, "documents"), "doc_id")
    return found.select(F.col("vec_id").alias("doc_id"), "evidence_source", F.sha2("evidence", 256).alias("text_sha256"))


@query("SELECT doc_id AS id, 'right' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'left' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.key_differences(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id")


QUESTIONS = "q AS (SELECT doc_id AS query_id, md5(coalesce(text, '')) AS user_query, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'c' END AS canonical_query, CASE doc_id % 4 WHEN 0 THEN 'clear' WHEN 1 THEN 'expandable' WHEN 2 THEN 'ambiguous' ELSE 'other' END AS route, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END AS gold FROM documents)"


@query(f"""WITH {QUESTIONS} SELECT query_id, 'invalid_route' AS problem FROM q WHERE route = 'other' UNION ALL SELECT query_id, 'empty_canonical_query' FROM q WHERE trim(canonical_query) = ''
    UNION ALL SELECT query_id, 'empty_must_preserve' FROM q WHERE query_id % 7 = 0 UNION ALL SELECT query_id, 'ambiguous_with_gold' FROM q WHERE route = 'ambiguous' AND gold IS NOT NULL UNION ALL SELECT query_id, 'missing_clarifying_question' FROM q WHERE route = 'ambiguous'
    UNION ALL SELECT query_id, 'missing_slots' FROM q WHERE route = 'ambiguous' UNION ALL SELECT query_id, 'missing_gold' FROM q WHERE route <> 'ambiguous' AND gold IS NULL
    UNION ALL SELECT query_id, 'duplicate_user_query' FROM (SELECT query_id, count(*) OVER (PARTITION BY user_query) AS n FROM q) WHERE n > 1""")
def question_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evaluation questions with planted faults."""
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    rows = read(spark, sf_dir, "documents").select(
        k.alias("query_id"), F.md5(_text()).alias("user_query"), F.when(k % 11 == 0, " ").otherwise("c").alias("canonical_query"), F.when(k % 7 == 0, none).otherwise(F.array(F.lit("x"))).alias("must_preserve"),
        F.when(k % 4 == 0, "clear").when(k % 4 == 1, "expandable").when(k % 4 == 2, "ambiguous").otherwise("other").alias("expected_route"), F.when(k % 5 != 0, k).alias("relevant_chunk_id"), F.lit("").alias("expected_clarifying_question"), none.alias("clarification_slots"),
    )
    return evaluation.question_problems(rows)


DECIDED = "d AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'undecided' END AS state FROM documents)"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 == 0, " Yes").when(F.col("doc_id") % 3 == 1, "no").otherwise("later")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", said.alias("decision"), F.col("source").alias("expected"))
    return evaluation.decided(rows, "decision", "expected")


@query(f"WITH {DECIDED} SELECT d.doc_id, state, CASE WHEN state = 'accepted' THEN x.source END AS expected FROM d JOIN documents x ON x.doc_id = d.doc_id")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("doc_id", "state", "expected")


@query(f"WITH {DECIDED}, c AS (SELECT lang, count(*) AS n FROM d WHERE state = 'accepted' GROUP BY 1) SELECT sum(n)::BIGINT AS accepted, min(n) AS smallest_class, min(n) >= 8 AS ready FROM c")
def review_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ready(_decided(spark, sf_dir), "lang")


@query("""SELECT item_id || '-' || r.route AS variant_id, r.route AS expected_route, CASE r.route WHEN 'ambiguous' THEN 'clarify' ELSE 'retrieve' END AS expected_action, CASE WHEN r.route = 'ambiguous' AND item_id % 2 = 0 THEN 'what?' ELSE text END AS query FROM benchmark, (VALUES ('clear'), ('expandable'), ('ambiguous')) AS r(route)""")
def question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark")
    other = rows.where("item_id % 2 = 0").select(F.concat(F.col("item_id").cast("string"), F.lit("-ambiguous")).alias("variant_id"), F.lit("what?").alias("query"))
    return evaluation.variants(rows, "item_id", "text", other).select("variant_id", "expected_route", "expected_action", "query")


@query("SELECT doc_id, printf('Q%03d', row_number() OVER (ORDER BY doc_id)) AS evaluation_id FROM documents")
def numbered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.numbered(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "evaluation_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_full_match(CASE WHEN doc_id % 2 = 0 THEN 'QH' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-1' ELSE 'X' || doc_id END, 'QH\d{2}-[12]') AND doc_id % 3 <> 0")
def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(k % 2 == 0, F.concat(F.lit("QH"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-1"))).otherwise(F.concat(F.lit("X"), k.cast("string"))).alias("id"), F.when(k % 3 == 0, "clarify").otherwise("retrieve").alias("action"))
    return rows.where(evaluation.is_evaluation_row("id", "action")).select("doc_id")


@query("SELECT doc_id, CASE WHEN quality + toxic = 0 OR quality = 0 THEN 'remove' WHEN quality + toxic = 2 AND quality * 2 = 2 THEN 'keep' ELSE 'review' END AS verdict FROM labels")
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return read(spark, sf_dir, "labels").select("doc_id", metrics.verdict(q + t, q * 2, q).alias("verdict"))


# -- rules and planning --------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN TRUE WHEN 'assistant' THEN FALSE END AS sufficient, CASE turn % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'web' WHEN 2 THEN 'answer_insufficient' ELSE 'stop' END AS act, coalesce(text, '') AS reason FROM conversations)
    SELECT conv_id, turn, CASE WHEN sufficient IS NULL THEN 'flag_missing' WHEN act = 'stop' THEN 'action_unknown' WHEN sufficient <> (act = 'answer') THEN 'action_mismatch' WHEN trim(reason) = '' THEN 'reason_missing' END AS violation FROM c""")
def sufficiency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False).alias("sufficient"), F.when(F.col("turn") % 4 == 0, "answer").when(F.col("turn") % 4 == 1, "web").when(F.col("turn") % 4 == 2, "answer_insufficient").otherwise("stop").alias("next_action"), _text().alias("reason"))
    return rows.select("conv_id", "turn", rules.sufficiency_violation().alias("violation"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'search_knowledge_base' WHEN 1 THEN 'web_search' WHEN 2 THEN 'search_knowledge_base' ELSE '' END AS tools FROM nation""")
def route_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.element_at(F.array(*map(F.lit, ("rag", "web", "rag_and_web", "report"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    done = F.when(F.col("n_nationkey") % 4 == 2, F.array(F.lit("web_search")))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(rules.tools_left(route, done), ",").alias("tools"))


@query("""WITH k AS (SELECT p_partkey AS task_name, 0 AS rule, p_brand AS keyword, '品牌' AS keyword_type, '品牌名称' AS source_field, 'yes' AS required, 'yes' AS approved, 1 AS priority FROM part UNION ALL SELECT p_partkey, 1, p_name, '商品', '商品名称', 'yes', 'yes', 1 FROM part UNION ALL SELECT p_partkey, 2, p_type, '上级品类', '上级品类', 'no', '', 2 FROM part),
    f AS (SELECT *, row_number() OVER (PARTITION BY task_name, lower(keyword) ORDER BY rule) AS n FROM k WHERE trim(keyword) <> '') SELECT task_name, keyword, keyword_type, source_field, required, approved, priority::BIGINT AS priority, row_number() OVER (PARTITION BY task_name ORDER BY rule) AS position FROM f WHERE n = 1""")
def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    briefs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_name"), F.col("p_brand").alias("brand_name"), F.col("p_name").alias("product_name"), F.col("p_type").alias("parent_category"))
    found = planning.keyword_candidates(briefs)
    return longs(found.select("task_name", "keyword", "keyword_type", "source_field", "required", "approved", "priority", "position"), "priority", "position")


@query("SELECT o_custkey AS task, string_agg(k, ',' ORDER BY first) AS keywords FROM (SELECT o_custkey, o_orderpriority AS k, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2) GROUP BY 1")
def approved_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("keyword"), F.when(F.col("o_orderkey") % 2 == 0, " YES").otherwise("no").alias("approved"))))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(items.alias("items"))
    return rows.select("task", F.array_join(planning.approved_keywords(F.col("items")), ",").alias("keywords")).where("keywords <> ''")


@query("""WITH e AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), s AS (SELECT user_id, count(*) FILTER (v >= 50)::BIGINT AS good, count(*)::BIGINT AS n FROM e GROUP BY 1), k AS (SELECT DISTINCT c_custkey AS keyword FROM customer)
    SELECT k.keyword::VARCHAR AS keyword, CASE WHEN s.user_id IS NULL THEN 'missing' WHEN good = n THEN 'success' WHEN good > 0 THEN 'partial' ELSE 'failed' END AS status, CASE WHEN s.user_id IS NULL THEN '没有采集结果' WHEN good = 0 THEN '采集未成功' END AS reason, CASE WHEN good > 0 THEN good END AS tabs, CASE WHEN good > 0 THEN n - good END AS failed_tabs FROM k LEFT JOIN s ON s.user_id = k.keyword""")
def collected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keywords; a user's last event of each type is a tab that succeeded from a value of 50 on."""
    last = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    tab = F.create_map(F.lit("status"), F.when(F.col("v") >= 50, "success").otherwise("failed"))
    rows = last.groupBy(F.col("user_id").cast("string").alias("keyword")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", tab))).alias("tabs"), F.count_if(F.col("v") >= 50).alias("good"), F.count(F.lit(1)).alias("n"))
    status = rows.select("keyword", F.when(F.col("good") == F.col("n"), "success").when(F.col("good") > 0, "partial").otherwise("failed").alias("status"), F.lit("").alias("reason"), "tabs")
    found = planning.collected_evidence(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("keyword")), status)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(c)
    return found.select("keyword", "status", "reason", size("tabs"), size("failed_tabs"))


@query("SELECT user_id AS keyword, CASE WHEN count(*) FILTER (value >= 50) = 3 THEN 'success' ELSE 'partial' END AS status, count(*) FILTER (value >= 50) AS succeeded FROM events GROUP BY 1")
def keyword_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.keyword_rollup(read(spark, sf_dir, "events").select(F.col("user_id").alias("keyword"), F.when(F.col("value") >= 50, "success").otherwise("failed").alias("status")), 3)


@query("SELECT n_regionkey, CASE WHEN bool_and(n_nationkey % 3 = 0) THEN 'success' WHEN bool_and(n_nationkey % 3 <> 2) THEN 'completed_with_skips' ELSE 'partial' END AS status, count(*) FILTER (n_nationkey % 3 = 0) AS usable, count(*) AS keywords FROM nation GROUP BY 1")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    return planning.rollup(read(spark, sf_dir, "nation").withColumn("state", F.when(k == 0, "usable").when(k == 1, "terminal").otherwise("collect")), ["n_regionkey"])


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreviewed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.unreviewed(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '7d' WHEN p_size % 3 = 1 THEN '30d' ELSE '6m' END AS period FROM part")
def effective_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    return read(spark, sf_dir, "part").select("p_partkey", planning.effective_period(F.when(k == 0, "7d"), F.when(k == 2, "6m"), k == 2).alias("period"))


@query("SELECT p_partkey, array_to_string(list_distinct([p_name, p_name || ' trend', p_name || ' user']), '|') IS NOT NULL AS filled, len(list_distinct([p_name, p_name || ' trend', p_name || ' user']))::BIGINT AS n FROM part")
def report_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planning.report_queries(F.array("p_name", F.lit(" "), "p_name"), F.col("p_name"), ("%s trend", "%s user"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "|").isNotNull().alias("filled"), F.size(found).cast("long").alias("n"))


@query("SELECT event_id, user_id, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), FALSE) AS stable FROM events")
def stable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.stable(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "stable")


@query("SELECT p_partkey, array_to_string(list_distinct(list_concat(range(0, p_size * 10 + 1, 120), [p_size * 10])), ',') IS NOT NULL AS planned, len(list_distinct(list_concat(range(0, p_size * 10 + 1, 120), [p_size * 10])))::BIGINT AS captures FROM part")
def scroll_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planning.scroll_offsets((F.col("p_size") * 10).cast("int"), 120)
    return read(spark, sf_dir, "part").select("p_partkey", found.isNotNull().alias("planned"), F.size(found).cast("long").alias("captures"))


# -- lexicon -------------------------------------------------------------------------------------


@query(r"""WITH v AS (SELECT p_name AS value, 'document_title' AS source, p_brand AS document FROM part UNION ALL SELECT p_type, 'section', p_brand FROM part), w AS (SELECT source, document, unnest(regexp_extract_all(regexp_replace(regexp_replace(value, '\d{4}年?', ' ', 'g'), '[*_#]+', ' ', 'g'), '[A-Za-z]{2,}')) AS term FROM v)
    SELECT term, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(DISTINCT document) AS documents FROM w WHERE length(term) <= 12 GROUP BY 1""")
def metadata_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    titles = part.select(F.col("p_name").alias("value"), F.lit("document_title").alias("source"), F.col("p_brand").alias("document")).unionByName(part.select(F.col("p_type").alias("value"), F.lit("section").alias("source"), F.col("p_brand").alias("document")))
    return lexicon.metadata_phrases(titles, lexicon.LATIN_PHRASE).select("term", F.array_join("sources", ",").alias("sources"), "documents")


@query("SELECT term, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM (SELECT lower(p_brand) AS term, 'brand' AS source FROM part UNION ALL SELECT lower(p_type), 'type' FROM part UNION ALL SELECT lower(p_type), 'section' FROM part) GROUP BY 1")
def merged_term_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    one = lambda column, name: part.select(F.lower(column).alias("term"), F.lit(name).alias("source"))
    return lexicon.merged_sources(one("p_brand", "brand"), one("p_type", "type"), one("p_type", "section")).select("term", F.array_join("sources", ",").alias("sources"))


@query("""WITH r AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{2,}')) AS run FROM part) GROUP BY 1), p AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS pos FROM r), g AS (SELECT substr(run, pos, len) AS term, n FROM (SELECT run, n, pos, unnest(range(1, least(8, length(run) - pos + 1) + 1)) AS len FROM p)),
    c AS (SELECT term, sum(n)::BIGINT AS frequency FROM g WHERE length(term) >= 2 GROUP BY 1) SELECT term, frequency, frequency + CASE WHEN length(term) BETWEEN 3 AND 6 THEN 5 ELSE 0 END + 60 AS score FROM c WHERE frequency >= 2 AND length(replace(term, substr(term, 1, 1), '')) > 0 ORDER BY score DESC, term LIMIT 220""")
def simple_lexicon_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text"))
    scored = lexicon.simple_grams(docs).withColumn("score", lexicon.simple_score(F.col("term"), F.array(F.lit("expected_section")), F.col("frequency")))
    return scored.orderBy(F.desc("score"), "term").limit(220).select("term", "frequency", "score")
