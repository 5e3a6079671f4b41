"""Queries for text, identity and graph operators."""

import uuid

from pyspark.sql import functions as F

from bourse.operators import identity as idn
from bourse.operators import search
from bourse.operators import text as tx
from bourse.plans.registry import query
from bourse.session import checkpoint_folder

NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9&]+', ' ', 'g'))"
ALIASES = f"""
, al AS (SELECT 'B' || item_id AS symbol, list_extract(w, 1) || ' ' || list_extract(w, 2) AS alias FROM (SELECT item_id, string_split({NORM.format(x='text')}, ' ') AS w FROM benchmark)
  UNION SELECT 'W' || item_id, list_extract(w, 3) FROM (SELECT item_id, string_split({NORM.format(x='text')}, ' ') AS w FROM benchmark))"""


def aliases(t):
    words = t.benchmark.select("item_id", F.split(tx.norm("text"), " ").alias("w"))
    pair = words.select(F.concat(F.lit("B"), "item_id").alias("symbol"), F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("alias"))
    return pair.union(words.select(F.concat(F.lit("W"), "item_id"), F.col("w")[2])).distinct()


@query("T1_tag_entities", sql=f"""{ALIASES}
, d AS (SELECT doc_id, ' ' || {NORM.format(x='text')} || ' ' AS t FROM documents), h AS (SELECT doc_id, symbol, max(length(alias)) AS len FROM d JOIN al ON contains(t, ' ' || alias || ' ') GROUP BY 1, 2)
SELECT doc_id, symbol, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, symbol) AS rank FROM h) WHERE rank <= 5""")
def _(t):
    return tx.tag_entities(t.documents.select("doc_id", "text"), aliases(t))


@query("T2_build_alias_index", sql="""
, n AS (SELECT 'P' || p_partkey AS symbol, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Ltd.' WHEN p_partkey % 3 = 1 THEN ' (East) Limited' ELSE '' END AS name FROM part),
b AS (SELECT symbol, name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\(.*?\\)', ' ', 'g'), '[.,]', ' ', 'g'), '(?i)\\b(limited|ltd|private|pvt|corporation|corp|incorporated|inc|company|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM n),
c AS (SELECT *, count(*) OVER (PARTITION BY bare) AS owners FROM b WHERE length(bare) >= 4)
SELECT DISTINCT symbol, trim(regexp_replace(lower(CASE WHEN owners > 1 THEN regexp_replace(name, '(?i)\\b(limited|ltd|private|pvt|corporation|corp|incorporated|inc|company|the)\\b', ' ', 'g') ELSE bare END), '[^a-z0-9&]+', ' ', 'g')) AS alias FROM c""")
def _(t):
    suffix = F.when(F.col("p_partkey") % 3 == 0, " Ltd.").when(F.col("p_partkey") % 3 == 1, " (East) Limited").otherwise("")
    return tx.build_alias_index(t.part.select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.concat("p_name", suffix).alias("name")), generic=["ring"])


def contains_sql(words):
    return " + ".join(f"CASE WHEN contains(x, '{w}') THEN 1 ELSE 0 END" for w in words)


@query("T3_keyword_scores", doubles="sentiment_score", sql=f"""
, d AS (SELECT doc_id, lower(text) AS x FROM documents), h AS (SELECT doc_id, x, {contains_sql(tx.BULLISH + ['that', 'aux'])} AS bu, {contains_sql(tx.BEARISH + ['wh', 'ich'])} AS be, ({contains_sql(tx.HIGH_IMPACT + ['tiontion'])}) > 0 AS hi, {contains_sql(['the', 'and'])} AS c1, {contains_sql(['aux', 'ion'])} AS c2 FROM d),
s AS (SELECT *, CASE WHEN bu + be = 0 THEN 0.0 ELSE (bu - be) / (bu + be) END AS sc FROM h)
SELECT doc_id, bu AS bullish_hits, be AS bearish_hits, sc AS sentiment_score, CASE WHEN sc > 0.15 THEN 'BULLISH' WHEN sc < -0.15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment, CASE WHEN hi OR abs(sc) > 0.6 THEN 'HIGH' WHEN abs(sc) > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS impact,
  CASE {" ".join(f"WHEN contains(x, '{k}') THEN '{v}'" for k, v in tx.SECTORS.items())} END AS sector, CASE WHEN c1 + c2 = 0 THEN 'GENERAL' WHEN c1 >= c2 THEN 'ENGLISH' ELSE 'FRENCH' END AS category FROM s""")
def _(t):
    out = tx.keyword_scores(t.documents.select("doc_id", "text"), bullish=tx.BULLISH + ["that", "aux"], bearish=tx.BEARISH + ["wh", "ich"], high=tx.HIGH_IMPACT + ["tiontion"],
                            categories={"ENGLISH": ["the", "and"], "FRENCH": ["aux", "ion"]})
    return out.drop("text")


RULES = [(r"\bsteel\b|ring", "bullish", "momentum", "swing"), (r"widget.*economy", "bearish", "risk", "intraday"), (r"small|large", "bullish", "value", "long")]


@query("T4_rule_classify", sql="""
, n AS (SELECT p_partkey, lower(p_name || ' ' || p_type || CASE WHEN p_partkey % 7 = 0 THEN ' bullish bearish' ELSE '' END) AS x FROM part),
c AS (SELECT p_partkey, CASE WHEN contains(x, 'bullish') AND contains(x, 'bearish') THEN 0 WHEN regexp_matches(x, '\\bsteel\\b|ring') THEN 1 WHEN regexp_matches(x, 'widget.*economy') THEN 2 WHEN regexp_matches(x, 'small|large') THEN 3 ELSE 0 END AS k FROM n)
SELECT p_partkey, CASE k WHEN 1 THEN 'bullish' WHEN 2 THEN 'bearish' WHEN 3 THEN 'bullish' ELSE 'neutral' END AS bias, CASE k WHEN 1 THEN 'momentum' WHEN 2 THEN 'risk' WHEN 3 THEN 'value' ELSE 'unresolved' END AS category, CASE k WHEN 2 THEN 'intraday' WHEN 3 THEN 'long' ELSE 'swing' END AS horizon FROM c""")
def _(t):
    name = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_partkey") % 7 == 0, " bullish bearish").otherwise(""))
    return tx.rule_classify(t.part.select("p_partkey", name.alias("name")), "name", RULES).drop("name")


@query("T5_concept_tags", sql="""
, n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_brand || ' Above' || p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9])', '\\1 \\2', 'g')), '[^a-z0-9%+. -]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM part)
SELECT p_partkey, normalized, array_to_string(list_filter([CASE WHEN regexp_matches(normalized, 'ring') THEN 'shape:ring' END, CASE WHEN regexp_matches(normalized, 'red|blue|green') THEN 'colour:coloured' END, CASE WHEN regexp_matches(normalized, 'brand 1') THEN 'maker:first' END], lambda t: t IS NOT NULL), ',') AS tags,
  CASE WHEN NOT regexp_matches(normalized, 'bearish|below|low') THEN 'bullish' END AS polarity FROM n""")
def _(t):
    name = F.concat("p_brand", F.lit(" Above"), "p_name")
    return tx.concept_tags(t.part.select("p_partkey", name.alias("name")), "name", [("ring", "shape", "ring"), ("coloured", "colour", "red|blue|green"), ("first", "maker", "brand 1")]).drop("name")


@query("T6_dedupe_membership", sql="""
, m AS (SELECT 'S' || (p_partkey % 40) AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'ET' ELSE 'et' END AS source, p_partkey AS screener_id, p_name || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END AS title FROM part)
SELECT symbol, lower(source) AS source, min(screener_id) AS screener_id, arg_min(title, screener_id) AS title FROM m GROUP BY symbol, lower(source), trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))""")
def _(t):
    k = F.col("p_partkey")
    return tx.dedupe_membership(t.part.select(F.concat(F.lit("S"), k % 40).alias("symbol"), F.when(k % 2 == 0, "ET").otherwise("et").alias("source"), k.alias("screener_id"), F.concat("p_name", F.when(k % 3 == 0, "!").otherwise("")).alias("title")))


def strip_sql(x):
    return f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g'))"


@query("T7_strip_html_feed", sql=f"""
, e AS (SELECT page_id, html, regexp_extract(html, '(?is)<title>\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*</title>', 1) AS c, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS p FROM pages)
SELECT page_id, {strip_sql("CASE WHEN c <> '' THEN c ELSE p END")} AS title, md5({strip_sql('html')}) AS body FROM e""")
def _(t):
    return t.pages.select("page_id", tx.feed_field("html", "title").alias("title"), F.md5(tx.strip_html("html")).alias("body"))


def news(t):
    d = F.col("doc_id")
    return t.documents.select("doc_id", F.concat(F.lit("N"), d % 12).alias("symbol"), F.date_add(F.lit("2024-01-01"), (d % 30).cast("int")).alias("published"), F.when(d % 5 == 0, F.date_add(F.lit("2024-01-01"), (d % 30 + 2).cast("int"))).alias("fetched"),
                              ((d % 7) / 3.0 - 1).alias("score"), F.when(d % 4 == 0, "HIGH").otherwise("LOW").alias("impact"), "source", "lang", "text")


NEWS = """, nw AS (SELECT doc_id, 'N' || (doc_id % 12) AS symbol, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS published, CASE WHEN doc_id % 5 = 0 THEN DATE '2024-01-01' + CAST(doc_id % 30 + 2 AS INTEGER) END AS fetched, (doc_id % 7) / 3.0 - 1 AS score,
  CASE WHEN doc_id % 4 = 0 THEN 'HIGH' ELSE 'LOW' END AS impact, source, lang, text FROM documents), gd AS (SELECT DISTINCT symbol, published AS date FROM nw)"""


@query("T8_news_features", doubles="sentiment_3d attention", sql=NEWS + """
, k AS (SELECT *, greatest(published, coalesce(fetched, published)) AS known FROM nw),
a AS (SELECT g.symbol, g.date, avg(score) FILTER (WHERE known > g.date - 3) AS sentiment_3d, count(doc_id) FILTER (WHERE impact = 'HIGH' AND known > g.date - 5) AS high_impact_5d, count(doc_id) AS seen FROM gd g LEFT JOIN k ON k.symbol = g.symbol AND known <= g.date AND known > g.date - 7 GROUP BY 1, 2)
SELECT symbol, date, sentiment_3d, high_impact_5d, (rank() OVER (PARTITION BY date ORDER BY seen) + (count(*) OVER (PARTITION BY date, seen) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS attention FROM a""")
def _(t):
    items = news(t)
    return tx.news_features(items, items.select("symbol", F.col("published").alias("date")))


@query("T9_vector_topk", doubles="similarity", sql="""
, q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id < 10),
s AS (SELECT qid, vec_id, round(list_dot_product(e.embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 9) AS similarity FROM embeddings e, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    return search.vector_topk(t.embeddings.where("vec_id < 10").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), t.embeddings.select("vec_id", F.col("embedding").alias("v")), 5)


@query("T9_vector_topk_hundredth", doubles="similarity", sql="""
, q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id, round(list_dot_product(e.embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 9) AS similarity FROM embeddings e, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    """Every hundredth vector against all, so the queries grow with the table."""
    return search.vector_topk(t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), t.embeddings.select("vec_id", F.col("embedding").alias("v")), 5)


@query("T9_inverted_file", doubles="similarity")
def _(t):
    """Every hundredth vector through a stored inverted file: approximate, its recall is tested against the exact search."""
    vectors = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    folder = f"{checkpoint_folder(t.spark)}/vector-index-{uuid.uuid4().hex}"
    search.write_vector_index(vectors, folder, lists=64)
    return search.search_vector_index(t.spark, folder, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q")), 5, probes=16)


@query("T10_build_documents", sql="""
SELECT 'C' || c_custkey AS symbol, concat_ws('. ', c_name, 'Sector: ' || c_mktsegment, 'Orders: ' || n) AS text, '{"symbol":"C' || c_custkey || '","sector":"' || c_mktsegment || '"' || coalesce(',"orders":' || n, '') || '}' AS metadata FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    master = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    return tx.build_documents(master, t.orders.groupBy(F.concat(F.lit("C"), "o_custkey").alias("symbol")).agg(F.count("*").alias("orders")))


@query("T11_keyword_search", doubles="score", sql=f"""
, d AS (SELECT doc_id, list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: w <> '') AS w, list_filter(string_split({NORM.format(x='source')}, ' '), lambda w: w <> '') AS s FROM documents),
f AS (SELECT doc_id, greatest(len(w) + len(s), 1) AS l, len(list_filter(w, lambda x: x = 'that')) + 3.0 * len(list_filter(s, lambda x: x = 'that')) AS t0, len(list_filter(w, lambda x: x = 'with')) + 3.0 * len(list_filter(s, lambda x: x = 'with')) AS t1 FROM d),
a AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM f),
s AS (SELECT doc_id, round(CASE WHEN t0 > 0 THEN ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / al)) ELSE 0 END + CASE WHEN t1 > 0 THEN ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / al)) ELSE 0 END, 9) AS score FROM f, a)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def _(t):
    return tx.keyword_search(t.documents, ["that", "with"], {"text": 1.0, "source": 3.0}, "doc_id", 20)


@query("T11_keyword_index", doubles="score", sql=f"""
, d AS (SELECT doc_id, list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: w <> '') AS w, list_filter(string_split({NORM.format(x='source')}, ' '), lambda w: w <> '') AS s FROM documents),
l AS (SELECT *, greatest(len(w) + len(s), 1) AS l FROM d), a AS (SELECT count(*) AS n, avg(l) AS al FROM l),
p AS (SELECT doc_id, l, term, sum(f) AS tf FROM (SELECT doc_id, l, unnest(w) AS term, 1.0 AS f FROM l UNION ALL SELECT doc_id, l, unnest(s), 3.0 FROM l) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT doc_id AS qid, unnest(w[1 : 8]) AS term FROM d WHERE doc_id % 100 = 0),
s AS (SELECT qid, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 9) AS score FROM q JOIN df USING (term) JOIN p USING (term), a GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def _(t):
    """The first words of every hundredth document as a query over a stored inverted index."""
    folder = f"{checkpoint_folder(t.spark)}/text-index-{uuid.uuid4().hex}"
    search.write_text_index(t.documents, folder, {"text": 1.0, "source": 3.0}, "doc_id")
    words = F.filter(F.split(tx.norm("text"), " "), lambda w: w != "")
    asked = t.documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.explode(F.slice(words, 1, 8)).alias("term"))
    return search.search_text_index(t.spark, folder, asked, 10).withColumnRenamed("doc", "doc_id")


@query("T12_sentiment_fusion", uses="preds", doubles="tone_score conflict", sql="""
, m AS (SELECT doc_id, p AS ap, 1 - p AS an, p * p AS bp, (1 - p) * (1 - p) AS bn, 2 * p * (1 - p) AS bz FROM preds)
SELECT doc_id, CASE WHEN bp >= bn AND bp >= bz THEN 'positive' WHEN bn >= bz THEN 'negative' ELSE 'neutral' END AS tone_label, bp - bn AS tone_score, abs((ap - an) - (bp - bn)) / 2 AS conflict FROM m""")
def _(t):
    p = F.col("p")
    rows = t.preds.select("doc_id", p.alias("a_pos"), (1 - p).alias("a_neg"), (p * p).alias("b_pos"), ((1 - p) * (1 - p)).alias("b_neg"), (2 * p * (1 - p)).alias("b_neu"))
    return tx.sentiment_fusion(rows).select("doc_id", "tone_label", "tone_score", "conflict")


@query("T13_sentiment_snapshot", doubles="overall", sql=NEWS + """
, l AS (SELECT *, CASE WHEN score > 0.15 THEN 'BULLISH' WHEN score < -0.15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS s FROM nw),
g AS (SELECT published, lang AS sector, count(*) FILTER (WHERE s = 'BULLISH') AS bullish, count(*) FILTER (WHERE s = 'BEARISH') AS bearish, count(*) FILTER (WHERE s = 'NEUTRAL') AS neutral, count(*) FILTER (WHERE impact = 'HIGH') AS high_impact, avg(score) AS overall FROM l GROUP BY 1, 2)
SELECT *, CASE WHEN overall > 0.15 THEN 'BULLISH' WHEN overall < -0.15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM g""")
def _(t):
    s = F.col("score")
    rows = news(t).withColumns({"sentiment": F.when(s > 0.15, "BULLISH").when(s < -0.15, "BEARISH").otherwise("NEUTRAL"), "sector": F.col("lang")})
    return tx.sentiment_snapshot(rows, ["published", "sector"])


@query("T14_dedupe_items", sql="SELECT sha256(lang || '|' || text) AS content_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return tx.dedupe_items(t.documents.select("doc_id", "lang", "text"), ["lang", "text"], "doc_id").select("content_id", "doc_id")


EVENT_WORDS = [(r"[ ]that[ ].{0,30}[ ]the[ ]", 2.0, "ORDER_WIN"), (r"tiontion", -1.5, "MISS"), (r"[ ]aux[ ]", 0.8, "DIVIDEND")]


@query("T15_event_scores_rolling", doubles="event_score", sql=NEWS + """
, e AS (SELECT symbol, published AS date, 'ORDER_WIN' AS t, 2.0 AS s FROM nw WHERE regexp_matches(lower(text), '[ ]that[ ].{0,30}[ ]the[ ]') UNION ALL SELECT symbol, published, 'MISS', -1.5 FROM nw WHERE regexp_matches(lower(text), 'tiontion') UNION ALL SELECT symbol, published, 'DIVIDEND', 0.8 FROM nw WHERE regexp_matches(lower(text), '[ ]aux[ ]'))
SELECT g.symbol, g.date, coalesce(sum(s), 0) AS event_score, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS event_types FROM gd g LEFT JOIN e ON e.symbol = g.symbol AND e.date BETWEEN g.date - 30 AND g.date GROUP BY 1, 2""")
def _(t):
    items = news(t).withColumn("date", F.col("published"))
    return tx.event_scores(items, items, EVENT_WORDS)


ISIN_SQL = """
, m AS (SELECT s_suppkey, 'S' || s_suppkey AS symbol, 'INE' || lpad(CAST(s_suppkey * 7919 AS VARCHAR), 8, '0') AS stem FROM supplier),
d AS (SELECT s_suppkey, symbol, stem, k, list_reverse(list_transform(string_split(array_to_string(list_transform(string_split(stem || k, ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda c: CAST(c AS INTEGER))) AS n FROM m, range(0, 10) r(k)),
g AS (SELECT s_suppkey, symbol, stem, min(k) FILTER (WHERE list_sum(list_transform(n, lambda x, i: CASE WHEN i % 2 = 0 THEN (x * 2) // 10 + (x * 2) % 10 ELSE x END)) % 10 = 0) AS good FROM d GROUP BY 1, 2, 3),
im AS (SELECT symbol, stem || CASE WHEN s_suppkey % 3 = 0 THEN (good + 1) % 10 ELSE good END AS isin, s_suppkey % 3 = 0 AS broken FROM g)"""


def isin_master(t):
    """Codes with a right check digit, spoiled for every third supplier."""
    stem = F.concat(F.lit("INE"), F.lpad((F.col("s_suppkey") * 7919).cast("string"), 8, "0"))
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("symbol"), stem.alias("stem"))
    tries = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("code", F.concat("stem", F.col("k").cast("string")))
    good = tries.where(idn.valid_isin("code").isNotNull()).groupBy("symbol", "s_suppkey", "stem").agg(F.min("k").alias("good"))
    digit = F.when(F.col("s_suppkey") % 3 == 0, (F.col("good") + 1) % 10).otherwise(F.col("good"))
    return good.select("symbol", F.concat("stem", digit.cast("string")).alias("isin"), F.lit("NSE").alias("exchange"))


@query("I1_valid_isin", sql=ISIN_SQL + "SELECT symbol, CASE WHEN NOT broken THEN isin END AS isin FROM im")
def _(t):
    return isin_master(t).select("symbol", idn.valid_isin("isin").alias("isin"))


@query("I2_identity_keys", doubles="confidence", sql=ISIN_SQL + """
SELECT symbol, CASE WHEN broken THEN 'IN:PROVISIONAL:NSE:' || symbol ELSE 'IN:ISSUER:' || substr(isin, 1, 7) END AS issuer_key, CASE WHEN broken THEN 'IN:PROVISIONAL:NSE:' || symbol ELSE 'IN:ISIN:' || isin END AS instrument_key, CASE WHEN broken THEN 'provisional_symbol' ELSE 'isin' END AS basis, CASE WHEN broken THEN 0.35 ELSE 1.0 END AS confidence FROM im""")
def _(t):
    return idn.identity_keys(isin_master(t)).drop("isin", "exchange")


IDS = "(SELECT 'S' || s_suppkey AS symbol, 'alpha' AS provider, 'code' AS scheme, CAST(s_suppkey % 60 AS VARCHAR) AS value, 0.9 AS confidence FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'beta', 'name', s_name, 0.8 FROM supplier)"


def ids(t):
    rows = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), (F.col("s_suppkey") % 60).alias("a"), F.col("s_name").alias("b"))
    return idn.identifiers_long(rows, [("a", "alpha", "code", 0.9), ("b", "beta", "name", 0.8)])


@query("I3_identifiers_long", doubles="confidence", sql=f"SELECT * FROM {IDS}")
def _(t):
    return ids(t)


@query("I4_identifier_collisions", sql=f"SELECT provider, scheme, value, count(DISTINCT symbol) AS owners, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS candidates FROM {IDS} GROUP BY 1, 2, 3 HAVING count(DISTINCT symbol) > 1")
def _(t):
    return idn.identifier_collisions(ids(t))


@query("I5_resolve_identifiers", sql=f"""
, q AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 80 AS VARCHAR) ELSE 'Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') END AS value FROM customer),
o AS (SELECT provider, value, count(DISTINCT symbol) AS n, min(symbol) AS s FROM {IDS} GROUP BY 1, 2)
SELECT qid, q.provider, q.value, CASE WHEN q.value = '' THEN 'invalid' WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN q.value <> '' AND n = 1 THEN s END AS symbol, coalesce(n, 0) AS candidates FROM q LEFT JOIN o ON o.provider = q.provider AND o.value = q.value""")
def _(t):
    k = F.col("c_custkey")
    value = F.when(k % 11 == 0, "").when(k % 2 == 0, (k % 80).cast("string")).otherwise(F.concat(F.lit("Supplier#"), F.lpad((k % 120).cast("string"), 9, "0")))
    return idn.resolve_identifiers(t.customer.select(k.alias("qid"), F.when(k % 2 == 0, "alpha").otherwise("beta").alias("provider"), value.alias("value")), ids(t))


@query("I6_symbol_chain", sql="""
, r AS (SELECT 'C' || c_custkey AS old, 'C' || (c_custkey + 7) AS new FROM customer WHERE c_custkey % 50 < 40 AND c_nationkey <> 3),
c AS (WITH RECURSIVE w AS (SELECT old, new AS current, 1 AS hops FROM r UNION ALL SELECT w.old, r.new, hops + 1 FROM w JOIN r ON r.old = w.current) SELECT old, arg_max(current, hops) AS current, max(hops) AS hops FROM w GROUP BY 1) SELECT * FROM c""")
def _(t):
    k = F.col("c_custkey")
    return idn.symbol_chain(t.customer.where((k % 50 < 40) & (F.col("c_nationkey") != 3)).select(F.concat(F.lit("C"), k).alias("old"), F.concat(F.lit("C"), k + 7).alias("new")))


@query("I6_whole_chains", sql="""
, r AS (SELECT 'C' || c_custkey AS old, CASE WHEN c_custkey % 50 >= 43 THEN 'R' || c_custkey ELSE 'C' || (c_custkey + 7) END AS new FROM customer),
c AS (WITH RECURSIVE w AS (SELECT old, new AS current, 1 AS hops FROM r UNION ALL SELECT w.old, r.new, hops + 1 FROM w JOIN r ON r.old = w.current) SELECT old, arg_max(current, hops) AS current, max(hops) AS hops FROM w GROUP BY 1)
SELECT current, old, hops FROM c""")
def _(t):
    """All former names of each current one, over all customers; chains end where a link leaves their letter."""
    k = F.col("c_custkey")
    new = F.when(k % 50 >= 43, F.concat(F.lit("R"), k.cast("string"))).otherwise(F.concat(F.lit("C"), (k + 7).cast("string")))
    return idn.predecessors(t.customer.select(F.concat(F.lit("C"), k.cast("string")).alias("old"), new.alias("new")))


@query("I6_chain_faults", sql="""
, r AS (SELECT DISTINCT 'C' || c_custkey AS old, CASE WHEN c_custkey % 30 = 0 THEN 'C' || (c_custkey - 29) ELSE 'C' || (c_custkey + 1) END AS new FROM customer WHERE c_custkey % 60 > 30 OR c_custkey % 30 <> 0
  UNION SELECT 'C' || c_custkey, 'D' || c_custkey FROM customer WHERE c_custkey % 60 = 35),
c AS (SELECT old, count(*) AS n, min(new) AS new FROM r GROUP BY 1),
w AS (WITH RECURSIVE q AS (SELECT old, new AS current, 1 AS hops FROM c WHERE n = 1 UNION ALL SELECT q.old, c.new, hops + 1 FROM q JOIN c ON c.old = q.current AND c.n = 1 WHERE hops < 100) SELECT * FROM q),
e AS (SELECT old, arg_max(current, hops) AS current, max(hops) AS hops FROM w GROUP BY 1)
SELECT e.old, CASE WHEN hops < 100 THEN current END AS current, CASE WHEN hops < 100 THEN hops END AS hops, CASE WHEN hops >= 100 THEN 'cycle' WHEN c.n > 1 THEN 'fork' ELSE 'settled' END AS status FROM e LEFT JOIN c ON c.old = e.current
UNION ALL SELECT old, old, 0, 'fork' FROM c WHERE n > 1""")
def _(t):
    """Chains of up to thirty names, every second one closed to a cycle, some forked."""
    k = F.col("c_custkey")
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    one = t.customer.where((k % 60 > 30) | (k % 30 != 0)).select(name("C", k).alias("old"), F.when(k % 30 == 0, name("C", k - 29)).otherwise(name("C", k + 1)).alias("new"))
    return idn.renames_by_end(one.union(t.customer.where(k % 60 == 35).select(name("C", k), name("D", k))))


@query("GR1_neighbourhood", uses="nodes edges", sql="""
, l AS (SELECT * FROM edges WHERE available_at <= DATE '1997-06-30'), k AS (SELECT 'N' || n_nationkey AS key FROM nation),
b AS (SELECT key, 'out' AS direction, predicate, dst AS other FROM l JOIN k ON src = key UNION ALL SELECT key, 'in', predicate, src FROM l JOIN k ON dst = key), j AS (SELECT b.*, n.kind FROM b JOIN nodes n ON n.key = b.other AND n.available_at <= DATE '1997-06-30')
SELECT key, direction, predicate, other, kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY direction, predicate, other) AS rn FROM j) WHERE rn <= 15""")
def _(t):
    return idn.neighbourhood(t.nodes, t.edges, t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("key")), F.to_date(F.lit("1997-06-30")), 15)


@query("GR2_bitemporal_filter", uses="spans", sql="""
SELECT span_id, symbol FROM spans WHERE start_date - 10 <= DATE '1998-01-01' AND start_date <= DATE '1998-01-01' AND (end_date IS NULL OR end_date > DATE '1998-01-01')""")
def _(t):
    rows = t.spans.select("span_id", "symbol", F.date_sub("start_date", 10).alias("available_at"), F.col("start_date").alias("valid_from"), F.col("end_date").alias("valid_to"))
    return idn.bitemporal_filter(rows, F.to_date(F.lit("1998-01-01"))).select("span_id", "symbol")


@query("GR3_claim_evidence_rollup", sql="""
, e AS (SELECT o_custkey AS claim_id, o_orderkey AS evidence_id, CASE o_orderstatus WHEN 'O' THEN 'supports' WHEN 'F' THEN 'contradicts' ELSE 'context' END AS relation FROM orders WHERE o_totalprice / 500000 >= 0.5)
SELECT c_custkey AS claim_id, coalesce('[' || string_agg('{"evidence_id":' || evidence_id || ',"relation":"' || relation || '"}', ',' ORDER BY evidence_id) || ']', '[]') AS evidence, count(*) FILTER (WHERE relation = 'supports') AS supports, count(*) FILTER (WHERE relation = 'contradicts') AS contradicts FROM customer LEFT JOIN e ON claim_id = c_custkey GROUP BY 1""")
def _(t):
    relation = F.when(F.col("o_orderstatus") == "O", "supports").when(F.col("o_orderstatus") == "F", "contradicts").otherwise("context")
    evidence = t.orders.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("evidence_id"), relation.alias("relation"), (F.col("o_totalprice") / 500000).alias("confidence"))
    return idn.claim_rollup(t.customer.select(F.col("c_custkey").alias("claim_id")), evidence, 0.5)


@query("GR4_decision_evidence", uses="outcomes", doubles="value", sql="""
, r AS (SELECT symbol, date, CASE outcome WHEN 'WIN' THEN 'Buy' WHEN 'LOSS' THEN 'Sell' ELSE 'Hold' END AS label, 100 * p AS conviction, CASE WHEN prints % 2 = 0 THEN 6.0 * prints END AS breadth FROM outcomes),
l AS (SELECT symbol, date, label, 'conviction' AS e, conviction AS v FROM r UNION ALL SELECT symbol, date, label, 'breadth', breadth FROM r WHERE breadth IS NOT NULL),
s AS (SELECT *, CASE label WHEN 'Buy' THEN 1 WHEN 'Sell' THEN -1 ELSE 0 END AS side, CASE WHEN v >= 60 THEN 1 WHEN v <= 40 THEN -1 ELSE 0 END AS lean FROM l)
SELECT symbol, date, 'component:' || e AS evidence_key, CASE WHEN side = 0 OR lean = 0 THEN 'context' WHEN side = lean THEN 'supports' ELSE 'contradicts' END AS relation, v AS value FROM s""")
def _(t):
    label = F.when(F.col("outcome") == "WIN", "Buy").when(F.col("outcome") == "LOSS", "Sell").otherwise("Hold")
    rows = t.outcomes.select("symbol", "date", label.alias("label"), (100 * F.col("p")).alias("conviction"), F.when(F.col("prints") % 2 == 0, 6.0 * F.col("prints")).alias("breadth"))
    return idn.decision_evidence(rows, ["conviction", "breadth"])
