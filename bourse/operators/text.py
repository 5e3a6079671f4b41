"""Text: entity tags, lexicon scores, rules, feeds, vector and keyword search, news features."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.frames import col, ratio
from bourse.functions.scalar import content_id, norm
from bourse.operators.search import vector_topk  # noqa: F401  (a part of this module's interface)
from bourse.session import written

# The lexicons and patterns of the news classifier.
BULLISH = [
    "surge", "rally", "gain", "gains", "profit", "profits", "beat", "beats", "record", "records", "growth", "rise", "rises", "jump", "jumps", "soar", "soars",
    "strong", "positive", "upgrade", "upgraded", "outperform", "bullish", "breakout", "order win", "order wins", "contract", "contracts", "deal", "deals",
    "acquisition", "buyback", "buy back", "dividend", "dividends", "expansion", "turnaround", "recovery", "rebound", "higher", "upside", "target raised",
    "q4 profit", "net profit up", "revenue up", "ebitda up", "margin expansion", "bottomed", "all-time high", "52-week high", "listing gains", "ipo subscribed",
    "ipo listing", "stake sale",
]
BEARISH = [
    "fall", "falls", "drop", "drops", "decline", "declines", "loss", "losses", "miss", "misses", "weak", "weaker", "negative", "sell", "downgrade", "downgraded",
    "bearish", "breakdown", "debt", "fraud", "penalty", "penalties", "recession", "inflation", "rate hike", "miss estimates", "below estimate", "lower guidance",
    "concern", "concerns", "risk", "risks", "defaults", "npa", "write-off", "impairment", "layoffs", "job cuts", "downfall", "margin compression", "net loss",
    "revenue down", "profit falls", "pat down", "disappoints", "disappointing", "warning", "lower outlook", "sell-off", "crash",
]
HIGH_IMPACT = [
    "rbi policy", "repo rate", "budget", "sebi", "upper circuit", "52-week high", "all-time high", "result season", "q4 results", "nifty", "sensex", "fed rate",
    "crude oil", "rupee",
]
SECTORS = {
    "banking": "Banking", "bank": "Banking", "nbfc": "Banking", "pharma": "Pharmaceuticals", "drug": "Pharmaceuticals", "it ": "IT", "software": "IT", "tech": "IT",
    "auto": "Automobiles", "ev": "Automobiles", "electric vehicle": "Automobiles", "fmcg": "FMCG", "consumer": "FMCG", "metal": "Metals", "steel": "Metals",
    "aluminium": "Metals", "realty": "Real Estate", "real estate": "Real Estate", "housing": "Real Estate", "chemical": "Chemicals", "telecom": "Telecom",
    "oil": "Oil & Gas", "gas": "Oil & Gas", "refinery": "Oil & Gas", "cement": "Cement", "infra": "Infrastructure", "construction": "Infrastructure",
    "highway": "Infrastructure", "power": "Power", "energy": "Power", "solar": "Power", "renewable": "Power", "media": "Media", "entertainment": "Media",
}
EVENTS = [
    (r"\border\b.{0,30}(?:win|secur|receiv|award|bag|get)", 2.0, "ORDER_WIN"), (r"(?:buyback|buy.?back|share.?repurchas)", 1.5, "BUYBACK"),
    (r"(?:promoter|management).{0,20}(?:buy|acquir|purchas|increas)", 1.5, "PROMOTER_BUY"), (r"(?:promoter|management).{0,20}(?:sell|offload|reduc|pledg)", -1.5, "PROMOTER_SELL"),
    (r"(?:beat|beat\s+estimate|above\s+estimate|strong\s+quarter|record\s+(?:profit|revenue|sales))", 1.5, "RESULTS_BEAT"),
    (r"(?:miss|below\s+estimate|disappoint|weak\s+quarter|profit\s+(?:fall|drop|declin))", -1.5, "RESULTS_MISS"),
    (r"\bqip\b|\bqualified\s+institutional\s+placement\b", 0.5, "QIP"), (r"(?:merger|acquisition|acquir|takeover|amalgamat)", 1.0, "MERGER_ACQUISITION"),
    (r"(?:dividend|dividend\s+announc|dividend\s+declar)", 0.8, "DIVIDEND"), (r"(?:debt|borrowing|loan|bond|ncd).{0,20}(?:rais|issu|taken)", -0.8, "DEBT_RAISED"),
    (r"\bsebi\b.{0,30}(?:action|order|penalt|fine|notice|ban|restrict)", -2.0, "REGULATORY"), (r"(?:fraud|scam|misappropriat|embezzl|forensic\s+audit)", -2.5, "FRAUD"),
    (r"(?:litigation|lawsuit|legal\s+notice|court\s+order|arbitration)", -1.0, "LITIGATION"), (r"(?:rating\s+upgrade|outlook\s+(?:positive|stable\s+to\s+positive))", 1.0, "RATING_UPGRADE"),
    (r"(?:rating\s+downgrade|outlook\s+(?:negative|stable\s+to\s+negative))", -1.0, "RATING_DOWNGRADE"), (r"(?:block\s+deal|bulk\s+deal).{0,30}(?:buy|purchas)", 0.8, "BLOCK_BUY"),
    (r"(?:block\s+deal|bulk\s+deal).{0,30}(?:sell|offload)", -0.8, "BLOCK_SELL"), (r"(?:expansion|capex|capacity\s+addition|new\s+plant|greenfield)", 1.0, "EXPANSION"),
]
CATEGORIES = {
    "EARNINGS": ["q1", "q2", "q3", "q4", "quarterly", "pat", "net profit", "revenue", "results", "earnings", "fy26", "fy25", "ebitda", "margin", "annual results", "half-yearly"],
    "ORDER_WIN": ["order win", "order wins", "contract awarded", "contract win", "wins order", "secures order", "bagged order", "wins project", "secures contract", "letter of intent", "loi", "work order",
                  "export order"],
    "BUYBACK": ["buyback", "buy back", "share repurchase", "tender offer", "open offer", "promoter buying"],
    "POLICY": ["rbi", "sebi", "government", "policy", "repo rate", "monetary policy", "budget", "gst", "finance ministry", "regulation", "tax", "msme", "pli scheme", "import duty"],
    "IPO": ["ipo", "initial public offering", "listing", "listing day", "gmp", "grey market", "allotment", "subscription"],
    "GLOBAL": ["us market", "fed", "federal reserve", "china", "europe", "crude oil", "brent", "wti", "dollar index", "dxy", "treasury", "global market", "dow jones", "nasdaq", "s&p 500", "nikkei",
               "hang seng", "ftse"],
    "SECTOR": ["sector", "industry", "banking", "pharma", "it sector", "fmcg", "auto sector", "metal", "realty", "telecom", "energy", "infrastructure", "chemical"],
}
GENERIC = ("india", "power", "energy", "finance", "financial", "industries", "motors", "steel", "cement", "bank", "life", "general", "national", "infrastructure", "capital", "technologies",
           "technology", "enterprises", "international", "global", "products", "chemicals", "textiles", "holdings", "services", "auto", "paper")
NAMES = 100_000  # aliases that are broadcast at most; more are joined
LEGAL_SUFFIX = r"(?i)\b(limited|ltd|private|pvt|corporation|corp|incorporated|inc|company|the)\b"


def build_alias_index(names: DataFrame, generic=GENERIC) -> DataFrame:
    """Aliases of (symbol, name): suffix-free names; a name two symbols share falls back to the full form."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"\(.*?\)", " "), r"[.,]", " "), LEGAL_SUFFIX, " "), r"\s+", " "))
    rows = names.withColumn("_bare", bare)
    single = ~F.contains("_bare", F.lit(" ")) & F.lower("_bare").isin(list(generic))
    rows = rows.where((F.length("_bare") >= 4) & ~single)
    owners = rows.groupBy("_bare").agg(F.count("*").alias("_owners"))
    full = F.regexp_replace("name", LEGAL_SUFFIX, " ")
    out = rows.join(owners, "_bare").select("symbol", norm(F.when(F.col("_owners") > 1, full).otherwise(F.col("_bare"))).alias("alias"))
    return out.where(F.length("alias") >= 2).distinct()


def _tagged_in_place(docs: DataFrame, first: DataFrame, text: str, doc: str, longest: int) -> DataFrame:
    """(doc, symbol, alias) with the aliases broadcast, as their number is bounded: each distinct token with the few that follow it meets them, no text is shuffled."""
    # The words are bound to a lambda variable: as a column they would be cut from the text again for every token.
    runs = F.transform(F.array(F.split(norm(text), " ")), lambda words: F.transform(words, lambda w, k: F.concat(F.array_join(F.slice(words, k + 1, F.lit(longest)), " "), F.lit(" "))))
    tokens = docs.select(doc, F.explode(F.array_distinct(runs[0])).alias("_after")).withColumn("_first", F.substring_index("_after", " ", 1))
    return tokens.join(F.broadcast(first), "_first").where(F.startswith("_after", F.concat("alias", F.lit(" ")))).select(doc, "symbol", "alias")


def _tagged_by_join(docs: DataFrame, first: DataFrame, text: str, doc: str) -> DataFrame:
    """(doc, symbol, alias) for any number of aliases: distinct tokens meet them, then the texts of documents that hold the first token of a longer one."""
    tokens = docs.select(doc, F.explode(F.array_distinct(F.split(norm(text), " "))).alias("_first"))
    met = tokens.join(first, "_first").select(doc, "symbol", "alias")
    long = F.contains(F.col("alias"), F.lit(" "))
    padded = docs.select(doc, F.concat(F.lit(" "), norm(text), F.lit(" ")).alias("_padded"))
    whole = met.where(long).join(padded, doc).where(F.contains("_padded", F.concat(F.lit(" "), "alias", F.lit(" ")))).select(doc, "symbol", "alias")
    return met.where(~long).unionByName(whole)


def tag_entities(docs: DataFrame, aliases: DataFrame, text: str = "text", doc: str = "doc_id", most: int = 5) -> DataFrame:
    """Symbols whose alias appears as whole tokens, longest alias first, one hit per symbol, at most `most`.

    Tokens meet the aliases of any length on their first one. Up to NAMES aliases go to the documents; more are joined.
    """
    first = aliases.withColumn("_first", F.substring_index("alias", " ", 1))
    size, longest = first.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(1))).first()
    found = _tagged_in_place(docs, first, text, doc, longest) if size <= NAMES else _tagged_by_join(docs, first, text, doc)
    best = found.groupBy(doc, "symbol").agg(F.max(F.length("alias")).alias("_len"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("_len"), F.asc("symbol")))
    return best.withColumn("rank", place).where(F.col("rank") <= most).select(doc, "symbol", "rank")


def hits_of(text: Column, words) -> Column:
    """How many of the words occur anywhere in the text."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def keyword_scores(docs: DataFrame, text: str = "text", bullish=BULLISH, bearish=BEARISH, high=HIGH_IMPACT, categories: dict = CATEGORIES, sectors: dict = SECTORS) -> DataFrame:
    """Sentiment, impact, category with most hits (earlier wins) and first matching sector."""
    rows = docs.withColumn("_x", F.lower(text))
    x = F.col("_x")
    rows = rows.withColumns({"bullish_hits": hits_of(x, bullish), "bearish_hits": hits_of(x, bearish), "_high": hits_of(x, high) > 0})
    score = F.coalesce(ratio(F.col("bullish_hits") - F.col("bearish_hits"), F.col("bullish_hits") + F.col("bearish_hits")), F.lit(0.0))
    rows = rows.withColumn("sentiment_score", score)
    s = F.col("sentiment_score")
    rows = rows.withColumns({
        "sentiment": F.when(s > 0.15, "BULLISH").when(s < -0.15, "BEARISH").otherwise("NEUTRAL"),
        "impact": F.when(F.col("_high") | (F.abs(s) > 0.6), "HIGH").when(F.abs(s) > 0.3, "MEDIUM").otherwise("LOW"),
        "sector": F.coalesce(*[F.when(F.contains(x, F.lit(k)), v) for k, v in sectors.items()]),
    })
    counted = F.array(*[F.struct(hits_of(x, words).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, words) in enumerate(categories.items())])
    rows = rows.withColumn("_c", F.array_max(counted)).withColumn("category", F.when(F.col("_c.n") > 0, F.col("_c.c")).otherwise("GENERAL"))
    return rows.drop("_x", "_high", "_c")


def rule_classify(df: DataFrame, name: str, rules, poles=("bullish", "bearish")) -> DataFrame:
    """First matching (pattern, bias, category, horizon); abstains when the name carries both poles."""
    x = F.lower(name)
    both = F.contains(x, F.lit(poles[0])) & F.contains(x, F.lit(poles[1]))
    none = F.struct(F.lit("neutral").alias("bias"), F.lit("unresolved").alias("category"), F.lit("swing").alias("horizon"))
    first = F.coalesce(*[F.when(F.rlike(x, F.lit(p)) & ~both, F.struct(F.lit(b).alias("bias"), F.lit(c).alias("category"), F.lit(h).alias("horizon"))) for p, b, c, h in rules], none)
    return df.withColumn("_r", first).select(*df.columns, "_r.*")


def concept_tags(df: DataFrame, name: str, vocabulary, polarity=(r"bullish|above|high", r"bearish|below|low")) -> DataFrame:
    """Normalised name, facet tags that match it, and a polarity hint when only one pole does."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([a-zA-Z])([0-9])", "$1 $2")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(spaced), r"[^a-z0-9%+. -]+", " "), r"\s+", " "))
    rows = df.withColumn("normalized", plain)
    tags = F.filter(F.array(*[F.when(F.rlike("normalized", F.lit(p)), F.lit(f"{facet}:{tag}")) for tag, facet, p in vocabulary]), lambda t: t.isNotNull())
    up, down = F.rlike("normalized", F.lit(polarity[0])), F.rlike("normalized", F.lit(polarity[1]))
    return rows.withColumns({"tags": F.array_join(tags, ","), "polarity": F.when(up & ~down, "bullish").when(down & ~up, "bearish")})


def dedupe_membership(members: DataFrame) -> DataFrame:
    """One entry per symbol, source and normalised title: the lowest screener id."""
    key = F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", " "))
    rows = members.withColumn("_key", F.when(key != "", key).otherwise(F.col("screener_id").cast("string")))
    rest = [c for c in members.columns if c not in ("symbol", "source")]
    return rows.groupBy("symbol", F.lower("source").alias("source"), "_key").agg(F.min(F.struct("screener_id", *[c for c in rest if c != "screener_id"])).alias("_r")).select("symbol", "source", "_r.*")


def strip_html(c) -> Column:
    """Tags out, the common entities decoded, blanks collapsed."""
    out = F.regexp_replace(col(c), r"<[^>]*>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def feed_field(block, tag: str) -> Column:
    """A field of a feed or page block, plain or wrapped in CDATA."""
    block = col(block)
    inner = F.regexp_extract(block, rf"(?is)<{tag}>\s*<!\[CDATA\[(.*?)\]\]>\s*</{tag}>", 1)
    plain = F.regexp_extract(block, rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    return strip_html(F.when(inner != "", inner).otherwise(plain))


def news_features(items: DataFrame, grid: DataFrame) -> DataFrame:
    """Three-day mean sentiment and five-day high-impact count from items known by each date.

    An item counts from the later of its published and fetched dates.
    """
    known = F.greatest("published", F.coalesce("fetched", "published"))
    daily = items.groupBy("symbol", known.alias("date")).agg(F.sum("score").alias("_s"), F.count("score").alias("_n"), F.count_if(F.col("impact") == "HIGH").alias("_h"))
    both = grid.select("symbol", "date").distinct().withColumn("_ask", F.lit(True)).join(daily, ["symbol", "date"], "full")
    days = F.datediff("date", F.lit("1970-01-01"))
    w = Window.partitionBy("symbol").orderBy(days)
    out = both.withColumns({"sentiment_3d": ratio(F.sum("_s").over(w.rangeBetween(-2, 0)), F.sum("_n").over(w.rangeBetween(-2, 0))), "high_impact_5d": F.coalesce(F.sum("_h").over(w.rangeBetween(-4, 0)), F.lit(0)),
                            "_seen": F.coalesce(F.sum("_n").over(w.rangeBetween(-6, 0)), F.lit(0))})
    out = out.where("_ask")
    day = Window.partitionBy("date")
    n = F.count("*").over(day)
    rank = F.rank().over(day.orderBy("_seen")) + (F.count("*").over(day.orderBy("_seen").rangeBetween(0, 0)) - 1) / 2
    return out.withColumn("attention", rank / n).drop("_ask", "_s", "_n", "_h", "_seen")


def build_documents(master: DataFrame, profiles: DataFrame) -> DataFrame:
    """One text and one metadata struct per entity."""
    rows = master.join(profiles, "symbol", "left")
    return rows.select("symbol", F.concat_ws(". ", "name", F.concat(F.lit("Sector: "), "sector"), F.concat(F.lit("Orders: "), F.col("orders").cast("string"))).alias("text"),
                       F.to_json(F.struct("symbol", "sector", "orders")).alias("metadata"))


def keyword_search(docs: DataFrame, query, fields: dict, doc: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Field-weighted BM25 ranking of documents for a list of terms."""
    of = lambda words, q: F.size(F.filter(words, lambda t: t == q))
    counts = lambda words: F.struct(F.size(words).alias("n"), *[of(words, q).alias(f"c{i}") for i, q in enumerate(query)])
    # The words are bound by an array of one, so a text is cut once however often they are counted.
    cut = {f: F.transform(F.array(F.filter(F.split(norm(f), " "), lambda t: t != "")), counts)[0] for f in fields}
    rows = docs.select(doc, *[c.alias(f"_{f}") for f, c in cut.items()])
    length = F.greatest(sum((F.col(f"_{f}.n") for f in fields), F.lit(0)), F.lit(1))
    tf = {f"_tf{i}": sum((F.col(f"_{f}.c{i}") * w for f, w in fields.items()), F.lit(0.0)) for i in range(len(query))}
    rows = written(rows.select(doc, length.alias("_len"), *[e.alias(n) for n, e in tf.items()]), "term-counts")  # a few numbers a document, read twice
    facts = rows.agg(F.struct(F.count("*").alias("n"), F.avg("_len").alias("len"), *[F.count_if(F.col(n) > 0).alias(n) for n in tf]).alias("s"))
    rows = rows.withColumn("_s", facts.scalar())
    s = F.col("_s")
    part = lambda n: F.when(F.col(n) > 0, F.log(1 + (s["n"] - s[n] + 0.5) / (s[n] + 0.5)) * F.col(n) * (k1 + 1) / (F.col(n) + k1 * (1 - b + b * F.col("_len") / s["len"]))).otherwise(0.0)
    rows = rows.select(doc, F.round(sum((part(n) for n in tf), F.lit(0.0)), 9).alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), F.asc(doc)).limit(k)


def sentiment_fusion(df: DataFrame) -> DataFrame:
    """Two models' probabilities (a_pos, a_neg, b_pos, b_neg, b_neu) into one label and a conflict measure."""
    a, bb = F.col("a_pos") - F.col("a_neg"), F.col("b_pos") - F.col("b_neg")
    label = F.when((F.col("b_pos") >= F.col("b_neg")) & (F.col("b_pos") >= F.col("b_neu")), "positive").when(F.col("b_neg") >= F.col("b_neu"), "negative").otherwise("neutral")
    return df.withColumns({"tone_label": F.when(bb.isNotNull(), label), "tone_score": bb, "conflict": F.abs(a - bb) / 2})


def sentiment_snapshot(items: DataFrame, by) -> DataFrame:
    """Counts and mean score per window or sector with the overall label."""
    out = items.groupBy(*by).agg(F.count_if(F.col("sentiment") == "BULLISH").alias("bullish"), F.count_if(F.col("sentiment") == "BEARISH").alias("bearish"), F.count_if(F.col("sentiment") == "NEUTRAL").alias("neutral"),
                                 F.count_if(F.col("impact") == "HIGH").alias("high_impact"), F.avg("score").alias("overall"))
    return out.withColumn("label", F.when(F.col("overall") > 0.15, "BULLISH").when(F.col("overall") < -0.15, "BEARISH").otherwise("NEUTRAL"))


def dedupe_items(items: DataFrame, content, order: str) -> DataFrame:
    """First-seen row per content id, as an aggregate."""
    rest = [c for c in items.columns if c != order]
    return items.groupBy(content_id(*content).alias("content_id")).agg(F.min(F.struct(order, *rest)).alias("_r")).select("content_id", "_r.*")


def event_scores(articles: DataFrame, grid: DataFrame, patterns=EVENTS, days: int = 30) -> DataFrame:
    """Sum of scores and distinct event types over articles dated in [date - days, date]."""
    text = F.lower("text")
    found = F.filter(F.array(*[F.when(F.rlike(text, F.lit(p)), F.struct(F.lit(t).alias("type"), F.lit(s).alias("score"))) for p, s, t in patterns]), lambda e: e.isNotNull())
    hits = articles.select("symbol", "date", F.explode(found).alias("_e")).select("symbol", "date", "_e.*")
    daily = hits.groupBy("symbol", "date").agg(F.sum("score").alias("_s"), F.collect_set("type").alias("_t"))
    both = grid.select("symbol", "date").distinct().withColumn("_ask", F.lit(True)).join(daily, ["symbol", "date"], "full")
    w = Window.partitionBy("symbol").orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(-days, 0)
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_t").over(w)))), ",")
    return both.select("symbol", "date", "_ask", F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("event_score"), types.alias("event_types")).where("_ask").drop("_ask")
