"""Queries over records of sources: filters, joins of dimensions, per-source shapes, serving frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import prompts
from eventloom.functions import signals as G
from eventloom.functions import text as T
from eventloom.operators import attribution as A
from eventloom.operators import audit
from eventloom.operators import holdings as H
from eventloom.operators import panel as P
from eventloom.operators import relevance as V
from eventloom.operators import unify as U
from eventloom.plans.base import DATED, PANEL, SPLITS, Registry, dated_events, panel, price_sql, r6, splits, table, with_
from eventloom.plans.strategy import BASE, attributions

REG = Registry()


@REG.add("A01_A08_filtered_scan", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IN (1, 7, 9) AND l_shipdate <= timestamp '1999-12-31'")
def a01(spark, d):
    from eventloom.sources.readers import scan

    return scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_suppkey"], F.col("l_suppkey").isin(1, 7, 9) & (F.col("l_shipdate") <= F.lit("1999-12-31").cast("timestamp")))


@REG.add("A05_A06_actions", "SELECT '5' AS ticker, l_shipdate::date AS date, round(max(l_discount), 2) AS amount FROM lineitem WHERE l_suppkey = 5 AND l_shipdate <= timestamp '1999-12-31' GROUP BY 2")
def a05(spark, d):
    from eventloom.sources.readers import load_actions

    raw = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("report_date")).agg(F.max("l_discount").cast("decimal(38,2)").alias("amount"))
    return load_actions(raw, "5", "1999-12-31").select("ticker", "date", F.round("amount", 2).alias("amount"))


@REG.add("A07_price_series", with_(PANEL) + f"SELECT ticker, date, {price_sql('close')} AS close FROM panel WHERE ticker = 4 AND date BETWEEN date '1997-01-01' AND date '1997-12-31'")
def a07(spark, d):
    from eventloom.sources.readers import price_series

    return price_series(panel(spark, d), 4, "1997-01-01", "1997-12-31").select("ticker", "date", P.to_places(F.col("close"), 4).alias("close"))


@REG.add("C01_C02_as_of_keys", "SELECT event_id FROM events WHERE upper(event_type) = 'CLICK' AND ts::date <= date '2024-01-15'")
def c01(spark, d):
    return table(spark, d, "events").where((F.upper("event_type") == "CLICK") & (F.to_date("ts") <= F.lit("2024-01-15").cast("date"))).select("event_id")


@REG.add("C03_prefix_filter", "SELECT o_orderkey FROM orders WHERE coalesce(starts_with(o_orderpriority, '1-'), false)")
def c03(spark, d):
    return table(spark, d, "orders").where(F.coalesce(F.col("o_orderpriority").startswith("1-"), F.lit(False))).select("o_orderkey")


@REG.add("C05_universe", "SELECT event_id, 'significant' AS universe FROM events WHERE value > 80 UNION ALL SELECT event_id, 'focal' FROM events WHERE user_id % 10 = 0 UNION ALL SELECT event_id, 'focal_significant' FROM events WHERE user_id % 10 = 0 AND value > 80 UNION ALL SELECT event_id, 'all' FROM events")
def c05(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("value") > 80).alias("is_significant"), (F.col("user_id") % 10 == 0).alias("is_focal"))
    own = F.filter(F.array(*[F.when(F.expr(f), n) for n, f in UNIVERSES.items()]), lambda x: x.isNotNull())
    return rows.select("event_id", F.explode(own).alias("universe"))


UNIVERSES = {"all": "true", "significant": "is_significant", "focal": "is_focal", "focal_significant": "is_focal and is_significant"}


@REG.add("C08_split_ratio", with_(SPLITS) + "SELECT ticker, date, split_part(split_factor, ':', 2)::double / split_part(split_factor, ':', 1)::double AS factor FROM splits")
def c08(spark, d):
    return splits(spark, d).select("ticker", "date", P.split_factor(F.col("split_factor")).alias("factor"))


@REG.add("C12_holding_actions", "SELECT o_custkey, CASE WHEN a IS NULL THEN 'NEW' WHEN b IS NULL THEN 'EXITED' WHEN b > a THEN 'INCREASED' WHEN b < a THEN 'REDUCED' END AS action FROM (SELECT o_custkey, count(*) FILTER (o_orderdate < timestamp '1998-01-01') AS a0, count(*) FILTER (o_orderdate >= timestamp '1998-01-01') AS b0, nullif(a0, 0) AS a, nullif(b0, 0) AS b FROM orders GROUP BY 1)")
def c12(spark, d):
    late = F.col("o_orderdate") >= "1998-01-01"
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.nullif(F.count_if(~late), F.lit(0)).alias("a"), F.nullif(F.count_if(late), F.lit(0)).alias("b"))
    return by.select("o_custkey", H.classify(F.col("a"), F.col("b")).alias("action"))


@REG.add("C20_C21_C23_derivations", "SELECT o_orderkey, d + 14 AS published, (date_trunc('quarter', CASE WHEN q = d THEN d + 1 ELSE d END) - interval 1 day)::date AS quarter_end, CASE WHEN o_totalprice % 3 > 2 THEN 'up' WHEN o_totalprice % 3 < 1 THEN 'down' ELSE 'flat' END AS bucket FROM (SELECT o_orderkey, o_totalprice, o_orderdate::date AS d, (date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day)::date AS q FROM orders)")
def c21(spark, d):
    from eventloom.functions.dates import last_quarter_end, publication

    c, v = F.to_date("o_orderdate"), F.col("o_totalprice") % 3
    return table(spark, d, "orders").select("o_orderkey", publication(c).alias("published"), last_quarter_end(c).alias("quarter_end"), F.when(v > 2, "up").when(v < 1, "down").otherwise("flat").alias("bucket"))


FUNDS = {"AFRICA": "XAF", "AMERICA": "XAM", "ASIA": "XAS", "EUROPE": "XEU", "MIDDLE EAST": "XME"}


@REG.add("C25_D02_sector_funds", "SELECT s_suppkey, CASE r_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FUNDS.items()) + " END AS fund FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def c25(spark, d):
    from eventloom.plans.base import sector_of

    funds = F.create_map(*[F.lit(x) for kv in FUNDS.items() for x in kv])
    return sector_of(spark, d).select(F.col("ticker").alias("s_suppkey"), funds[F.col("sector")].alias("fund"))


@REG.add("C29_clip", "SELECT event_id, greatest(-50.0, least(50.0, value - 40)) AS clipped FROM events")
def c29(spark, d):
    v = F.col("value") - 40
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(-50.0), F.least(F.lit(50.0), v)).alias("clipped"))


@REG.add("C31_D01_D03_contract", "SELECT o.o_orderkey AS event_id, o_orderdate::date AS earnings_date, c_name AS company, n AS n_lines FROM orders o LEFT JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def d03(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(lines, o["o_orderkey"] == lines["l_orderkey"])
    return rows.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("earnings_date"), F.col("c_name").alias("company"), "n_lines")


@REG.add("D14_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def d14(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_nationkey = 3")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").select("o_orderkey")


@REG.add("D17_peer_expansion", "SELECT focal, doc_id FROM (SELECT focal, doc_id, row_number() OVER (PARTITION BY focal, doc_id ORDER BY ord) AS k FROM (SELECT focal, ord, doc_id FROM documents JOIN (VALUES ('f1', 0, 'src1'), ('f1', 1, 'src2'), ('f2', 0, 'src2'), ('f2', 1, 'src2')) p(focal, ord, src) ON source = src)) WHERE k = 1")
def d17(spark, d):
    peers = spark.createDataFrame([("f1", ["src1", "src2"]), ("f2", ["src2", "src2"])], "focal string, peers array<string>")
    pairs = peers.select("focal", F.posexplode("peers").alias("ord", "source")).groupBy("focal", "source").agg(F.min("ord").alias("ord"))
    rows = table(spark, d, "documents").select("doc_id", "source").join(F.broadcast(pairs), "source")  # the peer map is a constant
    return rows.groupBy("focal", "doc_id").agg(F.min("ord").alias("ord")).select("focal", "doc_id")


HEADED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Item 1. Business ' || text || ' Item 1A. ' || source || text || ' Item 7. x' WHEN 1 THEN 'item 7. y ITEM 1A. ' || text WHEN 2 THEN text ELSE 'Item 1A. ' || source || ' Item 1. late' END AS t FROM documents"


@REG.add("I08_header_sections", f"SELECT doc_id, CASE WHEN s > 0 THEN md5(trim(substr(t, s, coalesce(e, length(t) + 1) - s), ' ')) END AS risk FROM (SELECT *, least(CASE WHEN p1 > s THEN p1 END, CASE WHEN p7 > s THEN p7 END) AS e FROM (SELECT *, instr(lower(t), 'item 1a.') AS s, instr(lower(t), 'item 1.') AS p1, instr(lower(t), 'item 7.') AS p7 FROM ({HEADED})))")
def i08(spark, d):
    """The section between two headers of whole texts, in any order of headers; its digest stands for it here."""
    k, t, src = F.col("doc_id"), F.col("text"), F.col("source")
    text = F.when(k % 4 == 0, F.concat(F.lit("Item 1. Business "), t, F.lit(" Item 1A. "), src, t, F.lit(" Item 7. x"))).when(k % 4 == 1, F.concat(F.lit("item 7. y ITEM 1A. "), t)).when(k % 4 == 2, t).otherwise(F.concat(F.lit("Item 1A. "), src, F.lit(" Item 1. late")))
    rows = table(spark, d, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.md5(prompts.section_between(F.col("t"), [("business", "item 1."), ("risk", "item 1a."), ("mda", "item 7.")], "risk")).alias("risk"))


SPONSORS = [("CUSTOMER0000001", "AAA"), ("CUSTOMER00000010", "BBB"), ("CUSTOMER0000000", "CCC"), ("CUSTOMER00000113", "DDD")]


@REG.add("I11_sponsor_names", "SELECT c_custkey, CASE " + " ".join(f"WHEN starts_with(k, '{p}') THEN '{t}'" for p, t in SPONSORS) + " END AS ticker FROM (SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS k FROM customer)")
def i11(spark, d):
    """Ordered prefix map over normalised names: the first entry that fits wins, so a longer one behind it never does."""
    suffix = F.get(F.array(*[F.lit(x) for x in (", Inc.", " Holdings", " Corp Group", "")]), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.first_prefix(T.company_key(F.concat("c_name", suffix)), SPONSORS).alias("ticker"))


@REG.add("I15_paragraph_list", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' ') AS joined FROM documents")
def i15(spark, d):
    return table(spark, d, "documents").select("doc_id", T.join_sentences(F.split("text", "\n")).alias("joined"))


@REG.add("I17_clean", "SELECT page_id, regexp_replace(regexp_replace(url, '\\[[^\\]]*\\]', '', 'g'), '\\s+', ' ', 'g') AS clean FROM pages")
def i17(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"\[[^\]]*\]", ""), r"\s+", " ").alias("clean"))


@REG.add("I21_evidence_block", "SELECT o_orderkey, 'MOVE ' || o_custkey || ' ' || o_orderdate::date || printf(' %+.2f%%', floor(o_totalprice / 1000)) || chr(10) || 'EVENTS' || chr(10) || o_orderdate::date || ' | news | ' || o_orderpriority || chr(10) || 'CHUNKS' || chr(10) || '[c1] ' || o_orderstatus AS block FROM orders")
def i21(spark, d):
    day = F.to_date("o_orderdate")
    events = F.array(F.struct(day.alias("event_date"), F.lit("news").alias("event_type"), F.col("o_orderpriority").alias("text")))
    chunks = F.array(F.struct(F.lit("c1").alias("chunk_id"), F.col("o_orderstatus").alias("text")))
    return table(spark, d, "orders").select("o_orderkey", prompts.evidence_block(F.col("o_custkey").cast("string"), day, F.floor(F.col("o_totalprice") / 1000) / 100.0, events, chunks).alias("block"))


@REG.add("J13_weight_delta", BASE + " SELECT event_id, round(greatest(" + ", ".join(f"abs(w_{x} - 0.2)" for x in G.DIMENSIONS) + "), 6) AS delta FROM attr")
def j13(spark, d):
    return attributions(spark, d).select("event_id", r6(F.greatest(*[F.abs(F.col(f"w_{x}") - 0.2) for x in G.DIMENSIONS])).alias("delta"))


@REG.add("J15_flatten_record", "SELECT event_id, coalesce((props->>'k')::bigint, 0) AS k, event_type AS kind FROM events")
def j15(spark, d):
    rec = table(spark, d, "events").select("event_id", F.struct(F.from_json("props", "k bigint").alias("inner"), F.col("event_type").alias("kind")).alias("r"))
    return rec.select("event_id", F.coalesce(F.col("r").getField("inner").getField("k"), F.lit(0)).alias("k"), F.col("r").getField("kind").alias("kind"))


@REG.add("J18_J19_completeness", BASE + ", v AS (SELECT *, " + ", ".join(f"CASE WHEN event_id % {m} = 0 THEN 0.0 ELSE w_{x} END AS v_{x}" for x, m in zip(G.DIMENSIONS, (2, 3, 5, 7, 11), strict=True)) + " FROM attr) SELECT event_id, CASE WHEN pred IS NULL THEN 2 WHEN " + " + ".join(f"(v_{x} > 0)::int" for x in G.DIMENSIONS) + " < 2 THEN 1 WHEN " + " + ".join(f"v_{x}" for x in G.DIMENSIONS) + " < 0.7 THEN 3 ELSE 0 END AS code, CASE WHEN event_id % 9 = 0 THEN 'neutral' ELSE direction END AS direction FROM v")
def j18(spark, d):
    k = F.col("event_id")
    raw = F.when(k % 9 == 0, F.concat(F.lit("very "), "direction")).when(k % 3 == 0, F.upper("direction")).otherwise(F.concat(F.lit(" "), F.initcap("direction"), F.lit("  ")))
    weights = [F.when(k % m == 0, 0.0).otherwise(F.col(f"w_{x}")) for x, m in zip(G.DIMENSIONS, (2, 3, 5, 7, 11), strict=True)]
    return attributions(spark, d).select("event_id", prompts.completeness(F.col("pred"), weights).alias("code"), prompts.coerced(raw, ("positive", "negative", "neutral"), "neutral").alias("direction"))


@REG.add("K02a_rating_and_target_events", "SELECT 't' || event_id AS event_id, user_id::varchar AS ticker, ts::date AS event_date, 'price_target_change' AS event_type, CASE WHEN event_id % 2 = 0 THEN 'firm moves its target from $10.00 to $20.00' ELSE 'firm sets a target of $20.00' END AS text FROM events WHERE event_type = 'signup'")
def k02a(spark, d):
    rows = table(spark, d, "events").where("event_type = 'signup'")
    t = rows.select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("target_id"), F.col("user_id").alias("ticker"), F.lit("firm").alias("analyst_firm"), F.lit(20.0).alias("new_target"), F.when(F.col("event_id") % 2 == 0, 10.0).alias("prior_target"), F.to_date("ts").alias("action_date"))
    return U.targets(t).select("event_id", "ticker", "event_date", "event_type", "text")


@REG.add("K02e_news_events", "SELECT 'news_' || doc_id || '_' || lpad(k::varchar, 3, '0') AS event_id, t AS ticker, source, count(*) AS n FROM (SELECT doc_id, source, unnest(range(1, len(ps) + 1)) AS k, ps FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ps FROM documents)) q, (VALUES ('AAA'), ('BBB')) v(t) WHERE trim(ps[k], ' ') <> '' GROUP BY 1, 2, 3")
def k02e(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uuid"), F.array(F.lit("aaa"), F.lit("bbb")).alias("tickers"), F.lit("t").alias("title"), F.col("source").alias("publisher"), F.lit("2024-01-01").alias("report_date"), F.transform(F.split("text", "\n"), lambda p, i: F.struct((i + 1).alias("n"), p.alias("text"))).alias("paragraphs"))
    return U.news(rows).groupBy("event_id", "ticker", "source").agg(F.count(F.lit(1)).alias("n"))


@REG.add("K02i_delta_events", "SELECT '13f_delta_f_' || c_custkey || '_2024-02-14' AS event_id, c_custkey::varchar AS ticker, format('f {}: {}{:,} shares', CASE WHEN c_custkey % 2 = 0 THEN 'REDUCED' ELSE 'NEW' END, CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '+' END, (c_custkey + 1) * 37) AS text FROM customer")
def k02i(spark, d):
    sold = F.col("c_custkey") % 2 == 0
    rows = table(spark, d, "customer").select(F.lit("f").alias("fund"), F.col("c_custkey").alias("ticker"), F.lit("2024-02-14").alias("filing_date"), F.when(sold, "REDUCED").otherwise("NEW").alias("action"), ((F.col("c_custkey") + 1) * F.when(sold, -37).otherwise(37)).alias("shares_change"))
    return U.holding_deltas(rows).select("event_id", "ticker", "text")


@REG.add("K03a_latest_holdings", "SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate::date = (SELECT max(o_orderdate::date) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate::date <= date '1999-12-31')")
def k03a(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("filed"))
    return H.latest_period(rows, "o_custkey", "filed", F.lit("1999-12-31").cast("date")).select("o_custkey", "o_orderkey")


@REG.add("K03s_filing_chunks", "WITH n AS (SELECT doc_id, length(text) AS n, greatest(ceil((length(text) - 4000) / 3600.0)::int, 0) + 1 AS c FROM documents WHERE length(trim(text)) > 0) SELECT doc_id, least(c, 80)::bigint AS n_chunks FROM n")
def k03s(spark, d):
    """Pieces of a filing's sections, 80 of them at most (the source's cap)."""
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(T.char_chunks(F.col("text"))).alias("k", "piece"))
    return pieces.where("k < 80").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@REG.add("K06_chunk_assembly", "WITH a AS (SELECT doc_id, doc_id % 150 AS ticker, source, row_number() OVER (PARTITION BY doc_id % 150, source ORDER BY doc_id DESC) AS turn FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, doc_id % 150, 'legacy', row_number() OVER (PARTITION BY doc_id % 150 ORDER BY doc_id DESC) FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, row_number() OVER (PARTITION BY ticker ORDER BY turn, source)::int AS place FROM a")
def k06(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 150).alias("ticker"))
    legacy = docs.where("doc_id % 3 = 0").withColumn("source", F.lit("legacy"))
    every = V.override(docs, legacy, ["doc_id"])
    return V.interleave(every, "ticker", "source", "doc_id", "doc_id").select("doc_id", "place")


@REG.add("K21_baselines", BASE + " SELECT event_id, CASE WHEN abs(return_pct) >= 0.05 THEN -sign(return_pct) ELSE 0 END::int AS always_fade, sign(return_pct)::int AS always_lean FROM attr")
def k21(spark, d):
    from eventloom.operators.backtest import direction

    r = F.col("return_pct")
    return attributions(spark, d).select("event_id", direction(G.STRATEGIES["always_fade"](), r).alias("always_fade"), direction(F.lit("lean"), r).alias("always_lean"))


@REG.add("K28_pnl_card", BASE + " SELECT ticker, count(*) AS n_moves, round(sum(10000 * sign(return_pct) * CASE character WHEN 'structural' THEN 1 WHEN 'transient' THEN -1 ELSE 0 END * fwd_5d), 2) + 0.0 AS dollars FROM attr WHERE fwd_5d IS NOT NULL GROUP BY 1")
def k28(spark, d):
    from eventloom.operators.backtest import direction

    pnl = 10000 * direction(G.split_by_character(F.col("character")), F.col("return_pct")) * F.col("fwd_5d")
    return attributions(spark, d).where("fwd_5d is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("n_moves"), (F.round(F.sum(pnl), 2) + F.lit(0.0)).alias("dollars"))


@REG.add("K41_audit_jumps", with_(PANEL, SPLITS) + "SELECT ticker, date FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel) r WHERE abs(ret) > 2.0 AND NOT EXISTS (SELECT 1 FROM splits s WHERE s.ticker = r.ticker AND s.date = r.date)")
def k41(spark, d):
    return audit.unexplained_jumps(panel(spark, d), splits(spark, d), 2.0).select("ticker", "date")


@REG.add("K51_degenerate", "SELECT event_id, h[1:2] = h[3:4] AND h[1:2] = h[5:6] AS degenerate FROM (SELECT event_id, [substr(md5(event_id::varchar), i, 1) IN ('0', '1', '2', '3') FOR i IN range(1, 7)] AS h FROM events)")
def k51(spark, d):
    """Three dimensions of two citations each, drawn from the id's digest."""
    digit = lambda i: F.substring(F.md5(F.col("event_id").cast("string")), i, 1).isin("0", "1", "2", "3")
    lists = F.array(*[F.array(*[F.when(digit(i + j), "a").otherwise("b") for j in (0, 1)]) for i in (1, 3, 5)])
    return table(spark, d, "events").select("event_id", A.degenerate(lists).alias("degenerate"))


@REG.add("B08_bundles", with_(DATED) + "SELECT ticker, '[' || string_agg('{\"move_date\":\"' || event_date || '\",\"event_id\":' || event_id || ',\"session\":\"' || session || '\"}', ',' ORDER BY event_date, event_id, session) || ']' AS bundle FROM dated GROUP BY 1")
def b08(spark, d):
    from eventloom.sources.sinks import bundles

    return bundles(dated_events(spark, d).withColumnRenamed("event_date", "move_date").select("ticker", "move_date", "event_id", "session"))


@REG.add("D15_append_new_ids", "SELECT id, min(origin) AS origin FROM (SELECT o_custkey AS id, 'a' AS origin FROM orders UNION ALL SELECT c_custkey, 'b' FROM customer) GROUP BY 1")
def d15(spark, d):
    """Ids of the first source, then those of the second that it lacks."""
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("a"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).distinct().withColumn("origin", F.lit("b"))
    return a.unionByName(b.join(a, "id", "left_anti"))


@REG.add("G11_N_windowed_counts", "SELECT user_id AS ticker, ts::date AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def n01(spark, d):
    """The batch form of the windowed stream aggregate."""
    w = F.window("ts", "1 day")
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("ticker"), w).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select("ticker", F.to_date("window.start").alias("day"), "n", "value")


@REG.add("K33_framework_comparison", BASE + " SELECT character, count(*) AS n, round(avg(CASE WHEN sign(return_pct) = sign(fwd_5d) THEN 1.0 ELSE 0.0 END), 6) AS lean_hit, round(avg(CASE WHEN sign(return_pct) <> sign(fwd_5d) THEN 1.0 ELSE 0.0 END), 6) AS fade_hit FROM attr WHERE fwd_5d IS NOT NULL GROUP BY 1")
def k33(spark, d):
    same = F.signum("return_pct") == F.signum("fwd_5d")
    return attributions(spark, d).where("fwd_5d is not null").groupBy("character").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(same, 1.0).otherwise(0.0))).alias("lean_hit"), r6(F.avg(F.when(~same, 1.0).otherwise(0.0))).alias("fade_hit"))


@REG.add("K37a_payloads", "SELECT doc_id, 'doc_' || doc_id AS chunk_id, source AS source_type, (date '2024-01-01' + (doc_id % 300)::int)::varchar AS publication_date, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 600) || '…' END AS text FROM documents")
def k37a(spark, d):
    """Every document as a served page has it."""
    from eventloom.operators.payload import chunk_payload

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    chunks = table(spark, d, "documents").select("doc_id", F.format_string("doc_%d", "doc_id").alias("chunk_id"), F.col("source").alias("source_type"), day.alias("publication_date"), "text")
    return chunk_payload(chunks, "doc_id").select("doc_id", "chunk.chunk_id", "chunk.source_type", "chunk.publication_date", "chunk.text")
