"""Queries over texts: chunkers, cleaning, ids, sections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.plans.base import Registry, table

REG = Registry()

WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@REG.add("I01_word_chunks", f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), n AS (SELECT *, len(ws) AS n, greatest(ceil((len(ws) - 200) / 175.0)::int, 0) + 1 AS c FROM w WHERE len(ws) > 0), p AS (SELECT doc_id, ws, unnest(range(0, c)) AS k FROM n) SELECT doc_id, k::int AS k, array_to_string(ws[k * 175 + 1 : k * 175 + 200], ' ') AS piece FROM p")
def i01(spark, d):
    words = table(spark, d, "documents").select("doc_id", T.word_array(F.col("text")).alias("ws"))
    return words.select("doc_id", F.posexplode(T.word_chunks(F.col("ws"), 200, 25)).alias("k", "piece"))


@REG.add("I02_I23_token_estimate", f"SELECT doc_id, len({WORDS})::int AS words, floor(len({WORDS}) / 0.75)::int AS tokens FROM documents")
def i02(spark, d):
    n = T.word_count(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("words"), T.token_estimate(n).alias("tokens"))


@REG.add("I03_char_chunks", "WITH n AS (SELECT doc_id, text, greatest(ceil((length(text) - 1000) / 900.0)::int, 0) + 1 AS c FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, unnest(list_filter(list_transform(range(0, c), lambda k: trim(substr(text, k * 900 + 1, 1000), ' ')), lambda x: x <> '')) AS piece FROM n) SELECT doc_id, count(*)::int AS n, sum(length(piece))::bigint AS chars, md5(string_agg(md5(piece), '' ORDER BY md5(piece))) AS digest FROM p GROUP BY 1")
def i03(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.char_chunks(F.col("text"), 1000, 100).alias("p")).where(F.size("p") > 0)
    each = F.array_sort(F.transform("p", F.md5))
    return rows.select("doc_id", F.size("p").alias("n"), F.aggregate(F.transform("p", F.length), F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"), F.md5(F.array_join(each, "")).alias("digest"))


@REG.add("I04_I16_body", "SELECT doc_id, array_to_string(list_concat(CASE WHEN source <> 'src1' THEN [source] ELSE [] END, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')), chr(10) || chr(10)) AS body FROM documents")
def i16(spark, d):
    title = F.when(F.col("source") != "src1", F.col("source"))
    return table(spark, d, "documents").select("doc_id", T.body(title, F.split("text", "\n")).alias("body"))


@REG.add("I05_strip_html", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM pages")
def i05(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


CODED = "SELECT doc_id, text || ' Item ' || (doc_id % 8 + 1) || '.0' || (n_chars % 9 + 1) || '; ' || (n_chars % 12) || '.' || lpad((doc_id % 100)::varchar, 2, '0') || CASE WHEN doc_id % 3 = 0 THEN ' and 2.02 again 2.02' ELSE '' END AS t FROM documents"


@REG.add("I06_item_codes", f"SELECT doc_id, array_to_string(codes, ',') AS codes, list_has_any(codes, [{', '.join(repr(c) for c in T.ITEM_CODES)}]) AS relevant FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS codes FROM (SELECT doc_id, regexp_extract_all(t, '(\\d{{1,2}}\\.\\d{{2}})', 1) AS l FROM ({CODED})))")
def i06(spark, d):
    """Item numbers of whole texts, with numbers of all kinds put behind them."""
    k, n = F.col("doc_id"), F.col("n_chars")
    tail = F.concat(F.lit(" Item "), (k % 8 + 1).cast("string"), F.lit(".0"), (n % 9 + 1).cast("string"), F.lit("; "), (n % 12).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 3 == 0, " and 2.02 again 2.02").otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", T.item_codes(F.concat("text", tail)).alias("c"))
    return rows.select("doc_id", F.array_join("c", ",").alias("codes"), T.relevant_items(F.col("c")).alias("relevant"))


LABELS = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a, _ in T.SECTION_ALIASES) + "]"
SECTION = "CASE " + " ".join(f"WHEN t = '{a.replace(chr(39), chr(39) * 2)}' THEN '{n}'" for a, n in T.SECTION_ALIASES) + " " + " ".join(f"WHEN contains(t, '{a.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for a, n in T.SECTION_ALIASES) + " END"


@REG.add("I07_section_names", f"SELECT event_id, {SECTION} AS section FROM (SELECT event_id, lower(trim(CASE event_id % 4 WHEN 0 THEN '  ' || upper(alias) WHEN 1 THEN 'Part ' || user_id || ': ' || alias || ' ' || event_type WHEN 2 THEN event_type || ' ' || user_id ELSE alias END)) AS t FROM (SELECT *, ({LABELS})[event_id % {len(T.SECTION_ALIASES)} + 1] AS alias FROM events))")
def i07(spark, d):
    k, u, e = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type")
    alias = F.get(F.array(*[F.lit(a) for a, _ in T.SECTION_ALIASES]), (k % len(T.SECTION_ALIASES)).cast("int"))
    label = F.when(k % 4 == 0, F.concat(F.lit("  "), F.upper(alias))).when(k % 4 == 1, F.concat(F.lit("Part "), u, F.lit(": "), alias, F.lit(" "), e)).when(k % 4 == 2, F.concat(e, F.lit(" "), u)).otherwise(alias)
    return table(spark, d, "events").select("event_id", T.section_name(label).alias("section"))


@REG.add("I10_I12_keys", "SELECT c_custkey, regexp_replace(regexp_replace(upper(c_name || ' Holdings Inc'), '\\b(INC|HOLDINGS?)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') AS company, trim(regexp_replace(lower('  ' || c_name || '! '), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM customer")
def i10(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", T.company_key(F.concat(n, F.lit(" Holdings Inc"))).alias("company"), T.slug(F.concat(F.lit("  "), n, F.lit("! "))).alias("slug"))


TAG = r"nullif(regexp_extract({0}, '\$([A-Z][A-Z0-9\-.]{{0,6}})\b', 1), '')"


@REG.add("I09_I13_tags_and_dates", "SELECT page_id, coalesce(" + TAG.format("title") + ", " + TAG.format("body") + ") AS tag, CASE WHEN y <> '' THEN try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(CASE WHEN dd = '' THEN '1' ELSE dd END, 2, '0') AS date) END AS dated FROM (SELECT page_id, title, body, regexp_extract(u, '/(20\\d{2})/(\\d{1,2})(?:/(\\d{1,2}))?/', 1) AS y, regexp_extract(u, '/(20\\d{2})/(\\d{1,2})(?:/(\\d{1,2}))?/', 2) AS m, regexp_extract(u, '/(20\\d{2})/(\\d{1,2})(?:/(\\d{1,2}))?/', 3) AS dd FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Short $' || upper(substr(md5(url), 1, 4)) || ' now' ELSE url END AS title, html || CASE WHEN page_id % 4 = 1 THEN ' see $B' || page_id || ', and $X' ELSE '' END AS body, url || '/' || (1995 + page_id % 30) || '/' || (page_id % 14) || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '/' || (page_id % 33) || '/' END || 'post' AS u FROM pages))")
def i13(spark, d):
    k, url = F.col("page_id"), F.col("url")
    title = F.when(k % 3 == 0, F.concat(F.lit("Short $"), F.upper(F.substring(F.md5("url"), 1, 4)), F.lit(" now"))).otherwise(url)
    body = F.concat("html", F.when(k % 4 == 1, F.concat(F.lit(" see $B"), k.cast("string"), F.lit(", and $X"))).otherwise(""))
    link = F.concat(url, F.lit("/"), (1995 + k % 30).cast("string"), F.lit("/"), (k % 14).cast("string"), F.when(k % 2 == 0, "/").otherwise(F.concat(F.lit("/"), (k % 33).cast("string"), F.lit("/"))), F.lit("post"))
    return table(spark, d, "pages").select("page_id", T.cashtag(title, body).alias("tag"), T.date_in_url(link).alias("dated"))


@REG.add("I14_symbols", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(upper(regexp_replace(coalesce(text, ''), '[^ -~\n]', '', 'g')), '[,;\s]+'), lambda x: x <> ''), '|') AS symbols FROM documents")
def i14(spark, d):
    """Symbols of lists in text: here the plain letters of whole texts, whose words commas and spaces part."""
    plain = F.regexp_replace("text", r"[^ -~\n]", "")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.symbols(plain), "|").alias("symbols"))


@REG.add("I18_templates", "SELECT o_orderkey, format('${}{:,}.{}M', CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END, k // 10, k % 10) AS money, printf('%.1f%%', floor(o_totalprice / 1000)) AS percent FROM (SELECT o_orderkey, o_totalprice, floor(o_totalprice)::bigint AS k FROM orders)")
def i18(spark, d):
    value = F.floor("o_totalprice") * 100_000 * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)
    return table(spark, d, "orders").select("o_orderkey", T.money(value).alias("money"), T.percent(F.floor(F.col("o_totalprice") / 1000) / 100.0).alias("percent"))


KINDS = (*T.SOURCE_TYPES, "unknown", "13f_delta")


@REG.add("I20_I24_ids", "SELECT doc_id, t || '_' || source || '_' || printf('%03d', n_chars % 1500) AS chunk_id, CASE WHEN t IN (" + ", ".join(f"'{k}'" for k in T.SOURCE_TYPES) + ") THEN t END AS source_type FROM (SELECT *, ([" + ", ".join(f"'{k}'" for k in KINDS) + f"])[doc_id % {len(KINDS)} + 1] AS t FROM documents)")
def i20(spark, d):
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (F.col("doc_id") % len(KINDS)).cast("int"))
    c = T.chunk_id(kind, F.col("source"), (F.col("n_chars") % 1500).cast("int"))
    return table(spark, d, "documents").select("doc_id", c.alias("chunk_id"), T.source_of_id(c).alias("source_type"))


@REG.add("I22_previews", "SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 1, 220) AS preview FROM documents")
def i22(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@REG.add("J01_lenient_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate::date END AS d FROM orders")
def j01(spark, d):
    k, t = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(t, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(t, "MM/dd/yyyy")).when(k % 4 == 2, F.date_format(t, "MMMM d, yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", T.lenient_date(text).alias("d"))


@REG.add("J02_epoch_dates", "SELECT event_id, ts::date AS d FROM events")
def j02(spark, d):
    from eventloom.functions.dates import epoch_date

    return table(spark, d, "events").select("event_id", epoch_date(F.unix_timestamp("ts")).alias("d"))


@REG.add("J14_json", "SELECT event_id, (props->>'k')::bigint AS k, '{\"e\":' || event_id || ',\"v\":' || coalesce((props->>'k'), 'null') || '}' AS again FROM events")
def j14(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.select("event_id", "k", F.to_json(F.struct(F.col("event_id").alias("e"), F.col("k").alias("v")), {"ignoreNullFields": "false"}).alias("again"))


@REG.add("J16_paragraphs", "SELECT doc_id, k::int AS k, sym, para FROM (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS k, ps, unnest_sym AS sym, NULL AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents), (SELECT unnest(['A', 'B']) AS unnest_sym)) q, LATERAL (SELECT q.ps[q.k] AS para) WHERE trim(para, ' ') <> ''")
def j16(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "para"))
    ok = rows.where(F.trim("para") != "")
    return ok.select("doc_id", (F.col("i") + 1).alias("k"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("sym"), "para")


@REG.add("J20_section_machine", "WITH f AS (SELECT conv_id, turn, role, text, max((role = 'assistant')::int) OVER (PARTITION BY conv_id ORDER BY turn) AS qa FROM conversations) SELECT conv_id, CASE WHEN qa = 1 THEN 'qa' ELSE 'prepared' END AS section, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM f GROUP BY 1, 2")
def j20(spark, d):
    """Speeches are prepared until the first of the switching role; from there on they are questions and answers."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, d, "conversations").withColumn("section", F.when(F.max((F.col("role") == "assistant").cast("int")).over(w) == 1, "qa").otherwise("prepared"))
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t"))))
    return rows.groupBy("conv_id", "section").agg(F.array_join(F.transform(said, lambda x: x["t"]), "\n").alias("text"))


@REG.add("K07_news_fetch", "SELECT doc_id, sym, source FROM (SELECT doc_id, source, unnest(CASE WHEN doc_id % 2 = 0 THEN ['A' || (doc_id % 5), 'B'] ELSE ['C'] END) AS sym FROM documents) WHERE sym IN ('A0', 'A3', 'B')")
def k07(spark, d):
    k = F.col("doc_id")
    listed = F.when(k % 2 == 0, F.concat(F.lit("a"), (k % 5).cast("string"), F.lit(", b"))).otherwise("c")
    rows = table(spark, d, "documents").select("doc_id", "source", F.explode(T.symbols(listed)).alias("sym"))
    return rows.where(F.col("sym").isin("A0", "A3", "B")).select("doc_id", "sym", "source")
