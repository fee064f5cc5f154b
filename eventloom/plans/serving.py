"""Queries over attributions of a provider: evidence, answers, review, perturbation. The provider here counts words of its request."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.signals import DIMENSIONS
from eventloom.operators import provider as P
from eventloom.plans.base import MOVES, Registry, r6, table, with_
from eventloom.plans.evidence import G02, SCORED, best, scored
from eventloom.plans.strategy import LADDER_SQL
from eventloom.sources.staging import staged

REG = Registry()
EVIDENCE = "ev AS (SELECT k.move_id AS event_id, count(*) AS n, min(published) AS lo, max(published) AS hi, count(*) FILTER (src = 'news') AS n_news, count(*) FILTER (src = 'sec_10k') AS n_10k FROM kept k JOIN scores s ON s.move_id = k.move_id AND s.chunk_id = k.chunk_id WHERE rank <= 30 GROUP BY 1), pool AS (SELECT move_id AS event_id, count(*) AS pool FROM scores GROUP BY 1)"
CITED = "cited AS (SELECT move_id AS event_id, string_agg(chunk_id, ',' ORDER BY rank) FILTER (rank <= 2) AS two, string_agg(chunk_id, ',' ORDER BY rank) FILTER (rank <= 5) AS five FROM kept GROUP BY 1)"


def moves_and_chunks(spark, d):
    """Moves, and the best chunks of each; a chunk's text names its source."""
    from eventloom.plans.base import moves

    m = moves(spark, d).select(F.col("move_id").alias("event_id"), "ticker", "move_date", "return_pct", F.lit(0.0).alias("z"))
    c = best(spark, d).select(F.col("move_id").alias("event_id"), "chunk_id", F.concat(F.lit("from "), F.col("src")).alias("text"), "score", F.col("published").alias("publication_date"), "pool")
    return m, c


def word_counter(request: dict) -> dict:
    """A provider that needs no service: demand weighs 0.2 and what news there is, macro the rest; odd moves fail, and it
    cites one id that doesn't exist."""
    body = request["body"].split("CHUNKS", 1)[1]
    news, total = body.count("from news"), max(1, len(request["chunk_ids"]))
    if request["event_id"] % 5 == 0:
        raise ValueError("no answer")
    weight = 0.2 + 0.6 * news / total
    cites = [*request["chunk_ids"][:2], "made_up"]
    part = lambda w: {"weight": w, "direction": "neutral", "rationale": "counted", "cited": cites}
    return {"demand": part(weight), "pricing": part(0.0), "competitive": part(0.0), "management_credibility": part(0.0), "macro": part(1 - weight), "move_character": "structural" if news * 4 > total else "transient", "confidence": 0.5}


@REG.add("K11_evidence", with_(MOVES, SCORED, G02, EVIDENCE) + "SELECT m.move_id AS event_id, coalesce(n, 0)::int AS n, coalesce(pool, 0)::bigint AS pool, coalesce(lo, move_date) AS window_start, least(coalesce(hi, move_date), move_date) AS window_end FROM moves m LEFT JOIN ev ON ev.event_id = m.move_id LEFT JOIN pool ON pool.event_id = m.move_id")
def k11e(spark, d):
    return P.evidence(*moves_and_chunks(spark, d)).select("event_id", F.size("chunks").alias("n"), F.col("pool").cast("long").alias("pool"), "window_start", "window_end")


@REG.add(
    "K11_K12_attribute",
    with_(MOVES, SCORED, G02, EVIDENCE, CITED)
    + "SELECT m.move_id AS event_id, m.move_id % 5 <> 0 AND coalesce(n, 0) > 0 AS is_live, CASE WHEN m.move_id % 5 <> 0 AND n > 0 THEN round(0.2 + 0.6 * n_news / n, 6) END AS demand, CASE WHEN m.move_id % 5 <> 0 AND n > 0 THEN CASE WHEN n_news * 4 > n THEN 'structural' ELSE 'transient' END END AS character, coalesce(CASE WHEN m.move_id % 5 <> 0 THEN two ELSE five END, 'no_chunks_provided_0') AS cited, concat_ws('; ', CASE WHEN coalesce(n, 0) = 0 THEN 'placeholder: no chunks to ground the call' WHEN m.move_id % 5 = 0 THEN 'placeholder: live call failed (ValueError)' ELSE 'live' END, CASE WHEN m.move_id % 5 <> 0 AND n > 0 THEN 'scrubbed 5 unknown ids' END, CASE WHEN n < pool THEN 'kept ' || n || ' of ' || pool || ' chunks' END) AS model_notes FROM moves m LEFT JOIN ev ON ev.event_id = m.move_id LEFT JOIN pool ON pool.event_id = m.move_id LEFT JOIN cited ON cited.event_id = m.move_id",
)
def k11(spark, d):
    a = P.attribute(*moves_and_chunks(spark, d), "+sec", word_counter)
    live = lambda c: F.when(F.col("is_live"), c)
    return a.select("event_id", "is_live", live(r6("w_demand")).alias("demand"), live(F.col("character")).alias("character"), F.array_join("cites_demand", ",").alias("cited"), "model_notes")


def moody(request: dict) -> dict:
    """``word_counter`` with a model's weaknesses: asked again it says something else of every seventh move, and of every third
    it goes by what stands first."""
    out = word_counter(request)
    if request["event_id"] % 7 == 0 and request["variant"] == "determinism":
        out["move_character"] = "unclear"
    if request["event_id"] % 3 == 0:
        first = request["body"].split("from ", 1)[1].split("\n", 1)[0].split(" ", 1)[0].strip()
        lead = 0.9 if first.startswith("news") else 0.1
        out["demand"]["weight"], out["macro"]["weight"] = lead, 1 - lead
    return out


FIRST = "tops AS (SELECT k.move_id AS event_id, arg_min(src, rank) AS first_src, arg_min(src, md5('13|' || k.chunk_id)) AS mixed_src FROM kept k JOIN scores s ON s.move_id = k.move_id AND s.chunk_id = k.chunk_id WHERE rank <= 30 GROUP BY 1)"


@REG.add(
    "K36_perturbation",
    with_(MOVES, SCORED, G02, EVIDENCE, FIRST)
    + """SELECT ev.event_id, c AS "check", CASE c WHEN 'determinism' THEN ev.event_id % 7 <> 0
  WHEN 'shuffle' THEN ev.event_id % 3 <> 0 OR (first_src = 'news') = (mixed_src = 'news')
  ELSE (n_news * 4 > n) = (n_news * 4 > n + 1) AND (ev.event_id % 3 = 0 OR ((0.2 + 0.6 * n_news / n >= 0.5) = (0.2 + 0.6 * n_news / (n + 1) >= 0.5) AND 0.6 * n_news / n - 0.6 * n_news / (n + 1) <= 0.2)) END AS passed
FROM ev JOIN tops ON tops.event_id = ev.event_id, (VALUES ('determinism'), ('shuffle'), ('junk')) v(c) WHERE ev.event_id % 5 <> 0""",
)
def k36(spark, d):
    rows = P.evidence(*moves_and_chunks(spark, d)).where((F.col("event_id") % 5 != 0) & (F.size("chunks") > 0))
    return P.perturbation(rows, moody).select("event_id", "check", "passed")


def doubter(request: dict) -> dict:
    """A reviewer that finds fault with answers that lean on one dimension."""
    sure = "weight=0.8" in request["body"] or "weight=0.7" in request["body"]
    return {"plausible": not sure, "issues": ["leans on one dimension"] if sure else []}


@REG.add("K14_coherence", with_(MOVES, SCORED, G02, EVIDENCE) + "SELECT event_id, NOT (x >= 0.7 OR 1 - x >= 0.7) AS plausible, CASE WHEN x >= 0.7 OR 1 - x >= 0.7 THEN 1 ELSE 0 END::int AS n_issues FROM (SELECT event_id, 0.2 + floor(0.6 * n_news / n * 100 + 0.5) / 100 AS x FROM ev WHERE event_id % 5 <> 0)")
def k14(spark, d):
    m, c = moves_and_chunks(spark, d)
    every = staged(P.evidence(m, c), "evidence")
    rows = every.where((F.col("event_id") % 5 != 0) & (F.size("chunks") > 0))
    a = P.attribute(m, None, "+sec", word_counter, every).withColumns({f"w_{x}": F.round(f"w_{x}", 2) for x in DIMENSIONS})
    return P.coherence(a, rows, doubter).select("event_id", "plausible", F.size("issues").alias("n_issues"))


CELLS = f""", {LADDER_SQL},
cell AS (SELECT move_id, ablation, chunk_id, src, score FROM scores JOIN b ON list_contains(b.s, src)),
held AS (SELECT * FROM (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY move_id, ablation) AS n, count(*) FILTER (score >= 0.02) OVER (PARTITION BY move_id, ablation) AS good FROM cell WINDOW w AS (PARTITION BY move_id, ablation ORDER BY score DESC, chunk_id))
  WHERE rank <= 30 AND rank <= CASE WHEN n <= 5 THEN n ELSE least(least(50, greatest(5, round_even(n * 0.75, 0))), greatest(good, 5)) END),
fig AS (SELECT move_id, ablation, 0.2 + 0.6 * count(*) FILTER (src = 'news') / count(*) AS w FROM held GROUP BY 1, 2),
every AS (SELECT m.move_id, b.ablation, w FROM moves m CROSS JOIN b LEFT JOIN fig ON fig.move_id = m.move_id AND fig.ablation = b.ablation)
SELECT move_id AS event_id, ablation, dimension, round(CASE dimension WHEN 'demand' THEN w WHEN 'macro' THEN 1 - w ELSE 0.0 END, 6) + 0.0 AS weight, NULL::varchar AS failed
FROM every, (SELECT unnest(['demand', 'pricing', 'competitive', 'management_credibility', 'macro']) AS dimension) WHERE w IS NOT NULL AND move_id % 5 <> 0
UNION ALL SELECT move_id, ablation, NULL, NULL, CASE WHEN w IS NULL THEN 'no chunks' ELSE 'ValueError' END FROM every WHERE w IS NULL OR move_id % 5 = 0"""


@REG.add("K31a_K37a_cells", with_(MOVES, SCORED).rstrip() + CELLS)
def k31a(spark, d):
    from eventloom.plans.base import moves

    m = moves(spark, d).select(F.col("move_id").alias("event_id"), "ticker", "move_date", "return_pct")
    c = scored(spark, d).select(F.col("move_id").alias("event_id"), "chunk_id", F.concat(F.lit("from "), F.col("src")).alias("text"), "score", F.col("published").alias("publication_date"), F.col("src").alias("source_type"))
    return P.cells(m, c, word_counter).select("event_id", "ablation", "dimension", r6("weight").alias("weight"), "failed")
