"""Attributions from a model provider: requests, retries, fallback, coherence review, perturbation.

A provider is a callable that gets a request (a dict with event_id, ticker, move_date, return_pct, body and
chunk_ids) and returns a dict: for each dimension weight, direction, rationale and cited ids, besides
move_character, confidence, predicted_return_pct and notes. It runs in the Python workers, a batch of
requests at a time with `concurrency` calls in flight; answers keep the order of requests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from eventloom.functions import prompts
from eventloom.functions.scoring import tag_weight
from eventloom.functions.signals import DIMENSIONS, dominant
from eventloom.operators.attribution import LADDER, by_bundle, sanitise
from eventloom.operators.relevance import filter_and_rank
from eventloom.sources.staging import read_through, staged

# Chunks of a request, ids that a stand-in cites, the id of a stand-in without chunks, the path that made an answer.
MAX_CHUNKS, STAND_IN_CITES, NO_CHUNKS = 30, 5, "no_chunks_provided_0"
LIVE, STAND_IN = "live", "placeholder"
#: Calls of one request, and the longest wait between two of them.
ATTEMPTS, MAX_DELAY = 4, 90.0

Provider = Callable[[dict], dict]


class Transient(Exception):
    """A failure that may pass: connection, time limit, overload. delay: seconds that the service asks for."""

    def __init__(self, message: str = "", delay: float | None = None):
        super().__init__(message)
        self.delay = delay


class InvalidAttribution(ValueError):
    """An answer that doesn't hold; the message joins what is wrong with it."""

    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


def call(provider: Provider, request: dict, attempts: int = ATTEMPTS, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The provider's answer; transient failures are tried again after growing waits, the last one is raised."""
    for k in range(attempts):
        try:
            return provider(request)
        except Transient as e:
            if k == attempts - 1:
                raise
            sleep(min(MAX_DELAY, e.delay if e.delay is not None else base * 2**k))
    raise AssertionError("attempts must be positive")


def missing(answer: dict) -> list[str]:
    """Names of what an answer leaves out."""
    return [d for d in DIMENSIONS if not isinstance(answer.get(d), dict)] + [k for k in ("move_character", "confidence") if answer.get(k) is None]


def complete(provider: Provider, request: dict, **how) -> dict:
    """An answer; a partial one is asked for once more, naming what it left out, and the fuller one counts."""
    first = call(provider, request, **how)
    if not (gaps := missing(first)):
        return first
    second = call(provider, request | {"nudge": "Answer in full. Left out: " + ", ".join(gaps)}, **how)
    return second if len(missing(second)) < len(gaps) else first


def check(answer: dict, request: dict, tolerance: float = 0.02) -> list[str]:
    """What is wrong with an answer: identity, ranges, empty rationales and citations, unknown ids, weights."""
    out = [f"{k} mismatch" for k in ("ticker", "move_date") if k in answer and str(answer[k]) != str(request[k])]
    if not 0 <= (answer.get("confidence") if answer.get("confidence") is not None else -1) <= 1:
        out.append("confidence out of range")
    total = 0.0
    for d in DIMENSIONS:
        x = answer.get(d) or {}
        total += x.get("weight", 0.0)
        if not (x.get("rationale") or "").strip():
            out.append(f"{d}: empty rationale")
        if not x.get("cited"):
            out.append(f"{d}: no citation")
        out += [f"{d}: unknown id {c!r}" for c in x.get("cited") or [] if c not in request["chunk_ids"]]
    if abs(total - 1) > tolerance:
        out.append(f"weights sum to {total:.4f}")
    return out


_TEXT, _LIST, _NUMBER = pa.string(), pa.list_(pa.string()), pa.float64()
ANSWER = pa.schema(
    [("event_id", pa.int64()), ("variant", _TEXT)]
    + [(f"{k}_{d}", kind) for d in DIMENSIONS for k, kind in (("w", _NUMBER), ("dir", _TEXT), ("cites", _LIST))]
    + [("character", _TEXT), ("confidence", _NUMBER), ("pred", _NUMBER), ("note", _TEXT), ("failed", _TEXT)]
)
REVIEW = pa.schema([("event_id", pa.int64()), ("plausible", pa.bool_()), ("issues", _LIST), ("reviewer_notes", _TEXT), ("failed", _TEXT)])


def answers(requests: DataFrame, provider: Provider, validate: bool = False, concurrency: int = 4, cache: str | None = None, **how) -> DataFrame:
    """A row for each request (event_id, variant, ticker, move_date, return_pct, body, chunk_ids); `failed` names the
    error of a call that came to nothing. With validate, an answer that doesn't hold is such a failure.

    cache: a table of answers that calls are read through (``staging.read_through``), keyed by move, variant and body, so
    a request is asked once over all runs; failures are kept out of it and asked again.
    """

    def one(request: dict) -> dict:
        out = {"event_id": request["event_id"], "variant": request["variant"]}
        try:
            a = complete(provider, request, **how)
            if validate and (found := check(a, request)):
                raise InvalidAttribution(found)
        except Exception as e:  # noqa: BLE001 - one move's failure is told in its row
            return out | {"failed": type(e).__name__}
        for d in DIMENSIONS:
            x = a.get(d) or {}
            out |= {f"w_{d}": float(x.get("weight", 0.0)), f"dir_{d}": x.get("direction", "neutral"), f"cites_{d}": list(x.get("cited") or [])}
        return out | {"character": a.get("move_character") or "unclear", "confidence": float(a["confidence"] if a.get("confidence") is not None else 0.5), "pred": a.get("predicted_return_pct"), "note": a.get("notes") or LIVE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pa.RecordBatch.from_pylist(list(pool.map(one, batch.to_pylist())), schema=ANSWER)

    fields = ["event_id", "variant", "ticker", "move_date", "return_pct", "body", "chunk_ids"]
    ask = lambda rows: rows.select(*fields).mapInArrow(run, from_arrow_schema(ANSWER))
    if cache is None:
        return ask(requests)
    keyed = requests.select(*fields, F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "variant", "body"), 256).alias("cache_key"))
    failed = []

    def fresh(rows: DataFrame) -> DataFrame:
        # an answer's move and variant are its request's, so its key is found again without asking twice
        new = staged(ask(rows), "asked").join(rows.select("event_id", "variant", "cache_key"), ["event_id", "variant"])
        failed.append(new.where("failed is not null").drop("cache_key"))
        return new.where("failed is null")

    held = read_through(keyed, fresh, cache).drop("cache_key")
    return held.select(*ANSWER.names).unionByName(failed[0].select(*ANSWER.names))


def evidence(moves: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each move with its best chunks, tagged by weight: ids, body, pool (all of its chunks), window_start, window_end.

    moves: event_id, ticker, move_date, return_pct. chunks: event_id, chunk_id, text, score, publication_date. The
    window ends with the move at the latest. A column pool of chunks says how many there are, where only the best are given.
    """
    given = "pool" in chunks.columns
    counted = chunks.groupBy("event_id").agg((F.first("pool") if given else F.count(F.lit(1))).alias("pool"))
    best = filter_and_rank(chunks, key="event_id", pool="pool" if given else None).where(F.col("rank") <= MAX_CHUNKS).drop("pool")
    tagged = best.withColumn("text", tag_weight(F.col("text"), F.col("score")))
    own = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    listed = tagged.groupBy("event_id").agg(own.alias("chunks"), F.min("publication_date").alias("_a"), F.max("publication_date").alias("_b"))
    rows = moves.join(listed, "event_id", "left").join(counted, "event_id", "left")
    none = F.array().cast("array<struct<rank:int,chunk_id:string,text:string>>")
    return rows.withColumns({"chunks": F.coalesce("chunks", none), "pool": F.coalesce("pool", F.lit(0)), "window_start": F.coalesce("_a", "move_date"), "window_end": F.least(F.coalesce("_b", "move_date"), "move_date")}).drop("_a", "_b")


def requests(rows: DataFrame, variant: str | Column = "base") -> DataFrame:
    """The request of each move with its chunks."""
    events = F.array().cast("array<struct<event_date:date,event_type:string,text:string>>")
    body = prompts.evidence_block(F.col("ticker").cast("string"), F.col("move_date"), F.col("return_pct"), events, F.col("chunks"))
    return rows.withColumns({"variant": F.lit(variant) if isinstance(variant, str) else variant, "body": body, "chunk_ids": F.transform("chunks", lambda c: c["chunk_id"])})


def attribute(moves: DataFrame, chunks: DataFrame | None, ablation: str, provider: Provider | None = None, gathered: DataFrame | None = None, **how) -> DataFrame:
    """An attribution of each move: the provider's where there is one and it has chunks to go by, else the seeded stand-in.

    Unknown ids are taken out of the provider's citations. The stand-in cites the first five chunks; so it does
    where a call fails. model_notes says which path made the answer and why, and how many chunks relevance kept.
    moves: event_id, ticker, move_date, return_pct, z. gathered: ``evidence``, where the caller has it already.
    """
    rows = requests(evidence(moves, chunks) if gathered is None else gathered)
    plain = by_bundle(moves.select("event_id", "return_pct", "z")).where(F.col("ablation") == ablation)
    cites = F.when(F.size("chunk_ids") > 0, F.slice("chunk_ids", 1, STAND_IN_CITES)).otherwise(F.array(F.lit(NO_CHUNKS)))
    base = rows.select("event_id", "ticker", "move_date", "return_pct", "pool", "chunk_ids", cites.alias("_cites")).join(plain.drop("return_pct", "z", "direction", "dominant", "rung", "score"), "event_id")
    if provider is None:
        live = None
        reason = F.lit("no provider")
    else:
        live = answers(rows.where(F.size("chunk_ids") > 0), provider, **how).drop("variant")
        own = {c: f"_{c}" for c in live.columns if c != "event_id"}
        base = base.join(live.withColumnsRenamed(own), "event_id", "left")
        reason = F.when(F.col("_failed").isNotNull(), F.concat(F.lit("live call failed ("), F.col("_failed"), F.lit(")"))).when(F.size("chunk_ids") == 0, "no chunks to ground the call")
    ok = F.lit(False) if live is None else F.col("_character").isNotNull()
    pick = lambda c: F.col(c) if live is None else F.when(ok, F.col(f"_{c}")).otherwise(F.col(c))
    out = {c: pick(c) for c in [*(f"w_{d}" for d in DIMENSIONS), "character", "confidence", "pred"]}
    dropped = F.lit(0)
    for d in DIMENSIONS:
        if live is None:
            out[f"cites_{d}"] = F.col("_cites")
        else:
            kept, gone = sanitise(F.col(f"_cites_{d}"), F.col("chunk_ids"))
            out[f"cites_{d}"] = F.when(ok, kept).otherwise(F.col("_cites"))
            dropped = dropped + F.when(ok, gone).otherwise(0)
    scrubbed = F.when(dropped > 0, F.format_string("scrubbed %d unknown ids", dropped))
    path = F.when(ok, F.lit(LIVE) if live is None else F.when(F.col("_note").startswith(LIVE), F.col("_note")).otherwise(F.concat(F.lit(f"{LIVE}: "), "_note"))).otherwise(F.concat(F.lit(f"{STAND_IN}: "), reason))
    filtered = F.when(F.size("chunk_ids") < F.col("pool"), F.format_string("kept %d of %d chunks", F.size("chunk_ids"), "pool"))
    done = base.withColumns(out | {"model_notes": F.concat_ws("; ", path, scrubbed, filtered), "is_live": ok})
    names = ["event_id", "ticker", "move_date", "return_pct", "ablation", *(f"w_{d}" for d in DIMENSIONS), *(f"cites_{d}" for d in DIMENSIONS), "character", "confidence", "pred", "is_live", "model_notes"]
    return done.withColumnRenamed("pool", "chunks_considered").select(*names, "chunks_considered").withColumn("dominant", dominant())


def cells(moves: DataFrame, chunks: DataFrame, provider: Provider, ladder: tuple[tuple[str, tuple[str, ...]], ...] = LADDER, cache: str | None = None, **how) -> DataFrame:
    """Every move under every bundle of sources, long: event_id, ablation, dimension, weight, direction, cites, failed.

    A cell is a move and a bundle; its request holds the best of the chunks whose source the bundle allows. A cell whose call fails,
    or that has no chunks, is one row with `failed` and no dimension, and costs no other cell. Bundles are constants, so rows
    are exploded; calls are read through the cache, if there is one.
    moves: event_id, ticker, move_date, return_pct; chunks: as of ``evidence``, with source_type.
    """
    rungs = F.array(*[F.struct(F.lit(n).alias("ablation"), F.lit(i).alias("rung"), F.array(*[F.lit(x) for x in s]).alias("sources")) for i, (n, s) in enumerate(ladder)])
    cell = (F.col("event_id") * len(ladder) + F.col("r.rung")).alias("cell")
    mine = moves.withColumn("r", F.explode(rungs)).select(F.col("event_id").alias("case_id"), cell, F.col("r.ablation").alias("ablation"), "ticker", "move_date", "return_pct")
    allowed = chunks.withColumn("r", F.explode(F.filter(rungs, lambda b: F.array_contains(b["sources"], F.col("source_type"))))).select(cell, "chunk_id", "text", "score", "publication_date")
    rows = evidence(mine.withColumnRenamed("cell", "event_id"), allowed.withColumnRenamed("cell", "event_id")).withColumn("event_id", F.col("case_id"))
    asked = requests(rows, F.col("ablation"))
    got = answers(asked.where(F.size("chunks") > 0), provider, cache=cache, **how)
    part = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(f"w_{d}").alias("weight"), F.col(f"dir_{d}").alias("direction"), F.col(f"cites_{d}").alias("cites"))
    none = F.struct(F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("array<string>").alias("cites"))
    long = got.withColumn("_p", F.explode(F.when(F.col("failed").isNull(), F.array(*[part(d) for d in DIMENSIONS])).otherwise(F.array(none))))
    empty = asked.where(F.size("chunks") == 0).withColumns({"_p": none, "failed": F.lit("no chunks")})
    names = [F.col("event_id"), F.col("variant").alias("ablation"), F.col("_p.dimension"), F.col("_p.weight"), F.col("_p.direction"), F.col("_p.cites"), F.col("failed")]
    return long.select(*names).unionByName(empty.select(*names))


def review_body(a: DataFrame) -> Column:
    """What a reviewer reads of an attribution and its chunks (columns as of ``attribute`` and ``evidence``): previews of 200 characters."""
    dims = [F.format_string(f"  - {d}: weight=%.2f cites=[%s]", F.col(f"w_{d}"), F.array_join(f"cites_{d}", ", ")) for d in DIMENSIONS]
    flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    short = lambda t: F.when(F.length(flat(t)) <= 200, flat(t)).otherwise(F.concat(F.substring(flat(t), 1, 199), F.lit("...")))
    head = F.format_string("PRICE MOVE: %s on %s returned %+.3f%%.", F.col("ticker").cast("string"), F.col("move_date").cast("string"), F.col("return_pct") * 100)
    said = F.format_string("Predicted return: %s\nmove_character=%s, confidence=%s", F.col("pred").cast("string"), "character", F.col("confidence").cast("string"))
    chunks = F.transform("chunks", lambda c: F.concat(F.lit('  - id="'), c["chunk_id"], F.lit('": '), short(c["text"])))
    listed = F.when(F.size("chunks") > 0, F.array_join(chunks, "\n")).otherwise("  (none)")
    return F.concat_ws("\n", head, said, F.lit("ATTRIBUTION:"), *dims, F.lit("AVAILABLE TEXT CHUNKS:"), listed)


def coherence(attributions: DataFrame, rows: DataFrame, reviewer: Callable[[dict], dict], **how) -> DataFrame:
    """A second opinion on each attribution: plausible, issues, reviewer_notes; `failed` names the error of a call without one.

    rows: ``evidence``. The reviewer gets event_id, body and chunk_ids and returns plausible, and maybe issues and notes.
    """
    asked = attributions.join(rows.select("event_id", "chunks"), "event_id").select("event_id", review_body(attributions).alias("body"), F.transform("chunks", lambda c: c["chunk_id"]).alias("chunk_ids"))

    def one(request: dict) -> dict:
        try:
            a = call(reviewer, request, **how)
            return {"event_id": request["event_id"], "plausible": bool(a["plausible"]), "issues": list(a.get("issues") or []), "reviewer_notes": a.get("notes"), "failed": None}
        except Exception as e:  # noqa: BLE001 - one review's failure is told in its row
            return {"event_id": request["event_id"], "plausible": None, "issues": [], "reviewer_notes": None, "failed": type(e).__name__}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in batch.to_pylist()], schema=REVIEW)

    return asked.mapInArrow(run, from_arrow_schema(REVIEW))


JUNK_ID = "news__JUNK_UNRELATED_junk_000"
JUNK_TEXT = "A maker of garden benches opened a second workshop and now sells plum jam. Neighbours liked the jam."


def perturbation(rows: DataFrame, provider: Provider, shuffle_tolerance: float = 0.15, junk_tolerance: float = 0.20, again_tolerance: float = 0.02, reviewer: Callable[[dict], dict] | None = None, cache: str | None = None) -> DataFrame:
    """Whether attributions of ``evidence`` rows hold when asked again, with chunks in another order, and with an unrelated chunk.

    One row per move and check (determinism, shuffle, junk): passed, reason, max_delta, junk_cited. Junk also
    passes if the reviewer finds the polluted answer implausible.
    """
    order = F.transform(F.array_sort(F.transform("chunks", lambda c: F.struct(F.md5(F.concat(F.lit("13|"), c["chunk_id"])).alias("h"), c.alias("c")))), lambda x: x["c"])
    junk = F.struct(F.lit(0).alias("rank"), F.lit(JUNK_ID).alias("chunk_id"), F.lit(JUNK_TEXT).alias("text"))
    # the evidence is gathered once and each move's four requests follow from it; answers are written before they are
    # compared, so each is asked for once whatever reads them, and the base that is compared is the one that is kept
    forms = [("base", F.col("chunks")), ("determinism", F.col("chunks")), ("shuffle", order), ("junk", F.concat("chunks", F.array(junk)))]
    four = rows.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("chunks")) for n, c in forms])))
    every = requests(four.withColumn("chunks", F.col("_v.chunks")), F.col("_v.name"))
    got = staged(answers(every, provider, cache=cache), "answers").withColumn("dominant", dominant())
    base = got.where("variant = 'base'").select("event_id", F.struct("dominant", "character", *(f"w_{d}" for d in DIMENSIONS)).alias("b"))
    both = got.where("variant <> 'base'").join(base, "event_id")
    delta = F.greatest(*[F.abs(F.col(f"w_{d}") - F.col(f"b.w_{d}")) for d in DIMENSIONS])
    cited = F.array_contains(F.flatten(F.array(*[F.col(f"cites_{d}") for d in DIMENSIONS])), JUNK_ID)
    limit = F.when(F.col("variant") == "shuffle", shuffle_tolerance).when(F.col("variant") == "junk", junk_tolerance).otherwise(again_tolerance)
    rows_ = both.withColumns({"max_delta": delta, "junk_cited": (F.col("variant") == "junk") & cited})
    why = F.concat_ws(
        "; ",
        F.when(F.col("failed").isNotNull(), F.concat(F.lit("call failed: "), "failed")),
        F.when(F.col("junk_cited"), F.lit("junk was cited")),
        F.when(F.col("dominant") != F.col("b.dominant"), F.concat(F.lit("dominant dimension flipped to "), "dominant")),
        F.when(F.col("character") != F.col("b.character"), F.concat(F.lit("character flipped to "), "character")),
        F.when(F.col("max_delta") > limit, F.lit("weights drift")),
    )
    out = rows_.withColumn("reason", why)
    caught = F.lit(False)
    if reviewer is not None:
        polluted = rows.withColumn("chunks", F.concat("chunks", F.array(junk)))
        known = got.where("variant = 'junk'").join(rows.select("event_id", "ticker", "move_date", "return_pct"), "event_id")
        seen = coherence(known, polluted, reviewer).select("event_id", F.lit("junk").alias("variant"), (~F.col("plausible")).alias("_caught"))
        out, caught = out.join(seen, ["event_id", "variant"], "left"), F.coalesce("_caught", F.lit(False))
    return out.select("event_id", F.col("variant").alias("check"), ((F.col("reason") == "") | caught).alias("passed"), "reason", "max_delta", "junk_cited")
