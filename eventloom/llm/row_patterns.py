"""Row pattern matching: a regular expression over each client's consecutive rows.

Rows are distinct, ordered by client, time and id, and dealt to tasks by ranges of that order (a
secondary sort), so a client with any share of all rows lies in as many tasks as it needs. Each
task streams its rows through a Pike machine: the pattern is a Thompson NFA whose threads stand in
order of priority and carry the register (cents at the row labelled with the register's letter) and
the labels so far, run-length coded. Every row starts a search of its own, so a match starts at each
row that has one, and the search goes on at the row after its first row.

Searches that are alive at a task's end go on in the next task's head: its first rows, as many as any
thread could live through. Heads are a handful of rows; one that covers its whole task passes the
searches on to the next round. Matches are numbered by sums over (client, task), never by a client's
rows in one task.

Defined results. A row without client or time is dropped; copies of a whole row count once, whatever
columns the table has; rows that tie in client, time and id are ordered by cents, kind and a digest
of the other columns, null first. Null, NaN and infinite values fit no letter. A null kind fits no letter that
looks at kinds; a null id is an id like others. An empty table gives no rows. Other columns take part in
the comparison of copies only. A letter that looks at the previous row fits no client's first row and
may not begin a match (ValueError). Labels have the length of the match.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import bound_batches, discard, staged

MATCH = -1


@dataclass(frozen=True)
class Letter:
    """What a row must be like: its kind, its cents against the previous row's (step), the time since that row, its cents against the register."""

    kinds: tuple[str, ...] = ()
    named: bool = False  # the kind isn't null
    not_kinds: tuple[str, ...] = ()
    step: int = 0  # -1 below the previous row's cents, 1 above
    within: int | None = None  # microseconds after the previous row at most
    at_least: bool = False  # cents are at least the register's

    @property
    def looks_back(self) -> bool:
        return bool(self.step) or self.within is not None


FIVE_MINUTES = 300_000_000
#: A fall, then a rise, ended by a click at or over the first row's cents.
VALLEY = "A D+ U+ P"
VALLEY_LETTERS = {
    "A": Letter(),
    "D": Letter(named=True, not_kinds=("error",), step=-1, within=FIVE_MINUTES),
    "U": Letter(named=True, not_kinds=("error",), step=1, within=FIVE_MINUTES),
    "P": Letter(kinds=("click",), within=FIVE_MINUTES, at_least=True),
}


@dataclass(frozen=True)
class Program:
    """letter: of each state that consumes a row; follow: the states (or MATCH) after it, best first; initial: those at the start."""

    letter: tuple[str, ...]
    follow: tuple[tuple[int, ...], ...]
    initial: tuple[int, ...]


def compile_pattern(pattern: str) -> Program:
    """Thompson's construction, then the ordered closure after each state. Letters, (), |, *, +, ?, {m,n} and lazy forms; spaces mean nothing."""
    text = "".join(pattern.split())
    letter: list[str] = []
    edges: list[list[int]] = []  # of a node: where it goes without a row, best first; a consuming node goes on to its one edge
    consumes: dict[int, int] = {}
    at = 0

    def node(*to: int) -> int:
        edges.append(list(to))
        return len(edges) - 1

    def one(state_letter: str, then: int) -> int:
        n = node(then)
        consumes[n] = len(letter)
        letter.append(state_letter)
        return n

    def parse_any():
        nonlocal at
        options = [parse_all()]
        while at < len(text) and text[at] == "|":
            at += 1
            options.append(parse_all())
        return options[0] if len(options) == 1 else lambda then: node(*[o(then) for o in options])

    def parse_all():
        parts = []
        while at < len(text) and text[at] not in "|)":
            parts.append(parse_repeated())

        def build(then: int) -> int:
            for p in reversed(parts):
                then = p(then)
            return then

        return build

    def parse_repeated():
        nonlocal at
        if text[at] == "(":
            at += 1
            part = parse_any()
            if text[at : at + 1] != ")":
                raise ValueError(f"unclosed group in {pattern!r}")
        elif text[at].isalpha():
            part = functools.partial(one, text[at])
        else:
            raise ValueError(f"unexpected {text[at]!r} in {pattern!r}")
        at += 1
        least, most = 1, 1
        if at < len(text) and text[at] in "*+?{":
            if text[at] == "{":
                low, _, high = text[at + 1 : (end := text.index("}", at))].partition(",")
                least, most = int(low), int(high) if high else (None if "," in text[at:end] else int(low))
                at = end
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[text[at]]
            at += 1
        lazy = text[at : at + 1] == "?"
        at += lazy
        order = (lambda inner, then: (then, inner)) if lazy else (lambda inner, then: (inner, then))

        def build(then: int) -> int:
            end = then
            if most is None:
                loop = node()
                edges[loop] = [*order(part(loop), then)]
                end = loop
            else:
                for _ in range(most - least):
                    end = node(*order(part(end), then))
            for _ in range(least):
                end = part(end)
            return end

        return build

    whole = parse_any()
    if at < len(text):
        raise ValueError(f"unexpected {text[at]!r} in {pattern!r}")
    end = node()
    start = whole(end)

    def closure(n: int, seen: set[int], out: list[int]) -> list[int]:
        if n not in seen:
            seen.add(n)
            if n == end or n in consumes:
                out.append(MATCH if n == end else consumes[n])
            else:
                for to in edges[n]:
                    closure(to, seen, out)
        return out

    nodes = sorted(consumes, key=consumes.__getitem__)
    initial = closure(start, set(), [])
    if MATCH in initial:
        raise ValueError(f"{pattern!r} fits no rows at all, so every row would start an empty match")
    return Program(tuple(letter), tuple(tuple(closure(edges[n][0], set(), [])) for n in nodes), tuple(initial))


class Machine:
    """The searches of one client's rows, in order of their starts. A search: [seq, first id, rows, cents, threads, best match].

    A thread is (state, register, labels); labels are (earlier labels, letter, count). Threads of one search in one
    state with one register go on alike, so the one of lower priority is dropped.
    """

    def __init__(self, program: Program, letters: dict[str, Letter], register: str) -> None:
        names = sorted(letters)
        self.bit = {x: 1 << i for i, x in enumerate(names)}
        self.names, self.letters = names, letters
        self.initial = program.initial
        self.states = [(self.bit[x], x, letters[x].at_least, x == register, f) for x, f in zip(program.letter, program.follow, strict=True)]
        self.start_bits = functools.reduce(int.__or__, (self.states[s][0] for s in self.initial))
        if any(letters[program.letter[s]].looks_back or letters[program.letter[s]].at_least for s in self.initial):
            raise ValueError("a letter that looks at the previous row or at the register can't begin a match")

    def masks(self, key: np.ndarray, ts: np.ndarray, cents: np.ndarray, valid: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Bits of the letters that each row but the first fits, as far as the row and the one before it tell; the first row is the one before."""
        out = np.zeros(len(key) - 1, np.int64)
        same = key[1:] == key[:-1]
        both = same & valid[1:] & valid[:-1]
        now = kind[1:]
        for name in self.names:
            x = self.letters[name]
            fits = valid[1:].copy()
            if x.kinds:
                fits &= np.isin(now, x.kinds)
            if x.named or x.not_kinds:
                fits &= (now != None) & ~np.isin(now, x.not_kinds)  # noqa: E711  elementwise
            if x.step:
                fits &= both & ((cents[1:] < cents[:-1]) if x.step < 0 else (cents[1:] > cents[:-1]))
            if x.within is not None:
                fits &= same & (ts[1:] - ts[:-1] <= x.within)
            out |= np.where(fits, self.bit[name], 0)
        return out

    def step(self, searches: list, bits: int, cents: int, row_id: int | None, done: list) -> list:
        """Feed one row to all searches; those that end go to done if they have a match. Returns the live ones."""
        live = []
        for s in searches:
            s[2] += 1
            s[3] += cents
            nxt: list = []
            for state, reg, labels in s[4]:
                bit, letter, at_least, keeps, follow = self.states[state]
                if not bits & bit or (at_least and (reg is None or cents < reg)):
                    continue
                if keeps:
                    reg = cents
                labels = (labels[0], letter, labels[2] + 1) if labels and labels[1] == letter else (labels, letter, 1)
                for to in follow:
                    if to == MATCH:
                        s[5] = (row_id, s[2], s[3], labels)
                        break
                    if all(x[0] != to or x[1] != reg for x in nxt):
                        nxt.append((to, reg, labels))
                else:
                    continue
                break  # threads of lower priority than a match are cut
            if nxt:
                s[4] = nxt
                live.append(s)
            elif s[5]:
                done.append(s)
        return live

    def start(self, seq: int, row_id: int | None) -> list:
        return [seq, row_id, 0, 0, [(s, None, None) for s in self.initial], None]

    def lives(self, states: set[int], bits: int | None) -> set[int]:
        """States that any register could be in after a row (bits None: a row that may fit every letter)."""
        return {to for s in states if bits is None or bits & self.states[s][0] for to in self.states[s][4] if to != MATCH}


def _runs(labels) -> list:
    out = []
    while labels:
        out.append([labels[1], labels[2]])
        labels = labels[0]
    return out[::-1]


def _labels(runs: list):
    out = None
    for letter, n in runs:
        out = (out, letter, n)
    return out


def _frozen(s: list, prev: tuple) -> str:
    """A live search as text, with the row that it last saw."""
    best = s[5] and [*s[5][:3], _runs(s[5][3])]
    return json.dumps({"n": s[2], "sum": s[3], "threads": [[a, b, _runs(c)] for a, b, c in s[4]], "best": best, "prev": prev})


def _thawed(seq: int, first: int | None, text: str) -> tuple[list, tuple]:
    x = json.loads(text)
    best = x["best"] and (*x["best"][:3], _labels(x["best"][3]))
    return [seq, first, x["n"], x["sum"], [(a, b, _labels(c)) for a, b, c in x["threads"]], best], tuple(x["prev"])


#: match: a match; search: one that is alive at the end of part - 1; row: a row of part's head; end: of a head, open (1) if the searches may go on after it.
STATE = pa.schema([("what", pa.string()), ("part", pa.int32()), ("key", pa.int64()), ("start_part", pa.int32()), ("seq", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()), ("sum_cents", pa.int64()), ("labels", pa.string()), ("ts", pa.int64()), ("kind", pa.string())])
STATE_SQL = "what string, part int, key long, start_part int, seq long, first_id long, last_id long, n_rows long, sum_cents long, labels string, ts long, kind string"


class _Out:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def matches(self, key: int, part: int, done: list) -> None:
        for s in done:
            last, n, cents, labels = s[5]
            self.rows.append(("match", None, key, part, s[0], s[1], last, n, cents, "".join(x * k for x, k in _runs(labels)), None, None))

    def searches(self, key: int, part: int, to: int, live: list, prev: tuple) -> None:
        self.rows += [("search", to, key, part, s[0], s[1], None, None, None, _frozen(s, prev), None, None) for s in live]

    def head(self, part: int, key: int, seq: int, row_id: int | None, cents: int | None, ts: int, kind: str | None) -> None:
        self.rows.append(("row", part, key, None, seq, row_id, None, None, cents, None, ts, kind))

    def end(self, part: int, is_open: bool) -> None:
        self.rows.append(("end", part, None, None, None, None, None, int(is_open), None, None, None, None))

    def batch(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), STATE, strict=True)], schema=STATE)


def _arrays(batch: pa.RecordBatch) -> tuple:
    ts = batch.column("ts")
    if not pa.types.is_int64(ts.type):
        ts = ts.cast(pa.timestamp("us", getattr(ts.type, "tz", None))).cast(pa.int64())
    valid = batch.column("cents").is_valid().to_numpy(zero_copy_only=False)
    cents = batch.column("cents").fill_null(0).to_numpy(zero_copy_only=False)
    kind = np.array(batch.column("kind").to_pylist(), dtype=object)
    return batch.column("key").to_numpy(zero_copy_only=False), ts.to_numpy(zero_copy_only=False), cents, valid, kind


def _scan(machine: Machine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of rows in order: its matches, the searches alive at its end, and its head."""
    part, out = TaskContext.get().partitionId(), _Out()
    searches: list = []
    prev = None  # arrays of the last row
    key, seq = None, 0
    ahead: set[int] | None = set(range(len(machine.states)))  # states that a search from before could be in; None once the head has ended
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _arrays(batch)
        first = prev is None
        if first:
            prev = tuple(x[:1] for x in now)
        joined = tuple(np.concatenate([a, b]) for a, b in zip(prev, now, strict=True))
        bits = machine.masks(*joined).tolist()
        if first:  # the row before isn't known here: no letter that looks back fits, which only searches from before could ask for
            bits[0] = sum(machine.bit[n] for n in machine.names if not machine.letters[n].looks_back) & bits[0]
        keys, tss, cents, valid, kinds = (x.tolist() for x in now)
        ids = batch.column("id").to_pylist()
        for i, k in enumerate(keys):
            if k != key:
                if key is not None:
                    out.matches(key, part, [s for s in searches if s[5]])
                    searches = []
                    if ahead is not None:
                        out.end(part, False)
                        ahead = None
                key = k
            b, c = bits[i], cents[i]
            if ahead is not None:
                out.head(part, k, seq, ids[i], c if valid[i] else None, tss[i], kinds[i])
                ahead = machine.lives(ahead, None if seq == 0 else b)
                if not ahead:
                    out.end(part, False)
                    ahead = None
            done: list = []
            if b & machine.start_bits:
                searches.append(machine.start(seq, ids[i]))
            if searches:
                searches = machine.step(searches, b, c, ids[i], done)
                if done:
                    out.matches(k, part, done)
            seq += 1
        prev = tuple(x[-1:] for x in now)
        yield from out.batch()
    if ahead is not None:
        out.end(part, True)
    if searches:
        k, ts, c, ok, kind = (x.tolist()[0] for x in prev)
        out.searches(key, part, part + 1, searches, (ts, c if ok else None, kind))
    yield from out.batch()


def _continue(machine: Machine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches and heads, each part's head first: the searches' matches, and those that live through an open head."""
    out = _Out()
    part, head, is_open = None, [], None
    for batch in batches:
        for x in batch.to_pylist():
            if x["part"] != part:
                part, head, is_open = x["part"], [], None
            if x["what"] == "row":
                head.append(x)
            elif x["what"] == "end":
                is_open = bool(x["n_rows"])
            else:
                live, (ts, c, kind) = _thawed(x["seq"], x["first_id"], x["labels"])
                live, done = [live], []
                own = [r for r in head if r["key"] == x["key"]]
                if own:
                    cents = np.array([c, *(r["sum_cents"] for r in own)], dtype=object)
                    valid = cents != None  # noqa: E711
                    cents[~valid] = 0
                    times = np.array([ts, *(r["ts"] for r in own)])
                    bits = machine.masks(np.zeros(len(cents), np.int64), times, cents.astype(np.int64), valid.astype(bool), np.array([kind, *(r["kind"] for r in own)], dtype=object))
                    for r, b in zip(own, bits.tolist(), strict=True):
                        if live:
                            live = machine.step(live, b, r["sum_cents"] or 0, r["first_id"], done)
                    ts, c, kind = own[-1]["ts"], own[-1]["sum_cents"], own[-1]["kind"]
                if live and is_open and len(own) == len(head):
                    out.searches(x["key"], x["start_part"], part + 1, live, (ts, c, kind))
                else:  # the client's rows end in or before this head
                    done += [s for s in live if s[5]]
                out.matches(x["key"], x["start_part"], done)
        yield from out.batch()


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with a client and a time, slim: key, ts, id, kind, cents and a digest of all the other columns."""
    value = F.col("value")
    cents = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.floor(100 * value + 0.5))
    used = ("client_id", "ts", "click_id", "kind", "value")
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in used]
    slim = rows.where(F.col("client_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("client_id").cast("long").alias("key"), "ts", F.col("click_id").cast("long").alias("id"), "kind", "value", (F.md5(F.to_json(F.struct(*rest))) if rest else F.lit("")).alias("rest")
    )
    return slim.distinct().select("key", "ts", "id", "kind", cents.alias("cents"), "rest")


def find_matches(rows: DataFrame, pattern: str = VALLEY, letters: dict[str, Letter] | None = None, register: str = "A") -> DataFrame:
    """client_id, match_no (from 1 in each client, by first row), first_id, last_id, n_rows, sum_cents, labels of every match.

    rows: client_id, ts, click_id, kind, value and any others. register: the letter whose cents `at_least` compares with.
    """
    spark, machine = rows.sparkSession, Machine(compile_pattern(pattern), letters or VALLEY_LETTERS, register)
    bound_batches(spark)
    order = ("key", "ts", "id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered_rows(rows).repartitionByRange(n, *order).sortWithinPartitions(*order, "cents", "kind", "rest").select(*order, "kind", "cents")
    found = staged(dealt.mapInArrow(functools.partial(_scan, machine), STATE_SQL), "row-patterns")
    heads = found.where("what IN ('row', 'end')")
    alive = found.where("what = 'search'")
    parts, more = [found.where("what = 'match'")], []
    while alive.take(1):
        by_part = heads.unionByName(alive).repartition(n, "part")
        # a part's head stands before the searches that enter it
        in_turn = by_part.sortWithinPartitions("part", F.expr("CASE what WHEN 'search' THEN 1 ELSE 0 END"), F.coalesce("seq", F.lit(-1)))
        again = staged(in_turn.mapInArrow(functools.partial(_continue, machine), STATE_SQL), "row-patterns-on")
        more.append(again)
        parts.append(again.where("what = 'match'"))
        alive = again.where("what = 'search'")
    every = functools.reduce(DataFrame.unionByName, parts)
    own = Window.partitionBy("key", "start_part").orderBy("seq")
    numbered = every.withColumn("_no", F.row_number().over(own))
    before = Window.partitionBy("key").orderBy("start_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = every.groupBy("key", "start_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # dealt by both keys, or the matches would be brought together by client
    out = numbered.join(counts.repartition(n, "key", "start_part"), ["key", "start_part"])
    result = staged(out.select(F.col("key").alias("client_id"), (F.col("_no") + F.col("_before")).cast("long").alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels"), "matches")
    discard(found, *more)
    return result


def digest_matches(clicks: DataFrame) -> DataFrame:
    """The matches of the valley pattern, their labels as a digest."""
    return find_matches(clicks).withColumn("labels_sha256", F.sha2("labels", 256)).drop("labels")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/clicks.parquet")


#: The same by windows: a fall is followed to its lowest row, the rise to its highest, and P is the row after the rise or the last click in it.
VALLEY_SQL = """
WITH r AS (
  SELECT client_id AS c, ts, click_id AS id, kind, CAST(floor(100 * value + 0.5) AS BIGINT) AS v,
         row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id, value, kind) AS i
  FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL
), s AS (
  SELECT *, lag(v) OVER w AS pv, ts - lag(ts) OVER w <= INTERVAL 5 MINUTE AS near, sum(coalesce(v, 0)) OVER (PARTITION BY c ORDER BY i) AS total
  FROM r WINDOW w AS (PARTITION BY c ORDER BY i)
), f AS (
  SELECT *, coalesce(near AND kind <> 'error' AND v < pv, false) AS d, coalesce(near AND kind <> 'error' AND v > pv, false) AS u,
         coalesce(near AND kind = 'click', false) AND v IS NOT NULL AS p
  FROM s
), e AS (
  SELECT *, min(CASE WHEN NOT d THEN i END) OVER after AS d_end, min(CASE WHEN NOT u THEN i END) OVER after AS u_end,
         max(CASE WHEN u AND kind = 'click' THEN i END) OVER (PARTITION BY c ORDER BY i) AS last_click, count(*) OVER (PARTITION BY c) AS n
  FROM f WINDOW after AS (PARTITION BY c ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), a AS (SELECT c, i, id, v, total, coalesce(d_end, n + 1) AS rise FROM e WHERE v IS NOT NULL AND coalesce(d_end, n + 1) > i + 1),
b AS (
  SELECT a.*, coalesce(e.u_end, e.n + 1) AS past FROM a JOIN e ON e.c = a.c AND e.i = a.rise AND e.u
), h AS (
  SELECT b.*, CASE WHEN x.p AND x.v >= b.v THEN b.past WHEN y.i > b.rise AND y.v >= b.v THEN y.i END AS stop
  FROM b LEFT JOIN e x ON x.c = b.c AND x.i = b.past
  JOIN e z ON z.c = b.c AND z.i = b.past - 1
  LEFT JOIN e y ON y.c = b.c AND y.i = z.last_click
)
SELECT h.c AS client_id, row_number() OVER (PARTITION BY h.c ORDER BY h.i) AS match_no, h.id AS first_id, t.id AS last_id,
       h.stop - h.i + 1 AS n_rows, CAST(t.total - h.total + h.v AS BIGINT) AS sum_cents,
       sha256('A' || repeat('D', CAST(h.rise - h.i - 1 AS BIGINT)) || repeat('U', CAST(h.stop - h.rise AS BIGINT)) || 'P') AS labels_sha256
FROM h JOIN e t ON t.c = h.c AND t.i = h.stop
"""
