"""Quality rules: text statistics in SQL expressions, and a learned decision list.

Statistics take words ``[^\\x20\\x09-\\x0D]+`` of whole texts. The list is learned by sequential covering:
a rule is a conjunction of thresholds that rejects; it grows on one part of the labelled statistics by
information gain, is pruned on the other part, and is kept while its precision there stays high. What
it covers is taken out and the next one grows. The rules become one ordered CASE expression.

Learning uses MAX_LABELLED labelled documents at most, chosen by hash. A doc_id counts once, however
often it is labelled or present; one with differing labels is left out. Statistics and verdicts are
built-in functions only. Null and empty texts have no words, so they fail the base rule. With no labels
the list is empty and the base rule decides. Rows are independent; repeated rows give repeated
results; only doc_id and text are read, other columns pass by under any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import agreed_labels

MAX_LABELLED = 8000
#: A rule's least precision and least number of covered rows, both on the rows that prune.
MIN_PRECISION, MIN_COVER = 0.95, 5
MAX_RULES, MAX_CONDITIONS, MAX_THRESHOLDS = 16, 4, 32

# The base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line with a word. Its parts give nothing back, so that blank lines of any length cost linear time.
LINE = r"(?<![^\n])[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*+"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "bang_share")


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and a struct `s` with the base counts (long) and the features (double) of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", text.alias("t"), F.array_remove(F.split(text, SPACE), "").alias("w"))
    n = F.size("w")
    # one step each, so that no array is computed for every element of another
    hashed = words.select("doc_id", "t", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    slices = [F.slice("h", k + 1, F.greatest(n - (WINDOW - 1), F.lit(0))) for k in range(WINDOW)]
    windows = hashed.select("doc_id", "t", "w", F.transform(F.arrays_zip(*slices), lambda x: F.xxhash64(x)).alias("v"))
    # most texts repeat no window; the others have theirs sorted, equal neighbours are the repeated ones
    repeats = F.size(F.array_distinct("v")) < F.size("v")
    ordered = windows.select("doc_id", "t", "w", F.when(repeats, F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("o"))
    m = F.size("o") - 1
    twins = F.zip_with(F.slice("o", 1, m), F.slice("o", 2, m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.when(F.col("o").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    placed = ordered.select("doc_id", "t", "w", at.alias("p"))
    k = F.size("p") - 1
    gaps = F.zip_with(F.slice("p", 1, k), F.slice("p", 2, k), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("p").isNotNull(), F.aggregate(gaps, F.lit(WINDOW), lambda a, b: a + b)).otherwise(0)
    counted = placed.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_extract_all("t", F.lit(LINE), F.lit(0)).alias("l"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_bang"),
    )
    lined = counted.withColumns({"n_lines": F.size("l").cast("long"), "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long")}).drop("l")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return lined.select(
        "doc_id",
        F.struct(
            *BASE,
            share("word_chars", "n_words").alias("mean_word"),
            share("n_symbols", "word_chars").alias("symbol_share"),
            share("n_dup_lines", "n_lines").alias("dup_line_share"),
            share("n_repeat_words", "n_words").alias("repeat_share"),
            share("n_distinct", "n_words").alias("distinct_share"),
            share("n_upper", "word_chars").alias("upper_share"),
            share("n_bang", "n_words").alias("bang_share"),
            # not deterministic, so that no filter on the struct is pushed below and repeats all of the above
            F.monotonically_increasing_id().alias("row"),
        ).alias("s"),
    )


def base_failed(s: Column | str = "s") -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, s: Column) -> Column:
        return s[self.feature] > self.threshold if self.above else s[self.feature] <= self.threshold


Rule = tuple[Condition, ...]
Example = tuple[dict[str, float], bool]  # features, and whether to reject


def _covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _thresholds(rows: list[Example], feature: str) -> list[float]:
    """Midpoints between neighbouring values, at most MAX_THRESHOLDS at even ranks of the rejected and the kept rows."""
    out = set()
    for side in (True, False):
        values = sorted({r[feature] for r, reject in rows if reject is side})
        step = max(1, len(values) // (MAX_THRESHOLDS // 2))
        out |= {values[i] for i in range(0, len(values), step)} | set(values[-1:])
    cuts = sorted(out)
    return [(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)]


def grow(rows: list[Example]) -> Rule:
    """Add the condition with the largest gain until no kept row is covered."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        p0 = sum(reject for _, reject in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, best_gain, best_rows = None, 1e-9, rows
        for feature in FEATURES:
            for threshold in _thresholds(rows, feature):
                up = [x for x in rows if x[0][feature] > threshold]
                p_up = sum(reject for _, reject in up)
                for above, p, n in ((True, p_up, len(up) - p_up), (False, p0 - p_up, n0 - len(up) + p_up)):
                    if p and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best_gain:
                        best, best_gain = Condition(feature, above, threshold), gain
        if best is None:
            break
        best_rows = [x for x in rows if best.holds(x[0])]
        rule, rows = (*rule, best), best_rows
    return rule


def _worth(rule: Rule, rows: list[Example]) -> tuple[float, int]:
    hit = [reject for r, reject in rows if _covers(rule, r)]
    return (sum(hit) / len(hit) if hit else 0.0), len(hit)


def prune(rule: Rule, rows: list[Example]) -> Rule:
    """The shortest leading part of the rule with the best precision."""
    tried = [(rule[:k], _worth(rule[:k], rows)) for k in range(1, len(rule) + 1)]
    return max(tried, key=lambda x: (x[1][0], -len(x[0])))[0] if tried else ()


def learn(examples: list[Example]) -> list[Rule]:
    """Ordered rules that reject. Every third example prunes, the others grow."""
    growing, pruning = [x for i, x in enumerate(examples) if i % 3], examples[::3]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and (rule := prune(grow(growing), pruning)):
        precision, cover = _worth(rule, pruning)
        if precision < MIN_PRECISION or cover < MIN_COVER:
            break
        rules.append(rule)
        growing, pruning = ([x for x in part if not _covers(rule, x[0])] for part in (growing, pruning))
    return rules


def verdict(rules: list[Rule], s: Column | str = "s") -> Column:
    """Number of the first rule that rejects, from 1 on; 0 if none does."""
    s = F.col(s) if isinstance(s, str) else s
    out = None
    for i, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(s)
        out = (out or F).when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labels' quality; texts that the base rule rejects aren't looked at."""
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = agreed_labels(labels, "quality").orderBy(order, "doc_id").limit(max_labelled)
    # at most max_labelled rows, so this side may be sent to every task
    rows = with_statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text"))
    known = rows.where(~base_failed()).select("doc_id", F.struct(*[F.col("s")[f].cast("double").alias(f) for f in FEATURES]).alias("x"))
    one = known.groupBy("doc_id").agg(F.min("x").alias("x"))  # of several texts of a doc_id the one with the least statistics
    found = one.join(F.broadcast(chosen), "doc_id").orderBy(order, "doc_id").collect()
    return learn([(r["x"].asDict(), r["quality"] == 0) for r in found])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and the number of the rule that rejected it."""
    s = F.col("s")
    rows = with_statistics(docs.select("doc_id", "text")).select("doc_id", "s", verdict(rules).alias("rule"))
    return rows.select("doc_id", *(s[c].alias(c) for c in BASE), base_failed().alias("base_failed"), (~base_failed() & (F.col("rule") == 0)).alias("kept"), F.when(base_failed(), 0).otherwise(F.col("rule")).alias("rule"))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with their own columns."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    marked = with_statistics(docs.select(row.alias("doc_id"), "text"))  # the row itself goes along in place of its id
    return marked.where(~base_failed() & (verdict(rules) == 0)).select("doc_id.*")
