"""Command line: list queries, run one, print the strategy report, or evaluate. Unknown names end with status 2, a gate that finds failures with 1."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query and show or write its result")
    run.add_argument("query")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="write Parquet there")
    run.add_argument("--rows", type=int, default=20)
    report = sub.add_parser("report", help="rank a strategy over all bundles against the baselines")
    report.add_argument("--data", required=True)
    report.add_argument("--strategy", default="fundamental_split")
    report.add_argument("--horizon", type=int, default=5)
    report.add_argument("--notional", type=float, default=10_000)
    report.add_argument("--plain", action="store_true", help="returns as they are, instead of those in excess of the market's")
    report.add_argument("--json", help="write the report as JSON there")
    check = sub.add_parser("evaluate", help="accuracy, matrix of bundles, calibration, or distribution of the attributions")
    check.add_argument("mode", choices=sorted(MODES))
    check.add_argument("--data", required=True)
    check.add_argument("--bundles", default="", help="matrix: these bundles only, separated by commas")
    check.add_argument("--gate", action="store_true", help="end with status 1 where the mode finds a failure")
    check.add_argument("--json", help="write the rows as JSON there")
    return p


#: Modes of evaluation: the query whose rows are shown, and the condition on a row that is a failure (None: it has no gate).
MODES = {
    "accuracy": ("K30_E14_accuracy", "accuracy < 1"),
    "matrix": ("K31_E15_D16_matrix", None),
    "calibration": ("K32_calibration_floor", "not passed"),
    "distribution": ("K34_flags", "true"),
}


def evaluate(spark, data: str, mode: str, bundles: str = "") -> tuple[list[dict], int]:
    """Rows of the mode (a row for each strategy, bundle or flag), and how many of them fail. Unknown bundles raise ValueError."""
    from pyspark.sql import functions as F

    from eventloom.operators.attribution import NOISE
    from eventloom.plans import catalog

    query, failure = MODES[mode]
    rows = catalog.queries()[query](spark, data)
    if mode == "matrix":
        ladder = list(NOISE)
        wanted = [b.strip() for b in bundles.split(",") if b.strip()]
        unknown = sorted(set(wanted) - set(ladder))
        if unknown:
            raise ValueError(f"unknown bundles {unknown}; known: {ladder}")
        rows = rows.withColumn("bundle", F.get(F.array(*[F.lit(b) for b in ladder]), F.col("rung")))
        rows = rows.where(F.col("bundle").isin(wanted)) if wanted else rows
    marked = rows.withColumn("_failed", F.expr(failure or "false"))
    found = [r.asDict() for r in marked.orderBy(*rows.columns).collect()]
    return [{k: v for k, v in r.items() if k != "_failed"} for r in found], sum(bool(r["_failed"]) for r in found)


def strategy_report(spark, data: str, strategy: str, horizon: int, notional: float, excess: bool = False) -> dict:
    """The ranked table (a row for each result) and its verdict."""
    from eventloom.operators import backtest
    from eventloom.plans.strategy import by_bundle

    results, _ = backtest.run_all(by_bundle(spark, data, excess), strategy, horizon, notional, use_excess=excess)
    table = backtest.compare(results).orderBy("position")
    rows = [r.asDict() for r in table.collect()]
    words = backtest.verdict(spark.createDataFrame(rows, table.schema)).first().asDict()
    return {"strategy": strategy, "horizon": horizon, "notional": notional, "excess": excess, **words, "table": rows}


def report_text(report: dict) -> str:
    columns = ["position", "label", "n_trades", "sharpe", "hit_rate", "avg_return", "max_drawdown", "dollars"]
    kind = "excess returns" if report["excess"] else "returns"
    lines = [f"# {report['strategy']} against the baselines", "", f"{kind} over {report['horizon']} days, {report['notional']:,.0f} dollars a trade", "", report["verdict"], ""]
    lines += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in report["table"]), ""])


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    from eventloom.functions.signals import STRATEGIES
    from eventloom.plans import catalog

    every = catalog.queries()
    if a.command == "list":
        print("\n".join(sorted(every)))
        return 0
    known = {"run": every, "report": STRATEGIES, "evaluate": MODES}[a.command]
    name = {"run": "query", "report": "strategy", "evaluate": "mode"}[a.command]
    name = getattr(a, name)
    if name not in known:
        print(f"unknown name {name!r}", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("eventloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "report":
        found = strategy_report(spark, a.data, a.strategy, a.horizon, a.notional, not a.plain)
        if a.json:
            Path(a.json).write_text(json.dumps(found, indent=1))
        print(report_text(found))
        return 0
    if a.command == "evaluate":
        try:
            lines, failed = evaluate(spark, a.data, name, a.bundles)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        if a.json:
            Path(a.json).write_text(json.dumps({"mode": name, "failed": failed, "rows": lines}, indent=1))
        print("\n".join(json.dumps(x) for x in lines))
        return int(a.gate and failed > 0)
    rows = every[name](spark, a.data)
    rows.write.mode("overwrite").parquet(a.out) if a.out else rows.show(a.rows, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
