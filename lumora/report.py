"""What a run leaves behind: run.json, leaderboard.csv, rows.csv, report.md."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.experiment import Run
from lumora.operators.evaluate import KEY, PRIMARY

MARKS = {"supported": "HELD", "refuted": "REFUTED", "inconclusive": "OPEN", "underpowered": "UNDERPOWERED"}


def payload(run: Run) -> dict:
    models = [{"model": r.model, "family": r.family, "metrics": r.metrics, "slices": r.by_slice, "fit_seconds": r.fit_seconds, "params": r.params, "error": r.error} for r in run.state.results.values()]
    return {"profile": run.profile, "models": models, "hypotheses": [h.__dict__ for h in run.state.hypotheses], "rounds": run.rounds, "notes": run.state.notes, "decision": run.decision, "stopped": run.stopped, "seconds": run.seconds}


def table(rows: list[dict]) -> str:
    """A Markdown table with the columns of the first row."""
    if not rows:
        return "(none)"
    show = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = list(rows[0])
    return "\n".join(f"| {' | '.join(cells)} |" for cells in [head, ["-"] * len(head), *([show(r.get(c)) for c in head] for r in rows)])


def board(run: Run) -> list[dict]:
    ok = sorted((r for r in run.state.results.values() if not r.error), key=lambda r: (-r.primary, r.model))
    at = lambda r, s: r.by_slice.get(s, {}).get(PRIMARY)
    return [{"model": r.model, PRIMARY: r.primary, "hit_at_10": r.metrics.get("hit_at_10"), "coverage_at_10": r.metrics.get("coverage_at_10"), **{s: at(r, s) for s in ("cold_in_vertical", "transfer_only", "tail_target")}, "fit_s": r.fit_seconds} for r in ok]


def markdown(run: Run) -> str:
    verdicts = [{"id": h.id, "slice": h.slice, "verdict": MARKS.get(h.verdict or "", "OPEN"), "evidence": h.evidence} for h in run.state.hypotheses]
    tests = [{"against": n, "delta": c.get("delta"), "low": c.get("ci_low"), "high": c.get("ci_high"), "n an arm": (c.get("power") or {}).get("required_n_per_arm")} for n, c in run.decision.get("comparisons", {}).items()]
    parts = [("Log", table([run.profile])), ("Hypotheses", table(verdicts)), ("Leaderboard", table(board(run))), ("Rounds", table(run.rounds)), (f"Decision: {run.decision.get('champion')}", table(tests))]
    notes = [*run.state.notes, *run.decision.get("conflicts", []), f"stopped: {run.stopped}"]
    return "\n\n".join(f"## {title}\n\n{text}" for title, text in parts) + "\n\n" + "\n".join(f"- {n}" for n in notes) + "\n"


def narrative(run: Run, writer: Callable[[dict], str] | None = None) -> str:
    """A readout in sentences: the writer's if it gives more than 200 characters, else from a template."""
    if writer is not None:
        text = writer(payload(run))
        if len(text or "") > 200:
            return text
    lines = [f"{run.profile.get('n_users')} users and {run.profile.get('n_items')} items were evaluated; the best model is {run.decision.get('champion')}."]
    lines += [f"{h.id} ({h.claim}): {MARKS.get(h.verdict or '', 'OPEN')}. {h.evidence}" for h in run.state.hypotheses]
    return "\n\n".join([*lines, *run.decision.get("conflicts", []), f"The run stopped: {run.stopped}."]) + "\n"


def save(spark: SparkSession, run: Run, folder: str) -> None:
    """Writes the small artefacts from the driver and 5,000 rows of the champion through Spark."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "run.json").write_text(json.dumps(payload(run), indent=2, default=str))
    (out / "report.md").write_text(markdown(run))
    (out / "narrative.md").write_text(narrative(run))
    rows = board(run)
    (out / "leaderboard.csv").write_text("\n".join(",".join(f'"{v}"' if isinstance(v, str) else "" if v is None else str(v) for v in r) for r in [list(rows[0]) if rows else [], *(r.values() for r in rows)]) + "\n")
    champion = run.state.results.get(run.decision.get("champion"))
    if champion is not None and champion.per_row is not None:
        champion.per_row.orderBy(*KEY).limit(5000).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/rows.csv")


def past_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, at, stopped, seconds, champion) of the runs under folder, newest first."""
    runs = spark.read.option("multiLine", True).schema("stopped string, seconds double, decision struct<champion:string>").json(f"{folder}/*/run.json")
    return runs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), "stopped", "seconds", "decision.champion").orderBy(F.desc("at"), "path")
