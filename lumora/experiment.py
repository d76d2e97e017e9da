"""The experiment loop: plan a round, run its trials on Spark, judge, prune, and in the end decide."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from lumora.models.base import Recommender
from lumora.models.catalog import build
from lumora.operators.compare import compare, interleaving_test, power_analysis
from lumora.operators.dataset import Dataset
from lumora.operators.evaluate import Evaluation, best, evaluate, failed
from lumora.operators.online import split_test
from lumora.planner import Hypothesis, State, guardrails, judge, plan_round, prune, reconcile, resolve, should_stop
from lumora.session import cut

RETRIEVERS = ("item_knn", "bpr_mf", "graph_walk", "cross_vertical_bridge", "sasrec")


@dataclass
class Run:
    profile: dict
    state: State
    rounds: list[dict] = field(default_factory=list)
    decision: dict = field(default_factory=dict)
    stopped: str = ""
    seconds: float = 0.0


class Experiment:
    """models: fitted, by name; rows: the evaluation rows that all arms share."""

    def __init__(self, data: Dataset, max_rounds: int = 4, time_budget: float | None = None, seed: int = 0, advisor=None):
        self.data, self.max_rounds, self.time_budget, self.seed, self.advisor = data, max_rounds, time_budget, seed, advisor
        self.models: dict[str, Recommender] = {}
        self.rows = cut(data.eval_rows())

    def survivors(self, state: State, n: int = 3) -> list[Recommender]:
        """The best fitted model of each family of retrievers that is left, n at most."""
        tops = [best([r for r in state.results.values() if r.family == f]) for f in RETRIEVERS if f not in state.pruned]
        tops = sorted((t for t in tops if t is not None and t.model in self.models), key=lambda r: -r.primary)
        return [self.models[t.model] for t in tops[:n]]

    def trial(self, kind: str, params: dict, state: State) -> Evaluation:
        """Builds, fits and evaluates; what fails is recorded and the run goes on."""
        label = f"{kind}({params})"
        try:
            started = time.monotonic()
            model = build(kind, params, self.survivors(state) if kind == "two_stage" else None)
            label = model.name
            model.fit(self.data)
            fit = time.monotonic() - started
            found = evaluate(model, self.rows, self.data, params)
            found.fit_seconds = fit
            self.models[model.name] = model
            return found
        except Exception as error:
            state.notes.append(f"{label} failed: {type(error).__name__}: {str(error)[:200]}")
            return failed(label, kind, error)

    def judge(self, h: Hypothesis, state: State) -> None:
        treatment, control = resolve(h.treatment, state.results), resolve(h.control, state.results)
        if treatment is None or control is None:
            h.verdict, h.evidence = "inconclusive", "an arm has no result"
            return
        h.treatment, h.control = treatment, control
        h.comparison = compare(state.results[treatment].per_row, state.results[control].per_row, slice_name=h.slice, seed=self.seed)
        h.verdict, h.evidence = judge(h.comparison, h.bar)

    def run(self) -> Run:
        started = time.monotonic()
        profile = self.data.profile().first().asDict()
        run = Run(profile, State(profile))
        state, number = run.state, 1
        while True:
            plan = plan_round(number, state, self.max_rounds, self.advisor)
            if plan is None:
                run.stopped = "nothing left to plan"
                break
            for trial in plan.trials:
                if trial.kind not in state.pruned:
                    found = self.trial(trial.kind, trial.params, state)
                    state.results[found.model] = found
            for h in plan.hypotheses:
                self.judge(h, state)
            state.hypotheses += plan.hypotheses
            leader = best(list(state.results.values()))
            state.history.append(leader.primary if leader else 0.0)
            run.rounds.append({"round": number, "actions": plan.actions, "best": leader.model if leader else None, "pruned": prune(state), "guardrails": guardrails(state)})
            number += 1
            reason = should_stop(state, number, self.max_rounds)
            if reason is None and self.time_budget and time.monotonic() - started > self.time_budget:
                reason = "the time budget is used up"
            if reason:
                run.stopped = reason
                break
        run.decision = self.decide(state)
        run.seconds = time.monotonic() - started
        return run

    def decide(self, state: State) -> dict:
        """The champion against popularity and the best classical arm, in that order; online tests against the first."""
        champion = best(list(state.results.values()))
        if champion is None:
            return {}
        classical = best([r for r in state.results.values() if r.family in ("item_knn", "bpr_mf")])
        against = [n for n in ("popularity", classical.model if classical else None) if n in state.results and n != champion.model and not state.results[n].error]
        out: dict = {"champion": champion.model, "comparisons": {}, "conflicts": []}
        for name in against:
            arms = champion.per_row, state.results[name].per_row
            out["comparisons"][name] = compare(*arms, seed=self.seed) | {"power": power_analysis(*arms)}
        if against:
            tops = tuple(cut(self.models[name].top(self.rows)) for name in (champion.model, against[0]))
            out["interleaving"] = interleaving_test(*tops, seed=self.seed)
            if self.data.log is not None:
                out["split_test"] = split_test(*tops, self.data.log, seed=self.seed)
                if "error" not in out["split_test"]:
                    out["conflicts"] = reconcile(out["comparisons"][against[0]], out["interleaving"], out["split_test"])
        if "cross_vertical_bridge" in self.models:
            out["top_transfers"] = [r.asDict() for r in self.models["cross_vertical_bridge"].top_transfers(10).collect()]
        for name, model in self.models.items():
            if name.startswith("two_stage"):
                out.setdefault("importances", {})[name] = model.permutation_importances(self.rows)[:12]
        return out
