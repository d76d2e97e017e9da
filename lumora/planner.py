"""What to try next, and what a result means: hypotheses registered in advance, verdicts, pruning, guardrails, stopping.

All of it is driver-side logic over a few dozen figures.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from lumora.operators.evaluate import PRIMARY, Evaluation, best

PLATEAU = 0.01
PRUNE_BELOW = 0.75
MIN_INFORMATIVE = 30
MIN_MULTI_VERTICAL_PCT = 15.0
MIN_MEDIAN_HISTORY = 4
SEQUENTIAL = frozenset({"sasrec", "sasrec_session"})


@dataclass
class Hypothesis:
    """treatment beats control on a slice by at least `bar` (relative; negative: does no more harm than that)."""

    id: str
    claim: str
    slice: str
    bar: float
    treatment: str
    control: str
    round: int = 0
    verdict: str | None = None
    evidence: str = ""
    comparison: dict = field(default_factory=dict)


@dataclass
class Trial:
    kind: str
    params: dict = field(default_factory=dict)


@dataclass
class Round:
    number: int
    actions: list[str]
    trials: list[Trial]
    hypotheses: list[Hypothesis]


@dataclass
class State:
    """What is known so far. profile: the dataset's figures; executed: actions that have been planned."""

    profile: dict
    results: dict[str, Evaluation] = field(default_factory=dict)
    hypotheses: list[Hypothesis] = field(default_factory=list)
    pruned: set[str] = field(default_factory=set)
    executed: set[str] = field(default_factory=set)
    notes: list[str] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def verdict(self, hypothesis: str) -> str | None:
        return next((h.verdict for h in self.hypotheses if h.id == hypothesis), None)


@dataclass(frozen=True)
class Action:
    """A set of trials with the hypotheses that they test, and the model families that must be left for it."""

    trials: tuple[tuple[str, dict], ...]
    hypotheses: tuple[tuple[str, str, str, float, str, str], ...]
    needs: frozenset[str] = frozenset()


#: Arms, slices and bars of the registered hypotheses.
ACTIONS: dict[str, Action] = {
    "baselines": Action(
        (("popularity", {}), ("item_knn", {"top_k": 150}), ("bpr_mf", {"factors": 64}), ("graph_walk", {"cross_vertical": False, "use_metadata": False, "walk_length": 3})),
        (("H1-personalization", "personal rankings beat popularity", "all", 0.10, "@best_personal", "popularity"),),
    ),
    "cross_vertical_ablation": Action(
        (("graph_walk", {"cross_vertical": True, "use_metadata": False, "walk_length": 3}), ("cross_vertical_bridge", {})),
        (
            ("H2-transfer", "edges across verticals help users who are cold here and active elsewhere", "transfer_only", 0.05, "graph_walk(xvert,L=3)", "graph_walk(within,L=3)"),
            ("H2b-no-harm", "edges across verticals do not harm users of one vertical", "single_vertical_user", -0.02, "graph_walk(xvert,L=3)", "graph_walk(within,L=3)"),
        ),
        frozenset({"graph_walk", "cross_vertical_bridge"}),
    ),
    "graph_depth_and_kg": Action(
        (("graph_walk", {"walk_length": 3}), ("graph_walk", {"walk_length": 5})),
        (("H3-kg", "attribute edges help items of the tail", "tail_target", 0.05, "graph_walk(xvert+kg,L=3)", "graph_walk(xvert,L=3)"),),
        frozenset({"graph_walk"}),
    ),
    "sequential": Action(
        (("sasrec", {"use_vertical": True}), ("sasrec", {"use_vertical": False})),
        (
            ("H4-attention", "attention over the sequence beats the best retriever that has none", "all", 0.03, "sasrec(+vert)", "@best_retriever"),
            ("H4b-vertical-context", "knowing each event's vertical helps where transfer is all there is", "transfer_only", 0.03, "sasrec(+vert)", "sasrec(no-vert)"),
        ),
        frozenset({"sasrec"}),
    ),
    "fusion": Action(
        (("two_stage", {"use_transfer_features": True}), ("two_stage", {"use_transfer_features": False})),
        (
            ("H5-fusion", "a learned second stage beats its best input", "all", 0.02, "@best_two_stage", "@best_retriever"),
            ("H5b-transfer-features", "history elsewhere helps inside the second stage", "transfer_only", 0.02, "two_stage(+transfer)", "two_stage(no-transfer)"),
        ),
        frozenset({"two_stage"}),
    ),
    "session_adaptation": Action(
        (("sasrec_session", {"use_vertical": True}),),
        (("H6-session", "encoding the newest events at request time beats a frozen representation", "all", 0.02, "sasrec_session(+vert)", "sasrec(+vert)"),),
        frozenset({"sasrec", "sasrec_session"}),
    ),
}


def choose_actions(number: int, state: State) -> tuple[list[str], list[str]]:
    """(actions, notes) of the rules for a round; nothing is changed."""
    profile, alive = state.profile, "sasrec" not in state.pruned
    if number == 1:
        return ["baselines"], []
    if number == 2:
        share = profile.get("multi_vertical_user_pct") or 0
        if share >= MIN_MULTI_VERTICAL_PCT:
            return ["cross_vertical_ablation"], []
        return ["sequential"], [f"no cross-vertical ablation: {share:.1f}% of users touch two verticals"]
    if number == 3:
        chosen = ["graph_depth_and_kg"] if state.verdict("H2-transfer") == "supported" else []
        if (profile.get("median_history") or 0) >= MIN_MEDIAN_HISTORY and alive:
            chosen.append("sequential")
        return chosen or ["graph_depth_and_kg"], []
    if number == 4:
        return ["fusion"] + ["session_adaptation"] * bool(profile.get("has_sessions") and alive), []
    return [], []


def advised(number: int, state: State, rules: list[str], advisor: Callable[[int, State, list[str]], list[str]] | None) -> list[str]:
    """Up to two known actions that an advisor names from round 2 on; the rules' where it fails or names none."""
    if advisor is None or number <= 1:
        return rules
    try:
        named = [a for a in advisor(number, state, rules) if a in ACTIONS][:2]
    except Exception as error:
        state.notes.append(f"the advisor failed in round {number}: {type(error).__name__}")
        return rules
    return named or rules


def plan_round(number: int, state: State, max_rounds: int, advisor=None) -> Round | None:
    """The next round, or None past the budget or without actions; its actions count as executed from here on."""
    if number > max_rounds:
        return None
    rules, notes = choose_actions(number, state)
    actions = advised(number, state, rules, advisor)
    if not actions:
        return None
    state.notes += notes
    state.executed.update(actions)
    trials = [Trial(kind, dict(params)) for a in actions for kind, params in ACTIONS[a].trials]
    return Round(number, actions, trials, [Hypothesis(*h, round=number) for a in actions for h in ACTIONS[a].hypotheses])


def resolve(name: str, results: dict[str, Evaluation]) -> str | None:
    """The arm that a name or a placeholder stands for; a partial name counts if just one arm has all its words."""
    ok = {n: r for n, r in results.items() if not r.error}
    if name in ok:
        return name
    pools: dict[str, Callable[[Evaluation], bool]] = {
        "@best_personal": lambda r: r.family != "popularity",
        "@best_retriever": lambda r: r.family not in SEQUENTIAL | {"popularity", "two_stage"},
        "@best_two_stage": lambda r: r.family == "two_stage",
    }
    if name in pools:
        found = best([r for r in ok.values() if pools[name](r)])
        return found.model if found else None
    words = lambda n: set(n.replace("(", ",").replace(")", "").split(","))
    alike = [n for n in ok if words(name) <= words(n)]
    return alike[0] if len(alike) == 1 else None


def judge(comparison: dict, bar: float) -> tuple[str, str]:
    """(verdict, evidence) of a paired comparison: the whole relative interval against the bar."""
    n, informative = comparison.get("n", 0), comparison.get("n_informative", 0)
    if informative < MIN_INFORMATIVE:
        return "underpowered", f"{informative} of {n} rows are ranked in the top 10 by either arm"
    low, high = comparison["rel_ci_low"], comparison["rel_ci_high"]
    verdict = "supported" if low > 100 * bar else "refuted" if high < 100 * bar else "inconclusive"
    return verdict, f"{comparison['rel_lift_pct']:+.1f}%, 95% CI [{low:+.1f}%, {high:+.1f}%], n={n} ({informative} informative), bar {100 * bar:+.0f}%"


def protected(state: State) -> set[str]:
    """Families that actions still to come need as arms."""
    return {f for name, action in ACTIONS.items() if name not in state.executed for f in action.needs}


def prune(state: State) -> list[str]:
    """Drops families whose best is far below the leader; never the leader's, nor a protected one."""
    leader = best(list(state.results.values()))
    if leader is None or leader.primary <= 0:
        return []
    out, kept = [], protected(state) | state.pruned | {leader.family}
    for family in sorted({r.family for r in state.results.values() if not r.error} - kept):
        top = best([r for r in state.results.values() if r.family == family])
        if top.primary < PRUNE_BELOW * leader.primary:
            state.pruned.add(family)
            out.append(f"pruned {family}: {PRIMARY} {top.primary:.4f} against {leader.primary:.4f}")
    return out


def guardrails(state: State) -> list[str]:
    """Warns where the leader shows little more of the catalogue than popularity does."""
    leader = best(list(state.results.values()))
    floor = state.results["popularity"].metrics.get("coverage_at_10", 0.0) if "popularity" in state.results else 0.0
    coverage = leader.metrics.get("coverage_at_10", 1.0) if leader else 1.0
    return [f"{leader.model} shows {100 * coverage:.1f}% of the items, popularity {100 * floor:.1f}%"] if coverage < max(0.05, 1.2 * floor) else []


def should_stop(state: State, next_round: int, max_rounds: int) -> str | None:
    """Why to stop, or None; a plateau alone is no reason while an action hasn't run."""
    if next_round > max_rounds:
        return f"the budget of {max_rounds} rounds is used up"
    if any(a not in state.executed for a in choose_actions(next_round, state)[0]):
        return None
    before, now = ([*state.history[-2:], 0.0, 0.0])[:2] if len(state.history) >= 2 else (0.0, 0.0)
    if before > 0 and (now - before) / before < PLATEAU:
        return f"plateau: {PRIMARY} went from {before:.4f} to {now:.4f}, and every action has run"
    return "no hypothesis is left to test"


def reconcile(offline: dict, interleaving: dict, online: dict) -> list[str]:
    """Where offline, interleaving and split test disagree, or the split test is too small to tell."""
    out = []
    sign = lambda x: (x > 0) - (x < 0)
    if sign(interleaving["abs_lift"]) != sign(online["abs_lift"]):
        out.append("CONFLICT: interleaving and the split test point in opposite directions")
        if (online.get("slate_utility_treatment") or 0) < (online.get("slate_utility_control") or 0):
            out[-1] += "; the treatment's slates are worth less as a whole"
    elif offline.get("significant") and not online["significant"]:
        out.append(f"UNDERPOWERED: offline is significant, the split test would need {online.get('required_n_per_arm')} units an arm")
    return out
