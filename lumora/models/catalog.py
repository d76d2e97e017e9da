"""Models by kind."""

from __future__ import annotations

from lumora.models.base import Recommender
from lumora.models.bridge import CategoryBridge
from lumora.models.factor import LeastSquaresFactors, PairwiseFactors
from lumora.models.fusion import TwoStage
from lumora.models.neighbours import ItemNeighbours, Popularity
from lumora.models.sequence import Attention
from lumora.models.walk import GraphWalk

KINDS = {
    "popularity": Popularity, "item_knn": ItemNeighbours, "bpr_mf": PairwiseFactors, "als": LeastSquaresFactors, "graph_walk": GraphWalk, "cross_vertical_bridge": CategoryBridge,
    "sasrec": Attention, "sasrec_session": lambda **p: Attention(**{**p, "stale": False}), "two_stage": TwoStage,
}


def build(kind: str, params: dict | None = None, retrievers: list[Recommender] | None = None) -> Recommender:
    """A model that isn't fitted yet; KeyError for an unknown kind, ValueError for a second stage without retrievers."""
    if kind not in KINDS:
        raise KeyError(f"no model {kind!r}; there are {', '.join(sorted(KINDS))}")
    if kind == "two_stage":
        return TwoStage(retrievers or [], **(params or {}))
    return KINDS[kind](**(params or {}))
