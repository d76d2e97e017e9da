"""What every recommender offers."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from lumora.operators.dataset import Dataset
from lumora.operators.evaluate import rank_by_popularity, rank_targets, top_by_popularity, top_lists


class Recommender(ABC):
    """fit on a dataset's train part; score gives long scores of evaluation rows.

    Scores of seen items stay in: only `operators.evaluate.mask_seen` masks. dense tells that every candidate has a score; sparse
    scores leave out zeros. Scores of popularity are None: they are ranked from counts alone.
    """

    family = ""
    dense = False

    @property
    @abstractmethod
    def name(self) -> str: ...

    @abstractmethod
    def fit(self, data: Dataset) -> Recommender: ...

    @abstractmethod
    def score(self, rows: DataFrame) -> DataFrame | None:
        """(user_id, target, vertical, item_id, score) of evaluation rows against the candidates of their vertical."""

    def rank(self, rows: DataFrame) -> DataFrame:
        """rows with the pessimistic rank of their target."""
        scores = self.score(rows)
        return rank_by_popularity(rows, self.data) if scores is None else rank_targets(rows, scores, self.data, self.dense)

    def top(self, rows: DataFrame, k: int = 10) -> DataFrame:
        """(user_id, target, vertical, item_id, score, place): the k best candidates of each row that aren't masked."""
        scores = self.score(rows)
        return top_by_popularity(rows, self.data, k) if scores is None else top_lists(scores, self.data, k)
