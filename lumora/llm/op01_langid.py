"""Language identification by words first, backing off to ever shorter character n-grams for unseen words.

A word that the model knows costs -log10 of its relative frequency in each language. Any other word is cut, between blanks, into
the longest n-grams of which the model knows at least one, and costs their mean. What a language never had
costs a fixed penalty. A text goes to the language with the least mean cost of its words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.session import cut, ship

SAMPLE_DOCS = 3000  # labelled texts of each language that the model is fitted on, about
MODEL_ENTRIES = 400_000  # words and n-grams in the model, of all languages and lengths, at most
LONGEST = 5  # characters of the longest n-grams
CACHE_TOKENS = 300_000  # tokens whose costs a worker keeps at a time
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    """costs[n]: of n-grams (n = 0: whole words), a row of costs by language."""

    languages: list[str]
    costs: list[dict[str, tuple[float, ...]]]
    penalty: list[float]

    def word_cost(self, word: str) -> tuple[float, ...]:
        found = self.costs[0].get(word)
        if found is not None:
            return found
        padded = f" {word} "
        for n in range(min(LONGEST, len(padded)), 0, -1):
            known, count = self.costs[n], len(padded) - n + 1
            grams = [x for i in range(count) if (x := known.get(padded[i : i + n])) is not None]
            if grams:
                missing = (count - len(grams)) * self.penalty[n]
                return tuple((sum(x) + missing) / count for x in zip(*grams, strict=True))
        return (self.penalty[1],) * len(self.languages)


def _words(token: str) -> list[str]:
    return [w for w in _LETTERS.findall(token) if any(map(str.isalpha, w))]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            tokens[lang].update(text.lower().split())
        for lang, counted in tokens.items():
            words: Counter = Counter()
            for token, n in counted.items():
                for w in _words(token):
                    words[w] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "gram", "n"])


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, entries: int = MODEL_ENTRIES) -> LanguageModel:
    """Fits a model on labelled(key, text, lang), rows with a null text or lang left out.

    The fit takes about `sample_docs` texts of each language, whole, chosen by a hash of key and text, and keeps the most frequent
    words and n-grams, `entries` in all. No labelled rows give a model without languages.
    """
    ship(labelled.sparkSession)
    labelled = labelled.select("key", "text", "lang").where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], [{} for _ in range(LONGEST + 1)], [0.0] * (LONGEST + 1))
    rate = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample_docs / sizes[lang])))])
    chosen = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)
    words = labelled.where(chosen).select("text", "lang").mapInArrow(_count_words, "lang string, gram string, n long")
    words = cut(words.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    padded = F.concat(F.lit(" "), "gram", F.lit(" "))
    grams = words.select("lang", F.lit(0).alias("length"), "gram", "n")
    for n in range(1, LONGEST + 1):
        pieces = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i, n=n: F.substring(padded, i, F.lit(n)))
        grams = grams.unionByName(words.where(F.length(padded) >= n).select("lang", F.lit(n).alias("length"), F.explode(pieces).alias("gram"), "n"))
    counted = cut(grams.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")))
    totals = {(r.lang, r.length): r.n for r in counted.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    quota = max(1, entries // (len(languages) * (LONGEST + 1)))
    frequent = Window.partitionBy("lang", "length").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= quota)
    penalty = [float(np.log10(2.0 * max([1, *(totals.get((lang, n), 0) for lang in languages)]))) for n in range(LONGEST + 1)]
    costs: list[dict] = [{} for _ in range(LONGEST + 1)]
    for r in top.select("lang", "length", "gram", "n").toLocalIterator():
        row = costs[r.length].setdefault(r.gram, [penalty[r.length]] * len(languages))
        row[languages.index(r.lang)] = -log10(r.n / totals[r.lang, r.length])
    return LanguageModel(languages, [{gram: tuple(row) for gram, row in known.items()} for known in costs], penalty)


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: LanguageModel = shared.value
    width = len(model.languages)
    rows, costs = {}, np.zeros((CACHE_TOKENS, width + 1))
    for batch in batches:
        langs, scores = [], []
        for text in batch.column("text").to_pylist():
            total = np.zeros(width + 1)
            tokens = (text or "").lower().split()
            for i in range(0, len(tokens), CACHE_TOKENS // 2):
                part = tokens[i : i + CACHE_TOKENS // 2]
                found = list(map(rows.get, part))
                if None in found:
                    if len(rows) + len(part) > CACHE_TOKENS:
                        rows.clear()
                        found = [None] * len(part)
                    for at, (token, row) in enumerate(zip(part, found, strict=True)):
                        if row is None and (row := rows.get(token)) is None:
                            words = _words(token)
                            row = rows[token] = len(rows)
                            costs[row] = (*(map(sum, zip(*map(model.word_cost, words), strict=True)) if words else [0.0] * width), len(words))
                        found[at] = row
                total += costs[found].sum(axis=0)
            if total[width] and width:
                mean = total[:width] / total[width]
                best = int(np.argmin(mean))
                langs.append(model.languages[best])
                scores.append(float(1 / np.sum(10 ** (mean[best] - mean))))
            else:
                langs.append(UNKNOWN)
                scores.append(0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs(text, ...) with lang_pred and score, from whole texts alone.

    score is the share of the language in the words' mean likelihoods, 0 to 1. A null or empty text, one without
    letters, and any text under a model without languages gets `und` and 0. Of languages that tie, the
    first by name wins. Repeated rows each come out, other columns pass
    through, columns of these two names are replaced, an empty table stays empty.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: _predict(batches, shared), f"{fields}, lang_pred string, score double")


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the column as text leaves `fold`; false where it is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
