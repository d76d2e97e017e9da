"""Document fingerprints: bottom-k sketches of hashes of word shingles.

A fingerprint is the base64 of its values, ascending, as little-endian unsigned 64-bit integers. Equal texts have equal
fingerprints, and the fingerprint of parts read one after another without shingles across them is the merge of theirs.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.text import bottom, overlap, shingles
from lumora.session import ship

K = 128
SHINGLE = 5


def sketches(texts: list[str], k: int = K, n: int = SHINGLE) -> list[np.ndarray]:
    """The bottom-k sketch of each text; a text without words has an empty one."""
    return [bottom(x, k) for x in shingles(pa.array(texts, pa.string()), n)]


def pack(sketch: np.ndarray) -> str:
    return b64encode(sketch.astype("<u8").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(b64decode(fingerprint), "<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard similarity, 0 to 1; two empty sketches are alike."""
    shared, size = overlap(a, b, k)
    return shared / size if size else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated count of distinct shingles; exact if the sketch isn't full."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            found = sketches([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(pack, found), pa.string()), pa.array(map(distinct, found), pa.float64())], ["doc_id", "fingerprint", "n_distinct"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_distinct) for each row of docs(doc_id, text); null, empty and blank texts have the empty one."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprint, "doc_id long, fingerprint string, n_distinct double")


def _after(column: str, bounds: list[int]):
    """How many of the ascending bounds the column reaches, by two short scans."""
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(x) for x in bounds[::step]]) if bounds else F.array().cast("array<bigint>")
    chunks = F.array(*[F.array(*[F.lit(x) for x in bounds[i : i + step]]) for i in range(0, len(bounds), step)]) if bounds else None
    if chunks is None:
        return F.lit(0)
    reached = F.size(F.filter(heads, lambda x: x <= F.col(column)))
    inside = F.size(F.filter(F.element_at(chunks, F.greatest(reached, F.lit(1))), lambda x: x <= F.col(column)))
    return F.when(reached > 0, (reached - 1) * step + inside).otherwise(0)


def in_order(docs: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """docs(doc_id, ...) ranged over partitions by doc_id, each range followed by the row that comes next, marked `ahead`.

    The ranges' bounds are doc_ids of the table, so the first row of each range is known beforehand and goes to the range before as well;
    the last range is followed by the first row. A null doc_id comes before all others.
    """
    low = -(1 << 63)
    docs = docs.select(*columns, F.coalesce("doc_id", F.lit(low)).alias("_key"))
    quantiles = [i / parts for i in range(1, parts)]
    least, bounds = docs.agg(F.min("_key"), F.percentile_approx("_key", quantiles or [0.5], 100_000)).first()
    if least is None:
        return docs.select(*columns, F.lit(0).alias("range"), F.lit(False).alias("ahead"))
    bounds = sorted({x for x in bounds if x > least}) if parts > 1 else []
    ranged = docs.withColumn("range", _after("_key", bounds))
    starts = F.col("_key").isin([least, *bounds])
    there = F.array(F.struct(F.col("range"), F.lit(False).alias("ahead")))
    before = F.array(F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds) + 1)).alias("range"), F.lit(True).alias("ahead")))
    ranged = ranged.withColumn("at", F.explode(F.when(starts, F.concat(there, before)).otherwise(there)))
    ranged = ranged.select(*columns, "_key", "at.range", "at.ahead")
    return ranged.repartition(max(1, parts // 4), "range").sortWithinPartitions("range", "ahead", "_key", "text").drop("_key")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # the row before, whose next isn't known yet
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows = held + list(zip(part.column("doc_id").to_pylist(), texts, sketches(texts), part.column("range").to_pylist(), part.column("ahead").to_pylist(), strict=True))
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[4]]
            edited = []
            for (_, text, *_), (_, after, *_) in pairs:
                n = len(text) // 4
                edited.append(text[: len(text) - n] + after[:n])
            changed = sketches(edited)
            held = rows[-1:]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([pack(a[2]) for a, _ in pairs], pa.string()),
                    pa.array([pack(x) for x in changed], pa.string()),
                    pa.array([resemblance(a[2], x) for (a, _), x in zip(pairs, changed, strict=True)], pa.float64()),
                    pa.array([resemblance(a[2], b[2]) for a, b in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare_edited(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text) its fingerprint, that of the text with its last quarter replaced by the beginning of the
    next document's (ascending doc_id, after the last the first), and their likeness.

    A null text is empty; an empty text's edited text is empty, and empty fingerprints are alike (1.0). Rows of one doc_id
    follow one another by text. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    ordered = in_order(docs, ["doc_id", "text"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compare, schema)
