"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased and stripped of all that is no letter or digit. Features are single words,
their beginnings of five to seven letters (compounds), pairs of neighbours and pairs with one word
between, hashed to 2 ** 20 places; a feature counts one plus the logarithm of how often it occurs.
Every coordinate has its own learning rate, and L1 keeps most weights at zero, so that what is sent to
the tasks that score is a short list of places and weights.

The classifier is fitted by one task on a bounded sample of labelled rows, at most about ``rows`` of
them, chosen by a hash of their key; their texts alone are shuffled. Scoring reads every text once,
whole, and needs no shuffle.

Null and empty texts get the score of the constant alone. Labels that are null, and labelled keys
without a document, are not learned from; a key with several labels counts once, toxic if one
says so. Without labels of both kinds every score is the share of toxic rows (0 without any). Repeated rows are scored alike.
Other columns are kept or left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardtable.llm.common import col, map_text, small_batches

PLACES = 1 << 20
BEGINNINGS = (5, 6, 7)
#: About so many labelled rows are learned from, whatever the size of the table.
SAMPLE_ROWS = 6_000
#: Words whose hashes a worker keeps, some 25 MB; common words come early.
REMEMBERED = 60_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_PLAIN = re.compile(r"[\W_]+").sub


class _Words(dict):
    """Hashes of a word and of its beginnings, by the raw word; the first ``REMEMBERED`` words are kept."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        word = _PLAIN("", raw.lower())
        found = (0,) * (1 + len(BEGINNINGS))
        if word:
            starts = [xxhash.xxh64_intdigest(f"{n}{word[:n]}") if len(word) > n else 0 for n in BEGINNINGS]
            found = (xxhash.xxh64_intdigest(word), *starts)
        if len(self) < REMEMBERED:
            self[raw] = found
        return found


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) and values of a text's features."""
    raw = text.split()
    if not raw:
        return np.zeros(0, "i8"), np.zeros(0)
    hashes = np.array(list(map(_words().__getitem__, raw)), dtype="u8")
    hashes = hashes[hashes[:, 0] != 0]
    one = hashes[:, 0]
    pairs = (one[:-1] * _MIX + one[1:]) * _ODD
    skips = (one[:-2] * _ODD + one[2:]) * _MIX
    starts = hashes[:, 1:].ravel()
    every = np.concatenate([one, starts[starts != 0], pairs, skips])
    places, counts = np.unique((every >> np.uint64(44)).astype("i8"), return_counts=True)
    return places, 1 + np.log(counts)


@dataclass(frozen=True)
class Settings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    passes: int = 3
    seed: int = 7


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], how: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Places with a weight, their weights and the constant. Rows are taken in a seeded order."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    labels = np.array([y for _, _, y in rows], dtype=float)
    share = float(labels.mean()) if len(rows) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(0, "i8"), np.zeros(0), np.log((share + 1e-9) / (1 - share + 1e-9))

    def weights(at):
        inner = np.abs(z[at]) - how.l1 * (at != PLACES)
        return np.where(inner <= 0, 0, -np.sign(z[at]) * inner / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    order = np.random.default_rng(how.seed)
    for _ in range(how.passes):
        for i in order.permutation(len(rows)):
            places, values, y = rows[i]
            at, x = np.append(places, PLACES), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha * w
            n[at] += g * g
    every = weights(np.arange(PLACES + 1))
    found = np.flatnonzero(every[:-1])
    return found, every[found], float(every[-1])


def train(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = SAMPLE_ROWS,
    how: Settings = Settings(),
) -> tuple[np.ndarray, np.ndarray, float]:
    """The fitted model, a few thousand numbers, from about ``rows`` of the labelled rows."""
    known = labels.filter(col(key).isNotNull() & col(label).isNotNull()).groupBy(col(key)).agg(F.max(col(label)).alias("_y"))
    small_batches(df.sparkSession)
    total = known.count()
    limit = 1 << 30
    drawn = F.pmod(F.xxhash64(col(key).cast("string"), F.lit(how.seed)), F.lit(limit))
    if total > rows:
        known = known.filter(drawn < int(limit * rows / total))
    # Bounded by ``rows``, so it may be broadcast: the texts of all other rows stay where they are.
    texts = df.select(col(key), col(text).alias("_text")).join(F.broadcast(known), key)
    texts = texts.select(drawn.alias("_drawn"), "_text", F.col("_y").cast("int").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                shown = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                found += [_small(*features(t or ""), int(y > 0)) for t, y in shown]
        places, weights, constant = fit(found, how)
        one = [pa.array([places.tolist()], pa.list_(pa.int64())), pa.array([weights.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*one, pa.array([constant])], ["places", "weights", "constant"])

    one_task = texts.repartition(1).sortWithinPartitions("_drawn", "_y", F.xxhash64("_text"))
    schema = "places array<bigint>, weights array<double>, constant double"
    model = one_task.mapInArrow(run, schema).first()
    if model is None:
        return np.zeros(0, "i8"), np.zeros(0), -20.0
    return np.array(model["places"], dtype="i8"), np.array(model["weights"], dtype=float), float(model["constant"])


def _small(places: np.ndarray, values: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, int]:
    return places.astype("i4"), values.astype("f2"), y


def scorer(model: tuple[np.ndarray, np.ndarray, float]) -> Callable[[str], float]:
    places, weights, constant = model
    dense = np.zeros(PLACES)
    dense[places] = weights

    def score(text: str) -> float:
        at, x = features(text)
        return float(1 / (1 + np.exp(-np.clip(dense[at] @ x + constant, -35, 35))))

    return score


def score_texts(
    df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (all by default) and ``score`` from 0 to 1 for every row."""

    def work() -> Callable[[list[str]], list[tuple]]:
        score = scorer(model)
        return lambda texts: [(score(t),) for t in texts]

    return map_text(df, text, "score double", work, df.columns if keep is None else keep)


def drop_toxic(
    df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows whose score is below ``threshold``, their columns as they are."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                kept = [score(t or "") < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(key: str = "doc_id"):
    """True where crc32 of the key as text leaves no remainder by five; such rows are never learned from."""
    return F.coalesce(F.crc32(col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_report(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row, learned from the labels that aren't held out."""
    model = train(df, labels.filter(~held_out(key)), key, text)
    scored = score_texts(df, model, text, [key])
    return scored.select(
        col(key), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
