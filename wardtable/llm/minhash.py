"""MinHash fingerprints of whole texts, and near-duplicates by bands of them.

Shingles are five words (fewer: all of them) of the text as it is, words being runs of anything but space and \\t to \\r.
Each of ``SIZE`` universal hash functions (odd multiplier, sum, high bits) takes the smallest value over the
shingles. The share of equal values estimates the Jaccard likeness of two texts' shingle sets.
Signatures fall into bands joined in Spark; pairs that share a band are verified by the true likeness.

Edited texts need the text that follows in the order of keys. Keys are cut into ranges by
quantiles, keys that fill several ranges by a hash of the text as well. A range's rows are sorted and streamed by one task, and
each range also gets the first row of the range after it, so no task holds a range and no window runs over the whole table.

Null and empty texts have a fingerprint of their own, that of the empty set: like each other, unlike all others. Null
keys come first; equal keys are ordered by a hash of the text. With one row the next text is its own. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardtable.llm.common import col, map_text, parts, saved, small_batches
from wardtable.llm.components import components

WORDS = 5
SIZE = 64
#: 16 bands of four values: pairs alike by 0.8 share one with a chance of 0.9998.
BANDS = 16
LEAST_LIKENESS = 0.8
_FOLD = (1 << 64) - 1
SPACES = [bytes([c]) for c in b" \t\n\x0b\x0c\r"]


@lru_cache(1)
def functions(size: int = SIZE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 63, size, dtype="u8") * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, size, dtype="u8")


class _Words(dict):
    """Hash of a word; the first 100,000 words are kept, which the common ones are among."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


@lru_cache(1)
def _known() -> _Words:
    return _Words()


def word_hashes(raw: bytes) -> np.ndarray:
    found = raw.split()
    return np.fromiter(map(_known().__getitem__, found), dtype="u8", count=len(found))


def shingle_hashes(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes, or of all if there are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    mixed = np.zeros(len(words) - width + 1, dtype="u8")
    for k in range(width):
        mixed = (mixed ^ words[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def smallest(shingles: np.ndarray) -> np.ndarray:
    """The signature: 32 high bits of each function's smallest value; all ones for no shingle."""
    a, b = functions()
    out = np.full(len(a), _FOLD, dtype="u8")
    for start in range(0, len(shingles), 2048):
        block = shingles[start : start + 2048]
        np.minimum(out, (block[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("u4")


def signature(text: str) -> np.ndarray:
    return smallest(shingle_hashes(word_hashes(text.encode("utf-8", "replace"))))


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


# --- texts and what follows them --------------------------------------------


def in_ranges(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_text``, ``_k`` (the key, null as the smallest), ``_h`` and the range ``_b``, which never falls along (_k, _h).

    Ranges are cut at quantiles of the key. A key that several quantiles meet, null included, is cut further by the
    hash of the text, ``_h`` (0 for all other keys, so that texts are hashed only where such a key exists). Rows alike in key and
    text are never cut.
    """
    ranges = 4 * parts(df.sparkSession)
    keyed = df.select(
        col(key).alias("_key"), F.coalesce(col(text), F.lit("")).alias("_text"),
        F.coalesce(col(key).cast("bigint"), F.lit(-(1 << 63))).alias("_k"),
    )
    shares = [i / ranges for i in range(1, ranges)]
    found = keyed.agg(F.percentile_approx("_k", shares, 100 * ranges).alias("c")).first()["c"] or [0]
    # Large numbers may meet as doubles; order is kept, which is all that ranges need.
    splits = [float("-inf"), *sorted({float(c) for c in found}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_double", outputCol="_range").transform(
        keyed.withColumn("_double", F.col("_k").cast("double"))
    )
    hot: dict[int, tuple[int, int]] = {}
    for value, times in sorted(Counter(found).items()):
        if times > 1:
            hot.setdefault(bisect.bisect_right(splits, float(value)) - 1, (value, times))
    width = ranges + 2  # more than the parts of any range
    whole = (F.col("_range") * width).cast("bigint")
    if not hot:
        return cut.select("_key", "_text", "_k", F.lit(0).cast("bigint").alias("_h"), whole.alias("_b"))
    rows = [(float(at), value, times) for at, (value, times) in hot.items()]
    # At most a row for every second cut, whatever the size of the table.
    heavy = df.sparkSession.createDataFrame(rows, "_range double, _hot bigint, _times bigint")
    digest = F.when(F.col("_k") == F.col("_hot"), F.xxhash64("_text")).otherwise(F.lit(0)).cast("bigint")
    share = F.floor((F.col("_h").cast("double") / float(1 << 64) + 0.5) * F.col("_times"))
    part = (
        F.when(F.col("_k") == F.col("_hot"), 1 + F.least(share, F.col("_times") - 1))
        .when(F.col("_k") > F.col("_hot"), F.col("_times") + 1)
        .otherwise(F.lit(0))
    )
    return cut.join(F.broadcast(heavy), "_range", "left").withColumn("_h", digest).select(
        "_key", "_text", "_k", "_h", (whole + part).alias("_b")
    )


def with_next(df: DataFrame, key: str, text: str, schema: str, work) -> DataFrame:
    """``key`` and what ``work(text, next_text)`` returns for every row; the last row is followed by the first."""
    spark = df.sparkSession
    small_batches(spark)
    keyed = in_ranges(df, key, text)
    found = keyed.groupBy("_b").agg(F.min(F.struct("_k", "_h")).alias("_first")).collect()
    firsts = sorted((r["_b"], tuple(r["_first"])) for r in found)
    # One row for each range: its first row, and the range before it that needs a copy.
    copies = [(*first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    copies = spark.createDataFrame(copies, "_k bigint, _h bigint, _to bigint")
    keyed = keyed.join(F.broadcast(copies), ["_k", "_h"], "left")
    places = F.array_compact(
        F.array(
            F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy")),
            F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("b"), F.lit(True).alias("copy"))),
        )
    )
    dealt = (
        keyed.select("_key", "_text", "_k", F.explode(places).alias("_p"))
        .select("_key", "_text", F.col("_p.b").alias("_b"), F.col("_p.copy").alias("_copy"), "_k")
        .repartition(parts(spark), "_b")
        .sortWithinPartitions("_b", "_copy", "_k", F.xxhash64("_text"))
        .select("_key", "_text", "_b", "_copy")
    )
    from wardtable.llm.common import _arrow_schema

    out = StructType([*df.select(col(key)).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row that waits for what follows
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                done = []
                for row in zip(*[c.to_pylist() for c in batch.slice(start, 128).columns], strict=True):
                    if held is not None and held[2] == row[2]:
                        done.append((held[0], *work(held[1], row[1])))
                    held = None if row[3] else row
                if done:
                    columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return dealt.mapInArrow(run, out)


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many of the next text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


@lru_cache(2)
def _described(text: str) -> tuple[np.ndarray, bytes, int, np.ndarray, np.ndarray]:
    """Word hashes, the bytes that stay when the text is edited, how many words of these are sure to stay words,
    the smallest values over the shingles of these words, and over all shingles."""
    raw = text[: len(text) - len(text) // 4].encode("utf-8", "replace")
    own = word_hashes(text.encode("utf-8", "replace"))
    shared = len(raw[: 1 + max(raw.rfind(c) for c in SPACES)].split())
    base = smallest(shingle_hashes(own[:shared])) if shared >= WORDS else smallest(own[:0])
    rest = own[max(0, shared - WORDS + 1) :] if shared >= WORDS else own
    more = shingle_hashes(rest) if len(rest) >= WORDS or shared < WORDS else own[:0]
    return own, raw, shared, base, np.minimum(base, smallest(more))


def fingerprint_row(text: str, after: str) -> tuple:
    """Code points, digest of the edited text, both fingerprints, likeness to the edited and to the next text.

    What a text shares with its edited version is hashed once, and so is every text for its own row and the one before.
    """
    own, raw, shared, base, first = _described(text)
    changed = raw + after[: len(text) // 4].encode("utf-8", "replace")
    start = 1 + max(raw.rfind(c) for c in SPACES)
    other = np.concatenate([own[max(0, shared - WORDS + 1) : shared] if shared >= WORDS else own[:shared], word_hashes(changed[start:])])
    more = shingle_hashes(other) if len(other) >= WORDS or shared < WORDS else own[:0]
    second = np.minimum(base, smallest(more))
    return (
        len(text),
        hashlib.sha256(changed).hexdigest(),
        shown(first),
        shown(second),
        likeness(first, second),
        likeness(first, _described(after)[4]),
    )


def fingerprint_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_chars``, ``edited_sha256``, both fingerprints, ``near_edited`` and ``near_next`` for every row."""
    schema = (
        "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(df, key, text, schema, fingerprint_row)


# --- near-duplicates --------------------------------------------------------


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_LIKENESS) -> DataFrame:
    """``key``, ``fingerprint`` and ``class_id`` (smallest key of its near-duplicates), a row for each row.

    Rows with the same shingles count once. In each round every band's value has a centre, compared with those
    members that are not in its class yet; then the next member is the centre, until all members that are left
    are of one class. So every pair that shares a band is compared unless links join it already, a large
    group of near copies takes one round, and no round makes more rows than there are members.
    """

    def work():
        def row(t: str) -> tuple:
            shingles = np.unique(shingle_hashes(word_hashes(t.encode("utf-8", "replace"))))
            s = smallest(shingles)
            bands = [shown(x) for x in s.reshape(BANDS, -1)]
            return shown(s), xxhash.xxh3_128_hexdigest(shingles.tobytes()), bands, shingles.view("i8")

        return lambda texts: [row(t) for t in texts]

    schema = "fingerprint string, _set string, _bands array<string>, _shingles array<bigint>"
    rows = saved(map_text(df, text, schema, work, [key]), "minhash")
    first = [F.first(c).alias(c) for c in ("_bands", "_shingles")]
    sets = saved(rows.groupBy("_set").agg(F.min(col(key)).alias("_least"), *first), "sets")
    a = sets.select("_set", F.col("_shingles").alias("_a"))
    b = sets.select(F.col("_set").alias("_centre"), F.col("_shingles").alias("_b"))
    left = sets.select("_set", F.posexplode("_bands").alias("_band", "_value"))
    group = ["_band", "_value"]
    linked = sets.select(F.col("_set").alias("a"), F.col("_set").alias("b")).limit(0)
    labels = None
    while True:
        named = left.withColumn("label", F.col("_set"))
        if labels is not None:
            named = left.join(labels, "_set", "left").withColumn("label", F.coalesce("label", "_set"))
        centre = F.min(F.struct("_set", "label"))
        open_ = named.groupBy(*group).agg(F.min("label").alias("_l"), F.max("label").alias("_m"), centre.alias("_c"))
        open_ = open_.filter("_l <> _m").select(*group, F.col("_c._set").alias("_centre"), F.col("_c.label").alias("_own"))
        met = saved(named.join(open_, group).filter("_set <> _centre"), "met")
        if met.isEmpty():
            break
        pairs = met.filter("label <> _own").select("_set", "_centre").distinct()
        common = F.size(F.array_intersect("_a", "_b"))
        alike = common >= least * (F.size("_a") + F.size("_b") - common)
        found = pairs.join(a, "_set").join(b, "_centre").filter(alike)
        linked = saved(linked.unionByName(found.select(F.col("_set").alias("a"), F.col("_centre").alias("b"))), "linked")
        labels = components(linked).select(F.col("node").alias("_set"), "label")
        left = met.select("_set", *group)
    classes = sets.select("_set", "_least")
    classes = classes.withColumn("label", F.col("_set")) if labels is None else classes.join(labels, "_set", "left")
    classes = classes.withColumn("label", F.coalesce("label", "_set"))
    least_key = classes.groupBy("label").agg(F.min("_least").alias("class_id"))
    reached = classes.join(least_key, "label").select("_set", "class_id")
    return rows.select(col(key), "fingerprint", "_set").join(reached, "_set", "left").select(
        col(key), "fingerprint", "class_id"
    )
