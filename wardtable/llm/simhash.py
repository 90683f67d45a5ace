"""SimHash near-duplicates, found by fuzzy hashing with the Golay code.

A fingerprint of 64 bits has a bit set where over half of a text's shingle hashes have it.
Segments of 23 bits are decoded to the code words around them (see ``golay``): two fingerprints
with at most two differing bits in a segment share a key there. Each such key is joined with one
block of the other bits taken as it is, which makes keys rarer. With four differing bits no link
is lost: of two disjoint segments one has two errors at most, and of the five blocks beside it
one has none. Fingerprints that share a key are compared bit by bit.

Exact copies share a fingerprint and count once. Within a key the links leave as a star around the
smallest fingerprint of each connected part, so a group of n copies makes n - 1 rows per key and
never all pairs. A key with very many fingerprints is dealt out as pairs of blocks of them, so no task holds
a whole one and none of its links is lost.

Null and empty texts have fingerprint zero and link like any other. Repeated rows fall into one
class. Extra columns are ignored or, in ``drop_near_duplicates``, kept as they are, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardtable.llm import golay
from wardtable.llm.common import col, free_name, map_text, parts, saved
from wardtable.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Fingerprints of one key that are compared in one go; keys with more are dealt out.
TOGETHER = 1024
BITS = 64


@dataclass(frozen=True)
class Scheme:
    """Which segments are decoded and which blocks (start, length) of the rest go with each.

    ``longs`` words of 64 bits; fingerprints within ``radius`` bits are linked.
    """

    longs: int
    radius: int
    segments: tuple[tuple[int, tuple[tuple[int, int], ...]], ...]


def scheme(longs: int, radius: int, segments: int, blocks: int) -> Scheme:
    """Segments side by side from bit 0, each with ``blocks`` equal parts of all other bits."""
    found = []
    for s in range(segments):
        start = s * golay.LENGTH
        rest = [b for b in range(longs * BITS) if not start <= b < start + golay.LENGTH]
        cuts = [round(i * len(rest) / blocks) for i in range(blocks + 1)]
        found.append((start, tuple(tuple(rest[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))))
    return Scheme(longs, radius, tuple(found))


#: Exact for four bits of 64: two segments, five blocks of eight or nine bits.
EXACT_64 = scheme(1, 4, 2, 5)


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(text: str, words: int, longs: int, seed: int) -> np.ndarray:
    """XXH64 (one long) or XXH3 with 128 bits (two) of every shingle of the lower-cased text, repeats included."""
    found = text.encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return np.zeros((0, longs), dtype=">u8")
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype="i8", count=len(found))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    last = max(0, len(found) - words)
    pairs = zip(starts[: last + 1].tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest if longs == 1 else xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), dtype=">u8").reshape(-1, longs)


def fingerprint(text: str, words: int, longs: int = 1, seed: int = 42) -> list[int]:
    """Signed longs; all zero without a word."""
    return bits_of(shingle_hashes(text, words, longs, seed), longs)


def bits_of(hashes: np.ndarray, longs: int) -> list[int]:
    """Signed longs with the bits that over half of the hashes have."""
    ones = np.zeros(longs * BITS, dtype="i8")
    for start in range(0, len(hashes), 8192):
        block = np.ascontiguousarray(hashes[start : start + 8192]).view("u1")
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype="i8")
    return np.packbits(2 * ones > len(hashes)).view(">i8").tolist()


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", words: int = 4, longs: int = 1, seed: int = 42) -> DataFrame:
    """``keep`` columns and the fingerprint's longs ``f0`` (and ``f1``)."""

    def work() -> Callable[[list[str]], list[tuple]]:
        return lambda texts: [tuple(fingerprint(t, words, longs, seed)) for t in texts]

    return map_text(df, text, ", ".join(f"{f} bigint" for f in _names(longs)), work, keep)


def _names(longs: int) -> list[str]:
    return [f"f{i}" for i in range(longs)]


def hexadecimal(*longs: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in longs])


# --- keys and links ---------------------------------------------------------


def fuzzy_keys(prints: np.ndarray, how: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) arrays for fingerprints of shape (n, longs), unsigned."""
    bits = np.unpackbits(np.ascontiguousarray(prints.astype(">u8")).view("u1").reshape(len(prints), -1), axis=1)
    bits = bits[:, ::-1].astype("i8")  # bit 0 is the last one
    rows, found, number = [], [], 0
    for start, blocks in how.segments:
        word = bits[:, start : start + golay.LENGTH] @ (1 << np.arange(golay.LENGTH))
        row, code = golay.keys(word)
        for block in blocks:
            value = bits[:, list(block)] @ (1 << np.arange(len(block)))
            rows.append(row)
            found.append(((number << golay.DATA) | code) << len(block) | value[row])
            number += 1
    return np.concatenate(rows), np.concatenate(found)


def _distances(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype="i8")


def pairs_within(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows with equal keys and at most ``radius`` differing bits; rows are whole groups, sorted by key."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begins, len(keys)))
    left = np.repeat(begins + sizes, sizes) - np.arange(len(keys)) - 1  # rows after each one in its group
    hits = []
    small = np.flatnonzero((left > 0) & (np.repeat(sizes, sizes) <= 64))
    step = 1
    while len(small):
        ok = _distances(prints, small, small + step) <= radius
        hits.append((small[ok], small[ok] + step))
        step += 1
        small = small[left[small] >= step]
    for b, n in zip(begins[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        for a in range(b, b + n, 128):
            i = np.arange(a, min(a + 128, b + n))
            far = np.bitwise_count(prints[i][:, None] ^ prints[None, a : b + n]).sum(axis=2, dtype="i8")
            x, y = np.nonzero(far <= radius)
            x, y = i[x], y + a
            hits.append((x[x < y], y[x < y]))
    if not hits:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    i, j = (np.concatenate(side) for side in zip(*hits, strict=True))
    return i, j


def _merge(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each of ``n`` rows reaches over the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
    return label


def stars(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, row): a star for each connected part of each group."""
    label = _merge(len(keys), *pairs_within(keys, prints, radius))
    rows = np.flatnonzero(label != np.arange(len(label)))
    return label[rows], rows


def _links_in_groups(keyed: DataFrame, how: Scheme, together: int | None) -> DataFrame:
    """Stars of the groups of equal ``key`` (rows come sorted by it); groups beyond ``together`` pass with their key.

    Rows that pass have no second end; links have no key.
    """
    names = _names(how.longs)
    schema = ", ".join(["key bigint", *[f"a{n} bigint" for n in names], *[f"b{n} bigint" for n in names]])

    def batch(key, a, b) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        columns = [none if key is None else pa.array(key)]
        columns += [pa.array(np.ascontiguousarray(a[:, i]).view("i8")) for i in range(len(names))]
        columns += [none if b is None else pa.array(np.ascontiguousarray(b[:, i]).view("i8")) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, ["key", *[f"a{n}" for n in names], *[f"b{n}" for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys = np.zeros(0, "i8")
        held = np.zeros((0, len(names)), "u8")
        late = None  # the key whose rows pass on

        def passed(keys: np.ndarray, prints: np.ndarray):
            if len(keys):
                centre, row = stars(keys, prints, how.radius)
                if len(row):
                    yield batch(None, prints[centre], prints[row])

        for part in batches:
            keys = part.column(0).to_numpy()
            prints = np.column_stack([part.column(1 + i).to_numpy().view("u8") for i in range(len(names))])
            if late is not None:
                mine = keys == late
                if mine.any():
                    yield batch(keys[mine], prints[mine], None)
                keys, prints = keys[~mine], prints[~mine]
            keys, prints = np.concatenate([held_keys, keys]), np.concatenate([held, prints])
            if not len(keys):
                continue
            if together is not None:  # groups that are too large already
                begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                sizes = np.diff(np.append(begins, len(keys)))
                large = np.repeat(sizes > together, sizes)
                if large.any():
                    yield batch(keys[large], prints[large], None)
                    if large[-1]:
                        late = keys[-1]
                    keys, prints = keys[~large], prints[~large]
                    if late is not None and (not len(keys) or large[-1]):
                        yield from passed(keys, prints)
                        held_keys, held = keys[:0], prints[:0]
                        continue
            end = int(np.searchsorted(keys, keys[-1]))
            yield from passed(keys[:end], prints[:end])
            held_keys, held = keys[end:], prints[end:]
        yield from passed(held_keys, held)

    return keyed.mapInArrow(run, schema)


def _sorted_by_key(keyed: DataFrame) -> DataFrame:
    n = parts(keyed.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key")


def links(prints: DataFrame, how: Scheme) -> DataFrame:
    """Distinct links (``a``, ``b`` as hexadecimal) that connect the distinct fingerprints of ``prints`` as all links do."""
    names = _names(how.longs)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                part = whole.slice(start, 1000)
                found = np.column_stack([c.to_numpy().view("u8") for c in part.columns])
                rows, keys = fuzzy_keys(found, how)
                columns = [pa.array(keys), *[pa.array(np.ascontiguousarray(found[rows, i]).view("i8")) for i in range(len(names))]]
                yield pa.RecordBatch.from_arrays(columns, ["key", *names])

    schema = ", ".join(["key bigint", *[f"{n} bigint" for n in names]])
    keys = _sorted_by_key(prints.select(*names).distinct().mapInArrow(keyed, schema))
    first = saved(_links_in_groups(keys, how, TOGETHER), "links")
    passed = col(f"b{names[0]}").isNull()
    # Large groups: pairs of blocks, as many as their size asks for.
    late = first.filter(passed).select("key", *[col(f"a{n}").alias(n) for n in names])
    sizes = late.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_blocks"))
    own = F.pmod(F.xxhash64(*names), F.col("_blocks"))
    pairs = (
        late.join(sizes, "key")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), *names)
    )
    second = _links_in_groups(_sorted_by_key(pairs), how, None)
    ends = [hexadecimal(*[col(f"{side}{n}") for n in names]).alias(side) for side in "ab"]
    return first.filter(~passed).unionByName(second).select(*ends).distinct()


def near_duplicates(
    df: DataFrame, how: Scheme = EXACT_64, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42
) -> DataFrame:
    """``key``, ``fingerprint`` (hexadecimal) and ``component_id`` (smallest key that links reach), a row for each row.

    Null keys are numbers after all others. No rows: none come out.
    """
    shown = hexadecimal(*[col(n) for n in _names(how.longs)])
    prints = saved(fingerprints(df, [key], text, words, how.longs, seed), "fingerprints")
    reached = _classes(prints, shown, links(prints, how), col(key))
    return prints.select(col(key), shown.alias("fingerprint"), shown.alias("_node")).join(reached, "_node", "left").select(
        col(key), "fingerprint", F.col("_least").alias("component_id")
    )


def _classes(prints: DataFrame, node: Column, found: DataFrame, row: Column) -> DataFrame:
    """``_node`` and ``_least``, the smallest ``row`` that links reach, for each node."""
    labels = components(found).withColumnRenamed("node", "_node")
    classes = prints.groupBy(node.alias("_node")).agg(F.min(row).alias("_own"))
    classes = classes.join(labels, "_node", "left").select("_node", "_own", F.coalesce("label", "_node").alias("_label"))
    least = classes.groupBy("_label").agg(F.min("_own").alias("_least"))
    return classes.join(least, "_label").select("_node", "_least")


def drop_near_duplicates(
    df: DataFrame, how: Scheme = EXACT_64, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42
) -> DataFrame:
    """One row of each group that links reach, the one with the smallest key (null after all others); all its columns as they are.

    Rows with one key are told apart by all their columns, so the same row stays in every run. Rows
    that are equal in every column are one document.
    """
    own = free_name(df, "_row")
    named = df.withColumn(own, F.md5(F.to_json(F.struct(*[col(c) for c in df.columns]))))
    prints = saved(fingerprints(named, [key, own], text, words, how.longs, seed), "fingerprints")
    row = F.struct(col(key).isNull().alias("_null"), col(key).alias("_key"), col(own).alias("_row"))
    reached = _classes(prints, hexadecimal(*[col(n) for n in _names(how.longs)]), links(prints, how), row)
    kept = reached.select(F.col("_least._row").alias(own)).distinct()
    # The semi join leaves rows dealt by their digest, which is what dropping repeats needs.
    left = named.join(kept, own, "left_semi").dropDuplicates([own])
    return left.select(*[col(c) for c in df.columns])
