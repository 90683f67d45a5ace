"""Best-fit packing planned over a histogram of lengths, slots then joined to documents by rank.

Documents become token ids and an end mark; those longer than a sequence are cut into pieces, the
first of which may be shorter. The plan sees only how many pieces there are of each length, at most
``capacity`` numbers: from the longest down, all pieces of a length go into the fullest sequences
that still have room, as best fit by decreasing length does one by one. Each step places a range of ranks
into a range of sequences, so the plan's size depends on the capacity and never on the number of
documents. A piece's rank within its length is its place within the task that encoded it and the
number of such pieces in tasks before. Pieces and slots meet in a join on length and block of
ranks, where no key has more than ``BLOCK`` pieces, however many documents are of one length.

A null text is an empty one and gives the end mark alone. Very long texts are encoded whole.
Repeated rows and rows with null or shared keys are documents of their own. Columns to keep may
have any name but those of the result. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardtable.llm.bpe import byte_characters
from wardtable.llm.common import col, map_text, saved

#: Ranks of one length that share a key of the join.
BLOCK = 4096

SLOTS = "length int, rank_from bigint, rank_to bigint, first_sequence bigint, each bigint, offset bigint"


# --- the plan ---------------------------------------------------------------


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, first_sequence, each, offset) for all ranks of all lengths.

    The pieces of a range fill sequences from ``first_sequence`` on, ``each`` of them side by side from ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, number of them)
    spaces = 0  # bit s: some sequences have s free tokens
    slots, sequences = [], 0

    def leave(space: int, first: int, number: int) -> None:
        nonlocal spaces
        if space and number:
            room.setdefault(space, []).append((first, number))
            spaces |= 1 << space

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = spaces >> length
            if fits:
                space = length + (fits & -fits).bit_length() - 1
                first, number = room[space].pop()
                if not room[space]:
                    spaces &= ~(1 << space)
            else:
                space, first, number = capacity, sequences, -(-left // (capacity // length))
                sequences += number
            each = space // length
            full = min(number, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - space))
                leave(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:  # fewer than fill one sequence
                slots.append((length, rank, rank + left, first + full, each, capacity - space))
                leave(space - left * length, first + full, 1)
                full, left = full + 1, 0
            leave(space, first + full, number - full)
    return slots


# --- token ids --------------------------------------------------------------


class Encoder:
    """Ids of texts by a tokenizer file, without special tokens.

    Where the file is byte-level BPE whose merges make ids in rising order, texts are merged by
    rank, which gives the same ids (every piece is made by one merge, so no other pair can make
    it) in a fifth of the time. With other files, and where a text holds the string of an added token,
    texts go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        added = [re.escape(t["content"]) for t in told.get("added_tokens") or []]
        self.added = re.compile("|".join(added)).search if added else lambda text: None
        self.merge = _by_rank(told)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.merge is None or self.added(text):
            return self._whole(text)
        return array("I", self.merge(text)).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()


def _by_rank(told: dict) -> Callable[[str], list[int]] | None:
    """Encodes by rank if the tokenizer file is byte-level BPE with ids in the order of its merges and nothing around it."""
    before, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = [told.get(k) for k in ("normalizer", "post_processor", "truncation")] + [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")]
    if not plain or any(odd) or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    names = {c: b for b, c in enumerate(byte_characters())}
    added = {t["content"] for t in told.get("added_tokens") or []}
    if merged != sorted(set(merged)) or len(merged) + 256 != len(set(vocab) - added):
        return None
    ranks = {bytes(names[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def cut_lengths(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first, which takes what is over."""
    over = tokens % capacity
    return ([over] if over else []) + [capacity] * (tokens // capacity)


def pieces(
    df: DataFrame, tokenizer_path: str, end: int, capacity: int, text: str = "text", keep: list[str] | None = None, ids: bool = True
) -> DataFrame:
    """A row for each piece: ``keep`` columns (all by default), ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids`` if asked for.

    ``_task`` and ``_nth`` number the pieces of each length within the task that made them.
    """
    kept = df.columns if keep is None else keep
    mark = np.array([end], dtype="<u4").tobytes()

    def work() -> Callable[[list[str]], list[tuple]]:
        encoder, seen = _encoder(tokenizer_path), np.zeros(capacity + 1, dtype="i8")

        def row(raw: bytes) -> tuple:
            made, begin = [], 0
            for piece, length in enumerate(cut_lengths(len(raw) // 4, capacity)):
                part = raw[4 * begin : 4 * (begin + length)]
                shown = {"ids": np.frombuffer(part, dtype="<u4").tolist()} if ids else {}
                made.append({"piece": piece, "start": begin, "length": length, "ids_crc32": zlib.crc32(part), "_nth": int(seen[length]), **shown})
                seen[length] += 1
                begin += length
            return (made,)

        return lambda texts: [row(encoder.encode(t) + mark) for t in texts]

    fields = "piece: int, start: bigint, length: int, ids_crc32: bigint, _nth: bigint" + (", ids: array<bigint>" if ids else "")
    told = map_text(df, text, f"_pieces array<struct<{fields}>>", work, kept)
    shown = F.explode("_pieces").alias("_p")
    out = told.select(*[col(c) for c in kept], F.spark_partition_id().alias("_task"), shown)
    return out.select(*[col(c) for c in kept], "_task", "_p.*")


# --- packing ----------------------------------------------------------------


def pack(
    df: DataFrame,
    tokenizer_path: str,
    end: int,
    capacity: int = 1024,
    text: str = "text",
    keep: list[str] | None = None,
    ids: bool = True,
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` there; columns as ``pieces`` has them."""
    made = saved(pieces(df, tokenizer_path, end, capacity, text, keep, ids), "pieces")
    tasks = made.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = saved(tasks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "tasks")
    # At most ``capacity`` rows reach the driver.
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = df.sparkSession.createDataFrame(plan_slots(counts, capacity), SLOTS)
    block = F.explode(F.sequence(F.expr(f"rank_from div {BLOCK}"), F.expr(f"(rank_to - 1) div {BLOCK}"))).alias("_block")
    slots = slots.select(F.col("length").alias("_length"), "rank_from", "rank_to", "first_sequence", "each", "offset", block)
    ranked = made.join(tasks.drop("_n"), ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    ranked = ranked.withColumn("_rank_block", F.expr(f"_rank div {BLOCK}"))
    meets = (F.col("length") == F.col("_length")) & (F.col("_rank_block") == F.col("_block"))
    placed = ranked.join(slots, meets & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    nth = F.col("_rank") - F.col("rank_from")
    return placed.select(
        *[col(c) for c in made.columns if c not in ("_task", "_nth")],
        (F.col("first_sequence") + F.expr("(_rank - rank_from) div each")).alias("sequence_id"),
        (F.col("offset") + nth % F.col("each") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and the ``ids`` of its pieces side by side; a group holds at most one sequence's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def packing_report(df: DataFrame, tokenizer_path: str, end: int, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces, their places and digests."""
    packed = pack(df, tokenizer_path, end, capacity, text, [key], ids=False)
    return packed.select(col(key), "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")
