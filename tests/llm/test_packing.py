"""Packing: the plan against best fit one by one, ids against the tokenizer, places without gaps."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardtable.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(counts, capacity):
    """Number of sequences that best fit by decreasing length opens."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(r, i) for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(capacity - length)
    return len(room)


def test_plan_is_best_fit():
    draw = random.Random(1)
    for _ in range(200):
        capacity = draw.randint(5, 60)
        some = draw.sample(range(1, capacity + 1), draw.randint(1, min(capacity, 20)))
        counts = {length: draw.randint(0, 12) for length in some}
        placed, ranks = {}, {length: [] for length in counts}
        for length, begin, end, first, each, offset in packing.plan_slots(counts, capacity):
            for r in range(begin, end):
                ranks[length].append(r)
                placed.setdefault(first + (r - begin) // each, []).append((offset + (r - begin) % each * length, length))
        assert all(sorted(r) == list(range(counts[length])) for length, r in ranks.items())
        for held in placed.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(placed) == best_fit(counts, capacity)
    many = packing.plan_slots({length: 10**12 + length for length in range(1, 1025)}, 1024)
    assert len(many) < 4096  # whatever the number of pieces


def said():
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(900)}" for _ in range(draw.choice([1, 5, 60, 300]))) for _ in range(150)]
    texts += ["short text"] * 90 + [" ".join(f"long{i}" for i in range(3000)), "a <|endoftext|> b  <|endoftext|>", "\n\n x  \t y'll é  z 12.5 ", ""]
    return [(i, t, "a") for i, t in enumerate(texts)] + [(None, "no key", None), (500, None, "a"), (1, texts[1], "b"), (1, texts[1], "b")]


@pytest.mark.parametrize(("capacity", "block"), [(1024, 4096), (40, 8)])
def test_pieces_and_places(docs, monkeypatch, capacity, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    model = Tokenizer.from_file(PATH)
    rows = said()
    df = docs(rows).repartition(5)
    packed = packing.pack(df, PATH, 2, capacity)
    assert packed.columns == [*df.columns, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = packed.collect()
    want, counts = [], {}
    for i, t, s in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        over = len(ids) % capacity
        cuts = [0, *([over] if over else []), *range(over + capacity, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, s, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()), tuple(ids[a:b])))
            counts[b - a] = counts.get(b - a, 0) + 1
    found = [(r["doc_id"], r["source"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], tuple(r["ids"])))
    for parts in held.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == best_fit(counts, capacity)
    joined = {r["sequence_id"]: tuple(r["ids"]) for r in packing.sequences(packed).collect()}
    assert {len(v) for v in joined.values()} <= set(range(1, capacity + 1)) and len(joined) == len(held)
    assert sum(len(v) for v in joined.values()) == sum(k * n for k, n in counts.items())


def test_other_tokenizers_and_no_rows(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.Encoder(path).merge is None and packing.Encoder(PATH).merge is not None
    got = packing.pack(docs([(1, "Some words here", "a")]), path, 49407).collect()
    ids = Tokenizer.from_file(path).encode("Some words here", add_special_tokens=False).ids
    assert [r["ids"] for r in got] == [[*ids, 49407]]
    empty = packing.packing_report(docs([]), PATH, 2)
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and empty.count() == 0
