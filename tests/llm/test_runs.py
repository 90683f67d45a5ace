"""Periodic runs against a search by definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from wardtable.llm import runs


def brute(words):
    """All runs by definition: every period, every maximal stretch, smallest period of the stretch."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            smaller = any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]


def texts(seed):
    draw = random.Random(seed)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 97, ["a", "b"] * 3, ["a", "b"] * 4, ["a", "b", "a"] * 40]
    for _ in range(60):
        kinds = draw.choice([2, 3, 10, 1000])
        words = [str(draw.randrange(kinds)) for _ in range(draw.choice([3, 30, 200]))]
        for _ in range(draw.randrange(4)):
            part = [str(draw.randrange(kinds)) for _ in range(draw.randrange(1, 12))]
            at = draw.randrange(len(words) + 1)
            words[at:at] = (part * 9)[: draw.randrange(1, 9 * len(part))]
        out.append(words)
    out += out[-5:]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("together", [50, 100_000])
def test_runs_by_definition(monkeypatch, together):
    monkeypatch.setattr(runs, "TOGETHER", together)
    monkeypatch.setattr(runs, "GRID", 1000)
    for seed in range(5):
        said = texts(seed)
        got = runs.find_runs([[w.encode() for w in t] for t in said])
        assert len(got) == len(said)
        for words, (found, stays) in zip(said, got, strict=True):
            want = brute(words)
            assert [tuple(r) for r in found.tolist()] == want
            assert [w for w, s in zip(words, stays, strict=True) if s] == brute_kept(words, want)


def test_extensions_by_comparison():
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 8, 50, 400):
        words = np.append(draw.integers(0, 2, n), 9)
        words[n // 2 : n] = words[: n - n // 2]
        found = runs.Extensions(words)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            k = 0
            while max(a, b) + k <= n and words[a + k] == words[b + k]:
                k += 1
            want.append(k)
        assert found.common(i, j).tolist() == want


def plain_row(i, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = brute(words)
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    shown = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (i, len(found), *shown, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(brute_kept(words, found))).hexdigest())


def test_report_rows(docs):
    draw = random.Random(4)
    rows = [(i, " ".join(t), "a") for i, t in enumerate(texts(7))]
    rows += [(i, " \n".join(str(draw.randrange(50)) for _ in range(draw.randrange(1, 80))), "b") for i in range(100, 180)]
    rows += [(200, None, None), (201, "", "a"), (None, "x y " * 8, "a"), rows[3], (202, "é x " * 7, "a")]
    got = sorted((tuple(r) for r in runs.run_report(docs(rows)).collect()), key=str)
    assert got == sorted((plain_row(i, t) for i, t, _ in rows), key=str)
    assert sum(r[1] for r in got) > 50
    assert runs.run_report(docs([])).count() == 0


def test_collapsed_rows_and_long_texts(docs):
    long = " ".join(f"w{i}" for i in range(30_000)) + " " + "one two three " * 20_000 + "end"
    df = docs([(1, "a a a a a a a b", "a"), (2, None, None), (3, long, "a")])
    got = {r["doc_id"]: r for r in runs.collapse_runs(df).collect()}
    assert runs.collapse_runs(df).columns == [*df.columns, "runs", "collapsed"]
    assert (got[1]["collapsed"], [tuple(r) for r in got[1]["runs"]]) == ("a b", [(0, 7, 1)])
    assert (got[2]["collapsed"], got[2]["runs"]) == ("", [])
    assert [tuple(r) for r in got[3]["runs"]] == [(30_000, 60_000, 3)] and len(got[3]["collapsed"].split()) == 30_004
