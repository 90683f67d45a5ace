"""The audit of filters against a run of every order, document by document."""

from itertools import permutations

import pytest

from wardtable.llm import audit


def fails(rows):
    """(part, failed letters, key) of each row."""
    out = []
    for i, text, part in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
        failed = "A" * (len(words) < 50)
        failed += "B" * (100 * len(set(words)) < 65 * len(words))
        failed += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        failed += "D" * any(c in "#$%&*|" for c in t)
        failed += "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((part or "", failed, i))
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    told, out = fails(rows), {}
    for part in {p for p, _, _ in told}:
        mine = [(failed, i) for p, failed, i in told if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                redundant = sum(letter in f for f, _ in mine) - len(gone)
                left = [d for d in left if letter not in d[0]]
                shapley[letter] += len(gone)
                lost = [sum(i in kind for _, i in gone) for kind in (good, toxic)]
                out[part, order, step] = [len(left), len(gone), redundant, sum(f == letter for f, _ in mine), *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def clean(k):
    return " ".join(f"word{k}x{i}" for i in range(60))


ROWS = [
    (1, clean(1), "a"), (2, clean(1), "b"), (3, clean(3) + " $", "a"), (4, "few", None), (5, "few", ""), (6, "x " * 80, "a"),
    (7, (clean(7)).upper(), "b"), (8, None, "b"), (9, "", "b"), (None, clean(1), "a"), (None, None, None), (10, clean(3) + " $", "b"),
    (2, clean(1), "b"), (1, clean(1), "a"), (11, "FEW | " * 9, "a"), (12, "few words\x1cone", "a"), (13, "é" * 3000 + "|", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (6, 1, 0), (11, 1, 1), (99, 1, 1)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(*r, "x", 7) for r in LABELS], "doc_id bigint, quality int, toxic int, part string, mask int")


def test_every_order(docs, labels):
    got = audit.audit_report(docs(ROWS).repartition(3), labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in got}
    want = plain(ROWS, LABELS)
    assert len(got) == len(want) == 600 * 4
    assert found == want


def test_no_rows(docs, labels):
    assert audit.audit_report(docs([]), labels).count() == 0
    assert audit.audit_report(docs(ROWS[:2]), labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
