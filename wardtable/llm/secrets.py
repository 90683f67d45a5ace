"""Secret scans with one automaton for all rules.

Rule patterns become one nondeterministic automaton, subset construction makes it deterministic,
refinement of equal states makes it small; what is left are transition arrays over classes of
bytes. Patterns are compiled reversed: one pass from the last byte to the first tells, at every
byte, which rules have a match that starts there. The pass runs over many stretches at once, cut
at bytes where every state falls back to the start (no secret holds them, or crosses a text's end; private keys hold line feeds). From
each start a forward automaton of that rule alone finds the longest match, the next match starts
at or after its end, and matches that fail the rule's test are dropped.

Null and empty texts have no spans. Very long texts are scanned whole. Rows are independent of each
other, so repeated rows get equal results; other columns stay as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from wardtable.llm.common import map_text, small_batches

ALL = frozenset(range(256))
#: Stretches scanned side by side.
LANES = 2048


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax of ``parse``; ``least`` counts the characters of ``measured`` in a match."""

    kind: str
    pattern: str
    least: int = 0
    measured: str = ""  # a regular expression with one group over the whole match; empty: the match itself
    any_case: bool = False

    def keeps(self, match: str) -> bool:
        if self.measured:
            match = re.fullmatch(self.measured, match, re.S | re.I)[1]
        return len(match) >= self.least


# Fixed values. A run of hex digits is matched whole, so 16 in the pattern equals a later test of the length.
BASE = (
    Rule(
        "assign",
        "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        12,
        "(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?(.+)",
        True,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}"),
)
# Public formats of further secrets.
FURTHER = (
    Rule("forge", "gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("pay", "[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("maps", "AIza[A-Za-z0-9_-]+", 39),
    Rule("web", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    # The header with all up to the END line, escaped line feeds included; without an END line the header alone.
    Rule(
        "pem",
        "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----"
        "([\\x09\\x0a\\x0d\\x20]*(Proc-Type:[A-Za-z0-9,\\x20-]*[\\x0d\\x0a]+)?(DEK-Info:[A-Za-z0-9,\\x20-]*[\\x0d\\x0a]+)?"
        "[A-Za-z0-9+/=\\x5c\\x09\\x0a\\x0d\\x20]*-----END\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----"
        ")?",
    ),
)


# --- from patterns to automata ----------------------------------------------


def parse(pattern: str, any_case: bool = False) -> tuple:
    """A tree of ("byte", set), ("then", parts), ("or", parts), ("times", part, least, most or None).

    Literals, ``[...]`` classes with ranges, ``\\xNN`` and escaped signs, groups, ``|``, ``? * + {m} {m,} {m,n}``.
    """
    at = 0

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            if pattern[at + 1] == "x":
                at += 4
                return int(pattern[at - 2 : at], 16)
            at += 1
        at += 1
        return ord(pattern[at - 1])

    def cased(codes: Iterable[int]) -> frozenset:
        out = set(codes)
        if any_case:
            out |= {ord(f(chr(c))) for c in out if c < 128 for f in (str.lower, str.upper)}
        return frozenset(out)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            codes: set[int] = set()
            while pattern[at] != "]":
                first = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    codes |= set(range(first, one() + 1))
                else:
                    codes.add(first)
            at += 1
            return ("byte", cased(codes))
        return ("byte", cased({one()}))

    def repeated() -> tuple:
        nonlocal at
        part = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                least, _, most = pattern[at + 1 : end].partition(",")
                bounds = (int(least), int(least) if "," not in pattern[at:end] else int(most) if most else None)
                at = end
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]
            at += 1
            part = ("times", part, *bounds)
        return part

    def sequence() -> tuple:
        found = []
        while at < len(pattern) and pattern[at] not in "|)":
            found.append(repeated())
        return ("then", found)

    def either() -> tuple:
        nonlocal at
        found = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else ("or", found)

    return either()


def reverse(tree: tuple) -> tuple:
    if tree[0] == "byte":
        return tree
    if tree[0] == "times":
        return ("times", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "then" else parts)


class Nondeterministic:
    """States with steps by sets of bytes and steps without a byte."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Builds the tree from ``start`` on; returns its end."""
        if tree[0] == "byte":
            end = self.state()
            self.steps[start].append((tree[1], end))
            return end
        if tree[0] == "then":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if tree[0] == "or":
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            again = self.state()
            self.free[start].append(again)
            self.free[self.add(part, again)].append(again)
            self.free[again].append(end)
        else:
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.add(part, start)
                self.free[start].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + class_of[byte]]`` is the next state; ``accepts[state]`` has a bit for each rule.

    State 0 is the start. ``resets`` marks bytes that lead every state to the start.
    """

    table: np.ndarray
    class_of: np.ndarray
    classes: int
    accepts: np.ndarray
    resets: np.ndarray


def compile_trees(trees: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction and minimisation; ``anywhere``: matches may begin at any byte."""
    net = Nondeterministic()
    first = net.state()
    for i, tree in enumerate(trees):
        begin = net.state()
        net.free[first].append(begin)
        net.accepts[net.add(tree, begin)] = 1 << i
    # Bytes that no step tells apart share a class.
    sets = sorted({s for steps in net.steps for s, _ in steps}, key=sorted)
    looks = [tuple(b in s for s in sets) for b in range(256)]
    numbers = {look: i for i, look in enumerate(dict.fromkeys(looks))}
    class_of = np.array([numbers[look] for look in looks], dtype="i4")
    sample = [int(np.argmax(class_of == c)) for c in range(len(numbers))]
    start = net.closed([first])
    found, rows, todo = {start: 0}, [], [start]
    for states in todo:
        row = []
        for byte in sample:
            after = {t for s in states for on, t in net.steps[s] if byte in on}
            after = net.closed(after) | start if anywhere else net.closed(after)
            if after not in found:
                found[after] = len(todo)
                todo.append(after)
            row.append(found[after])
        rows.append(row)
    accepts = [sum({net.accepts[s] for s in states if s in net.accepts}) for states in todo]
    return _minimal(np.array(rows), np.array(accepts), class_of)


def _minimal(rows: np.ndarray, accepts: np.ndarray, class_of: np.ndarray) -> Automaton:
    """Splits groups of states until all states of a group step to the same groups."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        looks = np.column_stack([group, group[rows]])
        _, first, finer = np.unique(looks, axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    # Group of the start first, so that it is state 0.
    order = np.argsort(np.where(np.arange(len(first)) == finer[0], -1, np.arange(len(first))))
    place = np.argsort(order)
    table = place[finer[rows[first[order]]]].astype("i4")
    resets = (table == 0).all(axis=0)[class_of]
    return Automaton(table.reshape(-1), class_of, rows.shape[1], accepts[first[order]].astype("i8"), resets)


class Scanner:
    """All rules in one pass; see the module."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [parse(r.pattern, r.any_case) for r in rules]
        self.starts = compile_trees([reverse(t) for t in trees], anywhere=True)
        self.ends = [compile_trees([t], anywhere=False) for t in trees]

    def flags(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where matches start, ascending, and the bits of the rules they belong to."""
        auto, n = self.starts, len(data)
        if not n:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        back = auto.class_of[data[::-1]]
        # Lanes begin after a byte that resets the automaton, near-equal lengths apart.
        cuts = np.flatnonzero(auto.resets[data[::-1]]) + 1
        wanted = np.arange(1, LANES) * (n / LANES)
        at = np.searchsorted(cuts, wanted)
        begins = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]]]))
        begins = begins[begins < n]
        lengths = np.diff(np.append(begins, n))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        left = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than each step
        state = np.zeros(len(begins), dtype="i4")
        places, bits = [], []
        width, table, accepts = auto.classes, auto.table, auto.accepts
        accepting = accepts > 0
        for step, live in enumerate(left.tolist()):
            here = begins[:live] + step
            now = table[state[:live] * width + back[here]]
            state[:live] = now
            hit = accepting[now]
            if hit.any():
                places.append(here[hit])
                bits.append(accepts[now[hit]])
        if not places:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        where, which = n - 1 - np.concatenate(places), np.concatenate(bits)
        order = np.argsort(where)
        return where[order], which[order]

    def longest(self, rule: int, data: bytes, start: int) -> int:
        """End of the longest match of a rule from ``start``; -1 without one."""
        auto, state, end = self.ends[rule], 0, -1
        table, class_of, width, accepts = _lists(auto)
        dead = _dead(auto)
        for i in range(start, len(data)):
            state = table[state * width + class_of[data[i]]]
            if state == dead:
                break
            if accepts[state]:
                end = i + 1
        return end

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule's number, end) in code points, ascending."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        joined = b"\xff".join(raw)  # a byte that no text has
        offsets = np.cumsum([0, *[len(r) + 1 for r in raw]])
        where, which = self.flags(np.frombuffer(joined, dtype="u1"))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule in enumerate(self.rules):
            mine = where[which >> k & 1 == 1]
            i = 0
            while i < len(mine):
                start = int(mine[i])
                end = self.longest(k, joined, start)
                text = int(np.searchsorted(offsets, start, side="right")) - 1
                if rule.keeps(joined[start:end].decode("utf-8", "replace")):
                    out[text].append((start - int(offsets[text]), k, end - int(offsets[text])))
                i = max(i + 1, int(np.searchsorted(mine, end)))
        for spans, data in zip(out, raw, strict=True):
            if spans:
                before = np.cumsum(np.frombuffer(data, dtype="u1") & 0xC0 != 0x80)
                before = np.concatenate([[0], before])
                spans[:] = sorted((int(before[a]), k, int(before[b])) for a, k, b in spans)
        return out


def _lists(auto: Automaton) -> tuple[list, list, int, list]:
    if not hasattr(auto, "_as_lists"):
        object.__setattr__(
            auto, "_as_lists", (auto.table.tolist(), auto.class_of.tolist(), auto.classes, auto.accepts.tolist())
        )
    return auto._as_lists


def _dead(auto: Automaton) -> int:
    """The state that nothing leaves and that accepts nothing; -1 without one."""
    rows = auto.table.reshape(-1, auto.classes)
    stuck = np.flatnonzero((rows == np.arange(len(rows))[:, None]).all(axis=1) & (auto.accepts == 0))
    return int(stuck[0]) if len(stuck) else -1


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per process."""
    return Scanner(rules)


# --- on DataFrames ----------------------------------------------------------


def find_secrets(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + FURTHER, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (all by default) and ``found``, an array of (kind, start, end), by start and rule order."""

    def work() -> Callable[[list[str]], list[tuple]]:
        kinds = [r.kind for r in rules]

        def rows(texts: list[str]) -> list[tuple]:
            return [
                ([{"kind": kinds[k], "start": a, "end": b} for a, k, b in spans],)
                for spans in scanner(rules).scan(texts)
            ]

        return rows

    schema = "found array<struct<kind: string, start: bigint, end: bigint>>"
    return map_text(df, text, schema, work, df.columns if keep is None else keep)


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + FURTHER) -> DataFrame:
    """The rows with each secret replaced by ``[kind]``; overlapping spans become one, named after the first.

    ``n_chars``, where the table has it as a number, follows the new text. A null text stays null.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    names, kinds = df.columns, [r.kind for r in rules]
    at = names.index(text)
    count = names.index("n_chars") if "n_chars" in names and dict(df.dtypes)["n_chars"] in ("int", "bigint") else None

    def changed(t: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for a, k, b in spans:
            if a >= done:
                out += [t[done:a], f"[{kinds[k]}]"]
            done = max(done, b)
        return "".join([*out, t[done:]])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(at).to_pylist()
                spans = scanner(rules).scan([t or "" for t in texts])
                new = [t if t is None else changed(t, s) for t, s in zip(texts, spans, strict=True)]
                columns = part.columns
                columns[at] = pa.array(new, type=part.column(at).type)
                if count is not None:
                    sizes = [n if t is None else len(t) for t, n in zip(new, columns[count].to_pylist(), strict=True)]
                    columns[count] = pa.array(sizes, type=columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def digest(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def secret_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base kinds, the digest of base spans and all spans, one row per row of ``df``."""

    def work() -> Callable[[list[str]], list[tuple]]:
        rules = BASE + FURTHER
        kinds = [r.kind for r in rules]

        def row(spans: list[tuple[int, int, int]]) -> tuple:
            base = [(kinds[k], a, b) for a, k, b in spans if k < len(BASE)]
            counts = [sum(kind == r.kind for kind, _, _ in base) for r in BASE]
            every = digest((kinds[k], a, b) for a, k, b in spans)
            return (*counts, hashlib.sha256(digest(base).encode()).hexdigest(), every)

        return lambda texts: [row(spans) for spans in scanner(rules).scan(texts)]

    schema = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_text(df, text, schema, work, [key])
