"""Empty tables and clashing columns for operators on pages, turns and texts; learning and hashing against plain versions."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash

from wardtable.llm import bpe, chat, html, minhash, quality, queries, secrets, toxicity, urls

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PAGE_CLASH = "host string, path string, rule string, verdict string, text string, _text string, _id bigint, _host string, key bigint"
TURN_CLASH = "_tree string, _node bigint, _parent bigint, _up bigint, _score double, leaf bigint, n_turns int, loss_chars int"
PAGES = [
    (1, "http://a.org/en/1", "<article><p>One  two</p></article>"),
    (2, "http://a.com/de/1", None),
    (3, None, ""),
    (3, None, ""),
    (None, "http://b.net/x", "<p>tail</p>"),
    (5, "no scheme", "<main>" + "<p>long line</p>" * 20_000 + "</main>"),
]
TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "<|im_end|>"), (2, 1, "assistant", "y" * 200_000), (2, 1, "assistant", "z")]


def wide(spark, rows, schema, clash):
    """A table of its own columns and the same rows with further columns whose names clash."""
    plain = spark.createDataFrame(rows, schema)
    more = [c.strip().split(" ") for c in clash.split(",")]
    added = plain.selectExpr("*", *[f"cast(1 as {kind}) as {name}" for name, kind in more])
    return plain, added


def shown(df):
    return sorted(map(str, df.collect()))


PAGE_OPERATORS = {
    "html": html.extraction_report,
    "urls": lambda df: urls.judge_urls(df, queries.URL_RULES),
}


@pytest.mark.parametrize("name", PAGE_OPERATORS)
def test_pages(spark, name):
    f = PAGE_OPERATORS[name]
    plain, added = wide(spark, PAGES, "page_id bigint, url string, html string", PAGE_CLASH)
    want = f(plain)
    assert want.count() == len(PAGES)
    assert shown(f(added)) == shown(want)
    assert f(added.limit(0)).count() == 0 and f(added.limit(0)).columns == want.columns


def test_page_texts(spark):
    plain, _ = wide(spark, PAGES, "page_id bigint, url string, html string", PAGE_CLASH)
    got = {r["page_id"]: r["text"] for r in html.extraction_report(plain).collect()}
    assert got[1] == "One two" and got[2] == "" and got[3] == "" and got[5] == "\n".join(["long line"] * 20_000)


def test_turns(spark):
    plain, added = wide(spark, TURNS, "conv_id bigint, turn bigint, role string, text string", TURN_CLASH)

    def f(df):
        return chat.conversation_report(chat.format_conversations(df))

    want = f(plain)
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in want.collect()} == {1: (2, 0), 2: (3, 200_001)}
    assert shown(f(added)) == shown(want)
    assert f(added.limit(0)).count() == 0 and f(added.limit(0)).columns == want.columns


TEXT_OPERATORS = {
    "secrets": secrets.secret_report,
    "bpe": lambda df: bpe.encode_digests(df, RANKS, public_tokenizers.PATTERN, keep=["doc_id"]),
    "quality": quality.judge,
    "minhash": minhash.fingerprint_report,
}


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_texts(docs, name):
    f = TEXT_OPERATORS[name]
    rows = [(1, "password = abcdefgh12345678", "a"), (2, None, None), (3, "", "a"), (3, "", "a"), (None, "x y", "b"), (5, "w " * 30_000, "a")]
    df = docs(rows)
    want = f(df.select("doc_id", "text", "source"))
    assert want.count() == len(rows)
    assert shown(f(df)) == shown(want)
    assert f(df.limit(0)).count() == 0 and f(df.limit(0)).columns == want.columns


def test_redaction_of_no_rows(docs):
    none = docs([])
    kept = secrets.redact(none)
    assert kept.columns == none.columns and kept.count() == 0


# --- toxicity against plain versions ----------------------------------------


def plain_features(text):
    """Places and values by the definition, word by word in whole numbers."""
    full = (1 << 64) - 1
    mix, odd = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    words = ["".join(c for c in raw.lower() if c.isalnum()) for raw in text.split()]
    words = [w for w in words if w]
    one = [xxhash.xxh64_intdigest(w) for w in words]
    found = list(one)
    found += [xxhash.xxh64_intdigest(f"{n}{w[:n]}") for w in words for n in (5, 6, 7) if len(w) > n]
    found += [((a * mix + b) * odd) & full for a, b in zip(one, one[1:])]
    found += [((a * odd + b) * mix) & full for a, b in zip(one, one[2:])]
    counts = {}
    for value in found:
        counts[value >> 44] = counts.get(value >> 44, 0) + 1
    return {place: 1 + math.log(n) for place, n in counts.items()}


@pytest.mark.parametrize("text", ["", "  \n", "-- !!", "One", "Don't stop, DON'T stop: naïve Überraschungen 12345678", "a b " * 50])
def test_features_by_definition(text):
    places, values = toxicity.features(text)
    want = plain_features(text)
    assert places.tolist() == sorted(want)
    assert np.allclose(values, [want[p] for p in sorted(want)])


def plain_ftrl(rows, how):
    """Per-coordinate FTRL-proximal in plain loops: weights by place, the constant under None."""
    z, n, order = {}, {}, np.random.default_rng(how.seed)

    def weight(k):
        l1 = 0.0 if k is None else how.l1
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        sign = 1.0 if z[k] > 0 else -1.0
        return -(z[k] - sign * l1) / ((how.beta + math.sqrt(n[k])) / how.alpha + how.l2)

    for _ in range(how.passes):
        for i in order.permutation(len(rows)):
            places, values, y = rows[i]
            x = {None: 1.0, **dict(zip(places.tolist(), values.tolist()))}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                g = (p - y) * x[k]
                before = n.get(k, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / how.alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = before + g * g
    return {k: w for k in z if (w := weight(k)) or k is None}


@pytest.mark.parametrize("how", [toxicity.Settings(), toxicity.Settings(alpha=0.3, beta=0.5, l1=0.2, l2=1.0, passes=2, seed=3)])
def test_fit_is_plain_ftrl(how):
    draw = random.Random(5)
    rows = []
    for i in range(150):
        text = [f"w{draw.randrange(40)}" for _ in range(draw.randrange(1, 25))] + (["vile"] if i % 3 == 0 else [])
        rows.append((*toxicity.features(" ".join(text)), int(i % 3 == 0)))
    places, weights, constant = toxicity.fit(rows, how)
    want = plain_ftrl(rows, how)
    assert len(places) > 0 and math.isclose(constant, want.pop(None), rel_tol=1e-9)
    assert places.tolist() == sorted(want)
    assert np.allclose(weights, [want[p] for p in sorted(want)], rtol=1e-8, atol=1e-12)


# --- MinHash against a plain version ----------------------------------------


def plain_signature(text):
    """Smallest values of all hash functions over the shingles, in whole numbers."""
    full = (1 << 64) - 1
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    width = min(minhash.WORDS, len(words))
    shingles = []
    for start in range(len(words) - width + 1 if words else 0):
        value = 0
        for word in words[start : start + width]:
            value = ((value ^ word) * 0x9E3779B97F4A7C15) & full
            value ^= value >> 29
        shingles.append(value)
    draw = np.random.default_rng(1)
    a = [2 * int(v) + 1 for v in draw.integers(0, 1 << 63, minhash.SIZE, dtype="u8")]
    b = [int(v) for v in draw.integers(0, 1 << 63, minhash.SIZE, dtype="u8")]
    return [min([((s * x + y) & full) for s in shingles] or [full]) >> 32 for x, y in zip(a, b)]


def test_signature_by_definition():
    draw = random.Random(6)
    for size in (0, 1, 4, 5, 6, 80, 3000):
        text = " ".join(f"w{draw.randrange(50)}" for _ in range(size))
        assert minhash.signature(text).tolist() == plain_signature(text)


def test_likeness_estimates_the_share_of_common_shingles():
    draw = random.Random(7)
    errors = []
    for _ in range(60):
        base = [f"w{draw.randrange(5000)}" for _ in range(300)]
        cut = draw.randrange(20, 280)
        other = base[:cut] + [f"v{draw.randrange(5000)}" for _ in range(300 - cut)]
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        true = len(a & b) / len(a | b)
        found = minhash.likeness(minhash.signature(" ".join(base)), minhash.signature(" ".join(other)))
        errors.append(found - true)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.3


def test_keys_that_many_rows_share_are_cut_by_text(docs):
    rows = [(None, f"text {i} of no key " * 3, "a") for i in range(400)] + [(77, f"text {i} of one key", "a") for i in range(300)]
    rows += [(i, f"text {i} of its own key " * 2, "a") for i in range(200)] + [(-(1 << 62) - i, f"low {i}", "b") for i in range(60)]
    random.Random(8).shuffle(rows)

    def place(row):
        digest = xxhash.xxh64_intdigest(row[1].encode(), 42)  # as Spark's xxhash64, which is signed
        return (-(1 << 63) if row[0] is None else row[0], digest - (digest >> 63 << 64))

    order = sorted(rows, key=place)
    want = sorted(
        (str(i), minhash.edited(t, after).encode().hex()) for (i, t, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True)
    )
    got = minhash.with_next(docs(rows), "doc_id", "text", "changed string", lambda t, after: (minhash.edited(t, after).encode().hex(),))
    assert sorted((str(r["doc_id"]), r["changed"]) for r in got.collect()) == want
    ranges = minhash.in_ranges(docs(rows), "doc_id", "text").groupBy("_b").count().collect()
    assert len(ranges) > 10 and max(r["count"] for r in ranges) < 120
