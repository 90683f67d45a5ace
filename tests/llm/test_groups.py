"""Near-duplicates, components, mixing and toxicity against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardtable.llm import components, golay, mixing, simhash, toxicity


def merged(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    draw = random.Random(1)
    names = [f"{i:04d}" for i in range(400)]
    pairs = [(draw.choice(names), draw.choice(names)) for _ in range(250)] + list(zip(names[:60], names[1:61], strict=True))
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = merged(names, pairs)
    assert got == {n: want[n] for n in {x for p in pairs for x in p}}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- the code ---------------------------------------------------------------


def test_code_is_perfect_and_keys_meet_within_two_bits():
    assert np.bincount(np.bitwise_count(golay.errors().astype("u8"))).tolist() == [1, 23, 253, 1771]
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 2000)
    rows, found = golay.keys(words)
    keys = [set(found[rows == i].tolist()) for i in range(500)]
    for i in range(500):
        around = np.concatenate([[words[i]], words[i] ^ (1 << np.arange(23))])
        assert keys[i] == set(golay.nearest(around).tolist())
        a, b = draw.choice(23, 2, replace=False)
        near = int(words[i]) ^ (1 << int(a)) ^ (1 << int(b))
        assert keys[i] & set(golay.keys(np.array([near]))[1].tolist())


def cluster(draw, size, flips):
    """Fingerprints a few bits away from one another and some far ones."""
    base = int(draw.integers(0, 1 << 62))
    out = {base}
    while len(out) < size:
        word = base
        for b in draw.choice(64, int(draw.integers(0, flips + 1)), replace=False):
            word ^= 1 << int(b)
        out.add(word)
    return out


@pytest.mark.parametrize("together", [1024, 40])
def test_no_link_is_lost(spark, monkeypatch, together):
    """Also when groups of a key are dealt out as pairs of blocks."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    draw = np.random.default_rng(2)
    prints = set(draw.integers(0, 1 << 62, 300).tolist()) | cluster(draw, 400, 3) | cluster(draw, 60, 9) | {0, 1, 15, 31}
    signed = [(int(np.uint64(p).view("i8")),) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "f0 bigint"), simhash.EXACT_64).collect()
    pairs = [(int(r["a"], 16), int(r["b"], 16)) for r in found]
    every = sorted(prints)
    brute = [(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert merged(every, pairs) == merged(every, brute)


def near_texts():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(40):
        base = [draw.choice(words) for _ in range(draw.choice([3, 40, 400]))]
        copy = list(base)
        copy[draw.randrange(len(copy))] = "changed"
        texts += [base, base, copy]
    return [(i, " ".join(t).title() if i % 2 else " ".join(t), "a") for i, t in enumerate(texts)]


def test_simhash_rows(docs):
    rows = [*near_texts(), (200, None, "a"), (201, "", "a"), (202, " \t", None), (203, "One", "a")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows), simhash.EXACT_64).collect()}
    prints = {i: simhash.fingerprint(t or "", 4)[0] & (1 << 64) - 1 for i, t, _ in rows}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = merged(ids, pairs)
    for i in ids:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[i]:016x}", want[i])
    assert got[200]["fingerprint"] == "0" * 16
    assert simhash.near_duplicates(docs([]), simhash.EXACT_64).count() == 0


def test_fingerprint_bits(spark):
    text = "Ünder THE old oak tree the OLD oak"
    shingles = [" ".join(text.split()[i : i + 4]) for i in range(5)]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    frame = spark.createDataFrame([(s.translate(lower),) for s in shingles], "s string")
    hashes = [r[0] & (1 << 64) - 1 for r in frame.selectExpr("xxhash64(s)").collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, 4)[0] & (1 << 64) - 1 == want


def test_one_of_each_group_stays(docs):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(30):
        base = [draw.choice(words) for _ in range(200)]
        other = [*base[:100], "changed", *base[101:]]
        ids = [3 * g, 3 * g + 1, 3 * g + 2]
        groups.append(ids)
        rows += [(ids[0], " ".join(base), "a"), (ids[1], " ".join(base), "b"), (ids[2], " ".join(other), "c")]
    rows += [(0, rows[0][1], "a"), (500, "a text of its own that nothing else is like", None), (None, "no key", "a")]
    df = docs(rows)
    kept = simhash.drop_near_duplicates(df, simhash.EXACT_64)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i))
    assert len(ids) == len(set(ids)) and {500, None} <= set(ids)
    prints = {i: simhash.fingerprint(t, 4)[0] & (1 << 64) - 1 for i, t, _ in rows if i is not None}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert set(ids) - {None} == set(merged(prints, pairs).values())
    assert all(g[0] in ids and g[1] not in ids for g in groups)


# --- mixing -----------------------------------------------------------------


def plain_targets(sizes, weights, total, most=3):
    """``total`` shared by weight; none gets over ``most`` times its size, the excess goes on by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if rest * weights[i % len(weights)] > most * sizes[i] * weight}
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else rest * weights[i % len(weights)] / weight
        rest -= sum(most * sizes[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def spark_targets(spark, sizes, weights):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(len(sizes))]
    patterns = spark.createDataFrame([([n], s) for n, s in zip(names, sizes)], "_members array<string>, _words bigint").repartition(3)
    got = {r["_name"]: r for r in mixing.source_targets(patterns, weights).collect()}
    assert sorted(got) == names and [got[n]["_s"] for n in names] == list(range(len(names)))
    return [got[n]["_target"] for n in names]


def test_targets_of_many_sizes(spark):
    draw = random.Random(12)
    for sizes in ([draw.choice([0, 1, 10, 10**4, 10**12]) + draw.randrange(9) for _ in range(60)], [5], [0, 0], [10, 1000, 1000]):
        assert spark_targets(spark, sizes, [5, 2, 1]) == pytest.approx(plain_targets(sizes, [5, 2, 1], sum(sizes)))


def test_targets_stop_at_three_times_the_size():
    assert plain_targets([100, 100, 100], [5, 2, 1], 300) == [300 * 5 / 8, 300 * 2 / 8, 300 * 1 / 8]
    got = plain_targets([10, 1000, 1000], [5, 2, 1], 2010)
    assert got[0] == 30.0 and got[1] == pytest.approx(1320) and sum(got) == pytest.approx(2010)
    assert plain_targets([], [], 0) == [] and plain_targets([0, 0], [5, 2], 0) == [0.0, 0.0]


def cheapest(patterns, quotas, costs):
    """All integer flows of tiny cases."""
    best = None

    def go(i, left, cost):
        nonlocal best
        if i == len(patterns):
            key = (sum(left), cost)
            best = key if best is None or key < best else best
            return
        members, words = patterns[i]

        def give(k, left, given):
            if k == len(members):
                rest, price = given, 0
                for c in costs:
                    price += c * min(rest, words)
                    rest -= min(rest, words)
                go(i + 1, left, cost + price)
                return
            s = members[k]
            for x in range(min(left[s], len(costs) * words - given) + 1):
                give(k + 1, [*left[:s], left[s] - x, *left[s + 1 :]], given + x)

        give(0, left, 0)

    go(0, list(quotas), 0)
    return best


def test_route_is_cheapest():
    draw = random.Random(3)
    for _ in range(40):
        quotas = [draw.randrange(5) for _ in range(3)]
        patterns = [(sorted(draw.sample(range(3), draw.randint(1, 3))), draw.randrange(3)) for _ in range(3)]
        flow = mixing.route(patterns, quotas)
        price = sum(c * x for row in flow for c, x in zip((0, 1, 3), row, strict=True))
        assert (sum(quotas) - sum(map(sum, flow)), price) == cheapest(patterns, quotas, (0, 1, 3))


def test_route_of_many_overlapping_patterns():
    """All quotas are met, as far as words reach, where 5,000 patterns share 300 sources."""
    draw = random.Random(6)
    patterns = [(sorted(draw.sample(range(300), draw.randint(1, 4))), draw.randrange(1, 1000)) for _ in range(5000)]
    quotas = [draw.randrange(0, 12_000) for _ in range(300)]
    flow = mixing.route(patterns, quotas)
    assert sum(map(sum, flow)) == sum(quotas)
    for (_, words), (a, b, c) in zip(patterns, flow, strict=True):
        assert (not b or a == words) and (not c or b == words) and 0 <= min(a, b, c) <= max(a, b, c) <= words


def test_many_sources_of_one_document(spark, docs):
    """Twenty thousand sources: more than any table of the driver should hold, and none is refused."""
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.hex("id").alias("source")
    )
    got = mixing.mix_report(df).agg(F.count(F.lit(1)), F.sum("target"), F.sum("size"), F.max(F.col("taken") - 3 * F.col("size"))).first()
    assert got[0] == 20_000 and got[1] == pytest.approx(got[2]) and got[3] <= 0


def test_components_flow_apart(spark):
    """Two ties of sources, a source alone, and rows without any: as one flow over everything would have it."""
    draw = random.Random(9)
    kinds = [["a"], ["a", "b"], ["b", "c"], ["d", "e"], ["e"], ["f"], None, []]
    rows = [(i, "w " * draw.randrange(1, 40), kinds[i * 7 % 8]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")
    words = {}
    for _, text, kind in rows:
        words[tuple(kind or [None])] = words.get(tuple(kind or [None]), 0) + len(text.split())
    names = ["a", "b", "c", "d", "e", "f", None]
    sizes = [sum(n for kind, n in words.items() if s in kind) for s in names]
    quotas = [round(v) for v in plain_targets(sizes, [5, 2, 1], sum(words.values()))]
    whole = mixing.route([([names.index(s) for s in kind], n) for kind, n in words.items()], quotas)
    patterns = spark.createDataFrame([(list(k), n) for k, n in words.items()], "_members array<string>, _words bigint")
    shares = {tuple(r[0]): (r[1], r[2]) for r in mixing.pattern_shares(patterns, mixing.source_targets(patterns)).collect()}
    assert len(shares) == len(words)
    assert sum(w * words[k] + rest for k, (w, rest) in shares.items()) == sum(map(sum, whole))
    for alone in (("f",), (None,)):
        assert sum(whole[list(words).index(alone)]) == shares[alone][0] * words[alone] + shares[alone][1]
    taken = mixing.mix(df).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in taken) <= 3


def test_mix_meets_targets(docs):
    draw = random.Random(4)
    rows = [(i, "w " * draw.randrange(1, 60), draw.choice(["a", "b", "c", None])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "zero"), (1002, "x " * 5000, "b")]
    df = docs(rows)
    got = mixing.mix_report(df).collect()
    again = sorted(map(tuple, mixing.mix_report(df.repartition(3)).collect()))
    assert sorted(map(tuple, got)) == again and len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    for s in {"a", "b", "c", None, "zero"}:
        mine = [r for r in got if source[r["doc_id"]] == s]
        taken = sum(r["taken"] for r in mine)
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= 60
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    times = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert all(times.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in got)
    assert mixing.mix_report(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0


def test_rows_that_share_a_key_are_mixed_each_for_itself(docs):
    draw = random.Random(14)
    rows = [(None if i % 3 else i, f"t{i} " + "w " * draw.randrange(1, 60), "abc"[i % 7 % 3]) for i in range(600)]
    rows += [(7, f"u{i} " + "w " * 20, "abc"[i % 3]) for i in range(60)] + [(8, "same " * 9, "c")] * 20
    df = docs(rows)
    want = {r["target"]: r for r in mixing.mix_report(df).collect()}
    mixed = mixing.mix(df).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    targets = dict(zip("abc", plain_targets([sizes[s] for s in "abc"], mixing.WEIGHTS, sum(sizes.values())), strict=True))
    assert sorted(want) == pytest.approx(sorted(targets.values()))
    for s in "abc":
        assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == s) - targets[s]) <= 60
    times = {}
    for r in mixed:
        times[r["text"]] = times.get(r["text"], 0) + 1
    assert all(n <= 3 for t, n in times.items() if not t.startswith("same"))
    assert sorted(r["text"] for r in mixed) == sorted(r["text"] for r in mixing.mix(df.repartition(3)).collect())


def test_repeated_keys_with_other_texts_stay(docs):
    draw = random.Random(15)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    rows = [(1, t, "a") for t in texts] + [(1, texts[0], "b"), (2, texts[1], "a")]
    kept = simhash.drop_near_duplicates(docs(rows), simhash.EXACT_64).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((1, t) for t in texts)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 2 else ["a", "b"]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")
    times = mixing.mix(df).groupBy("doc_id").count().collect()
    assert 150 <= sum(r["count"] for r in times) <= 210 and max(r["count"] for r in times) <= 3


# --- toxicity ---------------------------------------------------------------


def labelled(spark, docs):
    draw = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        text = [draw.choice(words) for _ in range(draw.randrange(5, 80))]
        if bad:
            text[draw.randrange(len(text))] = draw.choice(["nasty", "Vile!", "foul,"])
        rows.append((i, " ".join(text), "a"))
        labels.append((i, int(bad), None, "clash"))
    rows += [(2000, None, None), (2001, "", "a"), (2002, "nasty " * 4000, "a"), (3, "nasty", "a")]
    labels += [(5000, 1, 1, "x"), (None, 1, 1, "x"), (7, None, 1, "x")]
    return docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int, text string")


def test_toxic_words_are_learned(spark, docs):
    df, labels = labelled(spark, docs)
    got = toxicity.toxicity_report(df, labels).collect()
    assert len(got) == 904 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.97 * len(held) and len(held) > 100
    model = toxicity.train(df, labels)
    assert 0 < len(model[0]) < 3000  # L1 leaves few weights
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {2000, 2001} <= {r["doc_id"] for r in kept.collect()}


def test_toxicity_without_rows_or_kinds(spark, docs):
    df, labels = labelled(spark, docs)
    assert toxicity.toxicity_report(docs([]), labels).count() == 0
    scores = toxicity.toxicity_report(df, labels.limit(0)).collect()
    assert len(scores) == 904 and all(r["score"] < 0.01 for r in scores)
    one = toxicity.toxicity_report(df, labels.filter("toxic = 1")).collect()
    assert all(r["score"] > 0.99 for r in one)
