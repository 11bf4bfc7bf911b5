"""Source divergence, packing and ball k-means against brute force, on awkward rows and with small parameters."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstack.llm import ball_kmeans, divergence, packing

from sample_docs import SCHEMA, rows

DATA = rows()
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 11 source divergence ------------------------------------------------------------------------


def audited(data, least, most):
    """What the audit is by its definition: every term of every group."""
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, _ in data]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen, total = Counter(t for d in mine for t in set(d[2])), Counter(t for d in mine for t in d[2])
        kept = [t for t, n in seen.items() if n >= least]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}

        def shares(c, kept=kept):
            over = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // over for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s in counts:
            parts = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]}
            parts["term"] = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                ranked = [(lang, s, part, i, -v, k) for k, (v, _, i) in enumerate(sorted(items), 1)]
                out += ranked if part == "pair" else ranked[:most]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, most, few", [(1, 3, 1), (5, 50, 4096), (30, 50, 4096), (10_000, 5, 2)])
def test_divergence_is_its_definition(spark, docs, least, most, few):
    assert got(divergence.source_divergence(docs, most, least, few)) == audited(DATA, least, most)


def test_divergence_cuts_long_ties_by_bytes(spark):
    stems = ["z", "zz", "zzz", "é", "éa", "日", "\U0001f600", "a", "ab", "abc", "abd", "zzÿ"]
    data = [(i, f"{w} {w}b common {w}", "en", f"s{i % 2}", 0) for i, w in enumerate(stems * 2)] + [(99, "common", "en", "s9", 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    for most, few in ((4, 1), (7, 1), (7, 2), (500, 1)):
        assert got(divergence.source_divergence(docs, most, 1, few)) == audited(data, 1, most)


def test_top_items_takes_values_of_any_size(spark):
    r = random.Random(4)
    data = [("en", f"s{g}", f"t{i}", r.choice([0, 1, 2047, 2048, 4095, 1 << 22, (1 << 30) + 1, r.randrange(1 << 31)])) for g in range(5) for i in range(200 if g else 3)]
    found = got(divergence.top_items(spark.createDataFrame(data, "lang string, source string, item string, value long"), 20, 3))
    assert found == sorted((x for g in range(5) for x in sorted((d for d in data if d[1] == f"s{g}"), key=lambda d: (-d[3], d[2]))[:20]), key=repr)


def test_divergence_on_clutter_and_nothing(spark, docs, cluttered, empty):
    assert got(divergence.source_divergence(cluttered, 3, 2)) == got(divergence.source_divergence(docs, 3, 2))
    assert divergence.source_divergence(empty).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(divergence.source_divergence(empty)) == []


# ---- 12 packing ----------------------------------------------------------------------------------


def fewest(items, capacity):
    """The least number of sequences, by trying."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                go(i + 1, rooms[:k] + [room - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def one_by_one(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return sorted(rooms)


def instances(n):
    r = random.Random(1)
    for _ in range(n):
        capacity, least = r.choice([10, 17, 30]), r.choice([1, 2, 3, 5])
        yield capacity, [r.randint(least, capacity) for _ in range(r.randint(1, 10))]


def test_reduction_keeps_an_optimum_and_best_fit_is_that_of_single_pieces():
    reduced = 0
    for capacity, items in instances(1500):
        fixed, rest = packing.reduce_by_dominance(Counter(items), capacity)
        assert all(sum(s * c for s, c in contents) <= capacity for contents, _ in fixed)
        assert Counter(items) == sum((Counter({s: c * n for s, c in contents}) for contents, n in fixed), Counter(rest))
        n = sum(n for _, n in fixed)
        assert fewest(items, capacity) == n + fewest(list(Counter(rest).elements()), capacity)
        reduced += n
        packed = packing.best_fit(Counter(items), capacity)
        assert sorted(capacity - sum(s * c for s, c in x) for x, n in packed for _ in range(n)) == one_by_one(items, capacity)
    assert reduced > 3000  # and there is something to it


def test_companions_beyond_pairs():
    assert packing.companions(packing.Lengths({6: 1, 3: 1, 1: 1}), 6, 10) == (3, 1)
    assert packing.companions(packing.Lengths({9: 2, 3: 4}), 9, 10) == ()
    assert packing.companions(packing.Lengths({7: 1, 2: 1, 3: 1}), 7, 10) == (3,)
    assert packing.companions(packing.Lengths({4: 1, 1: 9, 5: 1}), 4, 10) is None


def test_plan_of_a_large_histogram_is_small_and_near_its_bound():
    counts = {s: 10**9 // s for s in range(1, 2049)}
    plan = packing.plan_packing(counts)
    assert plan.sequences <= -(-sum(s * n for s, n in counts.items()) // 2048) + 1 and len(plan.cells["base"]) < 20_000


def check_packing(found, data, capacity):
    tokenizer = Tokenizer.from_file(VOCAB)
    tokenizer.encode_special_tokens = True
    want = []
    for doc_id, text, *_ in data:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
            start = max(0, end - capacity) if piece else 0
            want.append((doc_id, piece, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [16, 100, 2048])
def test_packing_of_awkward_rows(spark, docs, cluttered, capacity):
    n = check_packing(packing.pack_documents(docs, VOCAB, capacity).collect(), DATA, capacity)
    found = packing.pack_documents(cluttered.repartition(5), VOCAB, capacity).collect()
    assert check_packing(found, DATA, capacity) == n
    total = sum(r["length"] for r in found)
    assert n <= -(-total // capacity) * 1.1 + 1


def test_ranks_give_the_ids_of_the_tokenizer(tmp_path):
    tokenizer = Tokenizer.from_file(VOCAB)
    tokenizer.encode_special_tokens = True
    encode = packing.encoder(VOCAB)
    assert "encode_to_numpy" in repr(encode)
    r = random.Random(8)
    kinds = ["abc XYZ ", "it's we'll I'D ", "0123 ٣४ ", " \t\n\r\x85\xa0\u2003\u3000", "éßñ 日本語 한국 ", "!?…—\u200d\U0001f600\x1c\x00"]
    texts = ["".join(r.choices(r.choice(kinds) + r.choice(kinds), k=r.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, " " * 900, "<|endoftext|> x"]
    texts += [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}. {chr(c)}{chr(c)} x" for c in [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 97)]]
    assert all(encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
    raw = json.load(open(VOCAB))
    raw["model"]["merges"][0], raw["model"]["merges"][1] = raw["model"]["merges"][1], raw["model"]["merges"][0]
    (tmp_path / "other.json").write_text(json.dumps(raw))
    other = packing.encoder(str(tmp_path / "other.json"))
    assert "encode_to_numpy" not in repr(other) and other(" the cat").tolist() == Tokenizer.from_file(str(tmp_path / "other.json")).encode(" the cat").ids


def test_sequences_hold_the_ids_and_special_strings_are_text(spark, empty):
    data = [(i, "word " * i + "<|endoftext|>", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(data, SCHEMA)
    whole = packing.packed_sequences(docs, VOCAB, 32).collect()
    by_piece = {(d["doc_id"], d["piece"]): s["ids"][d["offset"] : d["offset"] + d["length"]] for s in whole for d in s["documents"]}
    tokenizer = Tokenizer.from_file(VOCAB)
    tokenizer.encode_special_tokens = True
    for i, text, *_ in data:
        pieces = [by_piece[k] for k in sorted(k for k in by_piece if k[0] == i)]
        ids = sum(pieces, [])
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [0] and 50256 not in ids
    assert packing.pack_documents(empty, VOCAB).collect() == [] and packing.packed_sequences(empty, VOCAB).collect() == []


def test_most_rows_of_one_length(spark):
    data = [(1, "same text", "en", "s", 0)] * 300 + [(2, None, "en", "s", 0)] * 200 + [(3, "another text here", "en", "s", 0)]
    check_packing(packing.pack_documents(spark.createDataFrame(data, SCHEMA).repartition(7), VOCAB, 16).collect(), data, 16)


# ---- 13 ball k-means -----------------------------------------------------------------------------


def lloyd(data, k, rounds, dim, scale=64, seed=1):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in data if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=order)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*members[j], strict=True)] if members[j] else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), names[j]) for i, j, d in found), key=repr)


AWKWARD = [(900, None), (901, [1.0]), (902, [float("nan")] * 4), (903, [None, 1.0, 1.0, 1.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, []), (None, [0.5, 0.5, 0.5, 0.5]), (7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0])]


@pytest.mark.parametrize("k, rounds, spread", [(16, 3, 1.0), (5, 4, 0.02), (40, 2, 30.0), (500, 1, 1.0), (1, 2, 1.0)])
def test_balls_give_what_lloyd_gives(spark, k, rounds, spread):
    r = np.random.default_rng(k)
    data = [(i, (r.normal(size=4) * spread + r.integers(0, 3, size=4)).tolist()) for i in range(300)] + AWKWARD
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "cluster", "distance", "m")})
    found = ball_kmeans.cluster_vectors(vectors, k, rounds, dim=4)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(found) == lloyd(data, k, rounds, 4)


def test_ties_go_to_the_smaller_number_and_cores_are_left_alone(monkeypatch):
    centroids = np.array([[10, 0], [-10, 0], [0, 30], [10, 0]])
    balls = ball_kmeans.make_balls(centroids, np.full(4, np.inf))
    x = np.array([[0, 0], [10, 0], [9, 1], [0, 29], [1, 0]])
    for start in range(4):
        cluster, distance = ball_kmeans.assign(x, np.full(5, start, dtype=np.int32), balls)
        assert cluster.tolist() == [0, 0, 0, 2, 0] and distance.tolist() == [100, 0, 2, 1, 81]
    seen = []
    monkeypatch.setattr(ball_kmeans, "squares", lambda a, c, f=ball_kmeans.squares: seen.append(len(a)) or f(a, c))
    far = ball_kmeans.make_balls(np.array([[0, 0], [100, 0], [0, 400]]), np.array([20.0, 20.0, 20.0]))
    assert [n.tolist() for n in far.neighbours] == [[], [], []]
    wide = ball_kmeans.make_balls(np.array([[0, 0], [100, 0], [0, 400]]), np.array([90.0, 20.0, 20.0]))
    assert [n.tolist() for n in wide.neighbours] == [[1], [], []]
    seen.clear()
    ball_kmeans.assign(np.array([[1, 1], [49, 0], [50, 0], [88, 0]]), np.zeros(4, dtype=np.int32), wide)
    assert seen == [4, 2]  # all against their own, the outer ring against its only neighbour


def test_no_vectors_and_large_ones(spark):
    kind = "vec_id long, embedding array<double>"
    assert ball_kmeans.cluster_vectors(spark.createDataFrame([], kind)).collect() == []
    data = [(i, [s * 3e6 * (1 - i / 50)] * 2) for i, s in enumerate([1, -1] * 6)]
    rows_ = spark.createDataFrame([*data, (99, [1e200, 0.0])], kind)
    assert got(ball_kmeans.cluster_vectors(rows_, 3, 2, dim=2)) == lloyd(data, 3, 2, 2)


def test_terms_are_counted_in_compiled_code(spark):
    """Functions of each element of an array are interpreted; terms are counted from plain rows."""
    from quillstack.llm.divergence import term_counts

    rows = spark.createDataFrame([("b a, B", "x", "s"), ("a--c1c", "x", "s"), ("", "x", "s"), (None, "x", "s")], "text string, lang string, source string")
    found = term_counts(rows)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["term"], r["n"], r["docs"]) for r in found.collect()) == [("a", 2, 2), ("b", 2, 1), ("c", 2, 1)]
