"""Vector codes, resharding and importance resampling against brute force on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrispark.llm import resampling, sharding, veccodes
from rows import awkward, prose

RAW = awkward()
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("x", T.StringType()),
    ])
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], schema)


def some_vectors(n, dims=12, seed=2):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        v = [round(c + rng.gauss(0, 0.05), 2) for c in rng.choice(centres)]
        rows.append((n - i, v, (1, 2, None)[i % 3]))
    return [*rows, (None, rows[3][1], 1), *rows[5:8], (7001, None, 1), (7002, [0.5] * (dims - 1) + [None], 1), (7003, [NAN] * dims, 2), (7004, [INF] + [0.0] * (dims - 1), None)]


def coded(rows, parts, entries, rounds):
    """The product codes in plain Python integers, without any transform."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((away(v[p * width:(p + 1) * width], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                members[p, near(v, p)[1]].append(v[p * width:(p + 1) * width])
        for (p, k), parts_of in members.items():
            books[p][k] = [sum(c) // len(c) for c in zip(*parts_of)]
    found = [(i, lab, [near(v, p) for p in range(parts)]) for i, v, lab in kept]
    total = Counter()
    for _, lab, hits in found:
        total[lab] += sum(d for d, _ in hits)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits), total[lab]) for i, lab, hits in found), digest


@pytest.mark.parametrize(("dims", "parts", "entries"), [(12, 4, 16), (8, 2, 256), (20, 4, 7)])
def test_codes_equal_brute_force(spark, dims, parts, entries):
    rows = some_vectors(60, dims)
    wanted, digest = coded(rows, parts, entries, 3)
    got = veccodes.compressed(vectors(spark, rows), parts, entries, 3).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == wanted
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_nothing_and_of_unusable_shapes(spark):
    assert veccodes.compressed(vectors(spark, [])).count() == 0
    assert veccodes.compressed(vectors(spark, [(1, None, 1), (2, [NAN] * 4, 1)])).count() == 0
    for rows in ([(1, [0.0] * 8, 1), (2, [0.0] * 12, 1)], [(1, [0.0] * 6, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            veccodes.compressed(vectors(spark, rows))


def test_decoded_codes_are_the_entries(spark):
    kept = veccodes.integers(vectors(spark, some_vectors(40)))
    books, kind = veccodes.fit_codebooks(kept, 4, 8, 2)
    for r in veccodes.decode(veccodes.encode(kept, books, kind), books).collect():
        entries = [books.entries[p][int(r["code"][2 * p:2 * p + 2], 16)] for p in range(4)]
        assert r["embedding"] == [x / 1024 for e in entries for x in e.tolist()]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 16])
def test_transform_keeps_distances(width):
    rng = np.random.default_rng(width)
    x, e = rng.integers(-900, 900, (300, width)), rng.integers(-900, 900, (33, width))
    e[7] = e[3]  # a tie
    x[:40] = e[rng.integers(0, 33, 40)]
    size = veccodes.walsh(x).shape[1]
    plain = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (((veccodes.walsh(x)[:, None] - veccodes.walsh(e)[None]) ** 2).sum(2) == size * plain).all()
    index, distance = veccodes.nearest(veccodes.walsh(x), veccodes.walsh(e))
    assert (index == plain.argmin(1)).all() and (distance == plain.min(1)).all()


def test_walsh_functions_come_by_sign_changes():
    rows = veccodes.walsh(np.eye(16, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(16))


def test_reshards_evenly_and_moves_the_fewest_bytes(docs):
    got = sharding.grown(docs, 4, 6).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(by_id) == len(RAW)
    sizes, before, moved = Counter(), Counter(), 0
    for doc_id, text, *_ in RAW:
        r, data = by_id[doc_id], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
        before[r["old_shard"]] += r["size"]
        moved += r["size"] * (r["shard"] != r["old_shard"])
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    even = sum(sizes.values()) / 6
    assert all(abs(sizes[j] - even) <= largest for j in range(6))
    assert abs(moved - sum(max(0, n - even * (i < 6)) for i, n in before.items())) <= largest
    again = sharding.grown(docs.repartition(7), 4, 6).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in got)


def test_many_documents_meet_their_shards_closely(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(1, 400)) for i in range(3000)] + [(None, "same")] * 500
    got = sharding.grown(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8)
    sizes = [r["n"] for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert got.count() == 3500 and len(sizes) == 8 and max(sizes) - min(sizes) <= 20


def test_untouched_blocks_keep_their_files(spark):
    rows = [(i, "word " * (i % 50)) for i in range(800)]
    stored = sharding.laid_out(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    layout = sharding.resharded(stored, lambda total: sharding.even_capacities(total, 6))
    files = layout.select("to", "unit", F.input_file_name().alias("file"), "doc.doc_id", "doc.text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in files) == sorted(rows)
    old = set(stored.inputFiles())
    stays = [r for r in files if r["file"] in old]
    assert stays and all(r["to"] == r["unit"] // sharding.MOST_BLOCKS for r in stays)
    assert not {r["unit"] for r in stays} & {r["unit"] for r in files if r["file"] not in old}


def cheapest(supply, capacity, cost):
    """The least cost over all integer flows, by trying them."""
    best = math.inf
    goals = list(capacity)
    shares = [[s for s in itertools.product(range(n + 1), repeat=len(goals)) if sum(s) == n] for n in supply.values()]
    for pick in itertools.product(*shares):
        if all(sum(p[k] for p in pick) <= capacity[j] for k, j in enumerate(goals)):
            best = min(best, sum(p[k] * cost(i, j) for i, p in zip(supply, pick) for k, j in enumerate(goals)))
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(25):
        supply = {i: rng.randint(0, 4) for i in range(3)}
        capacity = {j: rng.randint(0, 4) for j in range(3)}
        capacity[2] += max(0, sum(supply.values()) - sum(capacity.values()))
        prices = {(i, j): rng.randint(0, 5) for i in supply for j in capacity}
        cost = lambda i, j: prices[i, j]
        flow = sharding.cheapest_flow(supply, capacity, cost)
        assert all(sum(n for (i, _), n in flow.items() if i == k) == supply[k] for k in supply)
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= capacity[k] for k in capacity)
        assert sum(n * cost(*k) for k, n in flow.items()) == cheapest(supply, capacity, cost)
    with pytest.raises(ValueError):
        sharding.cheapest_flow({0: 2}, {0: 1})


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(lower)


def grams(text, longest):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_ranks_equal_brute_force(spark, docs, longest):
    target = [(1, "ETAOIN word emoji 日本語"), (2, None), (3, prose(random.Random(1), 300))]
    buckets = 500
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for r in RAW for g in grams(r[1], longest))
    t = Counter(bucket(g) for _, x in target for g in grams(x, longest))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    wanted = {}
    for doc_id, text, *_ in RAW:
        features = grams(text, longest)
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in features)
        wanted[doc_id] = (len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-wanted[r[0]][2], r[0]) for r in RAW if len(words_of(r[1])) >= 20)
    drawn = {d: k + 1 for k, (_, d) in enumerate(able[:25 * len(able) // 100])}
    frame = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.importance_ranks(docs, frame, buckets, longest, percent=25).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"]) for r in got} == wanted
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"] is not None} == drawn and len(drawn) > 3
    some = resampling.resampled(docs, frame, buckets=buckets, longest=longest, percent=25)
    assert some.columns == docs.columns and sorted(r["doc_id"] for r in some.collect()) == sorted(drawn)


def test_crcs_of_runs_equal_the_library():
    rng = random.Random(5)
    texts = [None, b"", b"...", b"One", *[prose(rng, rng.randint(1, 60), "etaoinß9").encode() for _ in range(40)], b"y" * 70_000 + b" z"]
    crcs, owner, n_words = resampling.run_crcs(texts, 4)
    for k, text in enumerate(texts):
        wanted = [zlib.crc32(g.encode()) for g in grams((text or b"").decode(), 4)]
        assert crcs[owner == k].tolist() == wanted and n_words[k] == len(words_of((text or b"").decode()))


def test_repeated_rows_and_empty_targets(spark, with_odd_ids, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    got = resampling.importance_ranks(with_odd_ids, nothing, percent=100).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == with_odd_ids.count() and ranks == list(range(1, len(ranks) + 1))
    assert all((r["rank"] is None) == (r["n_features"] < 20) for r in got)
    assert resampling.importance_ranks(empty, nothing).count() == 0
    assert sharding.grown(empty).count() == 0 and sharding.grown(with_odd_ids, 3, 4).count() == with_odd_ids.count()
