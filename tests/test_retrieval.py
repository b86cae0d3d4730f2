"""Retrieval against brute force, with several query blocks and ties."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from agrispark.operators import cells, cleanse, context, pruned, retrieval
from agrispark.rules import corpus as rc

WORDS = "soil lime water root leaf seed rain pest crop yield the and of".split()


def texts(n, seed):
    rng = random.Random(seed)
    return {f"c{i:03d}": " ".join(["the"] * rng.randint(0, 6) + rng.choices(WORDS, k=rng.randint(0, 30))) for i in range(n)}


def okapi(corpus, query):
    token = lambda t: [x for x in re.split("[^a-zA-Z0-9]", t.lower()) if len(x) > 1]
    docs = {k: Counter(token(v)) for k, v in corpus.items()}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    out = {}
    for k, d in docs.items():
        hits = [t for t in token(query) if t in d]
        if hits:
            size = sum(d.values())
            out[k] = sum(idf[t] * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * size / mean)) for t in hits)
    return out


@pytest.mark.parametrize("block", [500_000, 5])
def test_bm25(spark, tmp_path, block):
    corpus, queries = texts(40, 1), {1: "the soil the lime", 2: "rain", 3: "unknown words only", 4: "of pest and pest"}
    index = retrieval.build_index(spark.createDataFrame(list(corpus.items()), "chunk_id string, text string"), str(tmp_path / "i"))
    found = retrieval.bm25_search(index, spark.createDataFrame(list(queries.items()), "query_id long, text string"), 6, block).collect()
    for q, text in queries.items():
        expected = sorted(((-round(s, 8), k) for k, s in okapi(corpus, text).items()))[:6]
        got = sorted((r["rank"], r["chunk_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(k, pytest.approx(-s)) for s, k in expected] == [(k, s) for _, k, s in got]
        if got and got[0][2] > 0:
            assert max(r["bm25_score"] for r in found if r["query_id"] == q) == 1.0


@pytest.mark.parametrize("block", [1024, 2])
def test_dense_with_ties(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, size=(3000, 4)).astype(float)
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = vectors[:5]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    got = retrieval.dense_search(frame, asked, 7, block).collect()
    for i, q in enumerate(queries):
        grid = lambda v: np.floor(v * 2.0**26 + 0.5).astype(int)
        scores = np.maximum(0, (1 + (grid(vectors) @ grid(q)) / 2.0**52) / 2)
        expected = sorted(((-s, k) for k, s in enumerate(scores)))[:7]
        rows = sorted((r["rank"], r["chunk_id"], r["dense_score"]) for r in got if r["query_id"] == i)
        assert [(k, s) for _, k, s in rows] == [(k, -s) for s, k in expected]


def legs(spark):
    dense = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8)], "query_id long, chunk_id string, rank int, dense_score double")
    sparse = spark.createDataFrame([(1, "b", 1, 1.0), (1, "c", 2, 0.5)], "query_id long, chunk_id string, rank int, bm25_score double")
    return dense, sparse


def test_fusion(spark):
    dense, sparse = legs(spark)
    got = {r["chunk_id"]: r for r in retrieval.fuse(dense, sparse).collect()}
    assert got["b"]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61) and (got["b"]["dense_score"], got["b"]["bm25_score"]) == (0.8, 1.0)
    assert got["a"]["rrf_score"] == pytest.approx(1 / 61) and got["c"]["dense_score"] == 0.0
    swapped = retrieval.fuse(sparse.withColumnRenamed("bm25_score", "dense_score"), dense.withColumnRenamed("dense_score", "bm25_score"))
    assert {r["chunk_id"]: round(r["rrf_score"], 12) for r in swapped.collect()} == {k: round(r["rrf_score"], 12) for k, r in got.items()}
    only_dense = retrieval.fuse(dense, sparse.limit(0))
    assert only_dense.count() == 2


def test_rescoring_and_context(spark):
    dense, sparse = legs(spark)
    chunks = spark.createDataFrame([("a", "alpha text", "a.md", 0), ("b", "beta text", "b.md", 2), ("c", "gamma", "a.md", 0)],
                                   "chunk_id string, text string, source string, page int")
    queries = spark.createDataFrame([(1, "what is alpha"), (2, "nothing")], "query_id long, text string")
    fused = retrieval.attach_text(retrieval.fuse(dense, sparse), chunks).join(queries.withColumnRenamed("text", "query_text"), "query_id")

    def by_length():
        return lambda qs, ts: np.array([-float(len(t)) for t in ts])

    def broken():
        def fail(qs, ts):
            raise RuntimeError("no model")
        return fail

    ranked = retrieval.final_ranking(retrieval.rescore(fused, by_length))
    assert [r["chunk_id"] for r in ranked.orderBy("rank").collect()] == ["c", "b", "a"]
    fallback = retrieval.final_ranking(retrieval.rescore(fused, broken))
    assert [r["chunk_id"] for r in fallback.orderBy("rank").collect()] == ["b", "a", "c"]
    qualified = cleanse.relevant_only(ranked, "rerank_score", -9.5)
    got = {r["query_id"]: r for r in context.within_budget(context.context_blocks(queries, qualified)).collect()}
    assert got[1]["context"] == (
        "[CHUNK 1]\nSource: a.md\nRelevance score: -5.000\nContent:\ngamma\n\n[CHUNK 2]\nSource: b.md, p.2\nRelevance score: -9.000\nContent:\nbeta text"
    )
    assert got[1]["sources"] == ["a.md", "b.md"] and got[1]["grounded"]
    assert got[2]["context"] == rc.NO_CONTEXT and got[2]["chunks_used"] == 0 and not got[2]["grounded"]


def test_budget(spark):
    lines = ["x" * 400] * 40
    frame = spark.createDataFrame([("\n".join(lines), "q" * 40), ("y" * 20000, "q"), ("z" * 9000, "q" * 9900), ("small", "q")], "context string, query_text string")
    got = [(r["context"], r["truncated"]) for r in context.within_budget(frame).collect()]
    assert got[0] == ("\n".join(lines[:24]) + rc.TRUNCATION_NOTE, True)  # 100 tokens a line, 2450 allowed
    assert got[1] == ("y" * 8000, True) and got[2] == ("z" * 2000, True) and got[3] == ("small", False)


def test_encoders(spark):
    chunks = spark.createDataFrame([("a", "lime soil lime"), ("b", "water root"), ("c", "")], "chunk_id string, text string")
    (embedded,) = retrieval.hashing_embeddings(chunks, [], 64)
    norms = [math.sqrt(sum(v * v for v in r["embedding"])) for r in embedded.collect()]
    assert sorted(round(x, 5) for x in norms) == [0.0, 1.0, 1.0]
    custom = retrieval.embed(chunks, lambda: lambda batch: np.array([[len(t), 1.0] for t in batch]))
    assert all(math.isclose(sum(v * v for v in r["embedding"]), 1.0, rel_tol=1e-5) for r in custom.collect())


@pytest.mark.parametrize("rows", [1, 6, 40])
def test_pruned_search_has_the_rows_of_the_whole_one(spark, tmp_path, rows):
    corpus, queries = texts(300, 2), {1: "the soil the lime", 2: "rain", 3: "unknown words only", 4: "of pest and pest the yield", 5: "the"}
    rare = {f"r{i}": "rare" + " soil" * (i % 3) + " the" * (i % 5) for i in range(9)}
    queries[6] = "rare the and of yield"
    corpus |= rare
    index = retrieval.build_index(spark.createDataFrame(list(corpus.items()), "chunk_id string, text string").repartition(3), str(tmp_path / "i"))
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    bounds = pruned.impact_bounds(index, str(tmp_path / "b"))
    search = pruned.pruned_search(index, bounds, asked, rows, str(tmp_path / "s"))
    whole = retrieval.bm25_search(index, asked, rows)
    assert sorted(map(tuple, search.rows.collect())) == sorted(map(tuple, whole.collect()))
    if rows == 1:  # common terms of a query with a rare one form fewer pairs than their postings
        formed = search.pairs.where("query_id = 6 AND step = 'essential'").first()["formed"]
        every = retrieval.query_terms(asked.where("query_id = 6")).join(index.vocabulary, "term").agg({"df": "sum"}).first()[0]
        assert formed < every / 3
    assert search.pairs.where("query_id = 3").count() == 0


def test_pruned_search_adds_up_what_an_id_stands_for(spark, tmp_path):
    """Ids of several texts of unlike length, or without a value, score as in the whole search, found by common terms or not."""
    rows = [*texts(120, 9).items(), *((f"c{i % 7}", "rare soil the of" + " the lime" * i) for i in range(30)), (None, "rare pest the of soil"), (None, "the of" * 9)]
    index = retrieval.build_index(spark.createDataFrame(rows, "chunk_id string, text string").repartition(3), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "rare the soil of"), (2, "the of"), (None, "pest the rare"), (4, "lime")], "query_id long, text string")
    bounds = pruned.impact_bounds(index, str(tmp_path / "b"))
    for n in (1, 3):
        search = pruned.pruned_search(index, bounds, asked, n, str(tmp_path / f"s{n}"))
        by_text = lambda rows: sorted(map(str, map(tuple, rows.collect())))
        assert by_text(search.rows) == by_text(retrieval.bm25_search(index, asked, n))


def test_pruned_search_stores_postings_once_and_holds_few_pairs(spark, tmp_path, monkeypatch):
    corpus = texts(200, 3)
    index = retrieval.build_index(spark.createDataFrame(list(corpus.items()), "chunk_id string, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(q, "soil the lime of pest" + " rain" * q) for q in range(20)], "query_id long, text string")
    pruned.pruned_search(index, pruned.impact_bounds(index, str(tmp_path / "b")), asked, 2, str(tmp_path / "s"))
    packs = spark.read.parquet(str(tmp_path / "s" / "packs")).collect()
    numbers = spark.read.parquet(str(tmp_path / "s" / "numbers"))
    postings = index.postings.join(numbers, "term")
    assert sorted(c for p in packs for c in p["chunk_ids"]) == sorted(r[0] for r in postings.select("chunk_id").distinct().collect())
    assert sum(len(p["term_nos"]) for p in packs) == 8 * postings.count()

    entries = pa.array([{"query_no": q, "term_no": t, "query_weight": 1.0 + t} for q in range(9) for t in range(6)])
    pack = pruned._pack(pa.table({
        "chunk_id": [f"k{i // 6}" for i in range(600)], "doc_len": pa.array([7] * 600, pa.int64()), "block": pa.array([11] * 600, pa.int32()),
        "term_no": pa.array([i % 6 for i in range(600)], pa.int64()), "weight": [1.0 + i / 600 for i in range(600)],
    })).combine_chunks().to_batches()[0]
    chunks = pruned._Chunks(pack, 0, pruned._Asked(entries))
    every = np.ones(54, dtype=bool)
    (whole,) = chunks.found(every)
    monkeypatch.setattr(pruned, "PAIRS_AT_ONCE", 700)
    parts = list(chunks.found(every))
    assert len(parts) >= 8 and max(len(p[0]) for p in parts) <= 180
    assert all(np.array_equal(np.concatenate(x), y) for x, y in zip(zip(*parts, strict=True), whole, strict=True))
    units, n = chunks.looked_up(whole[0], whole[1], every)
    assert np.array_equal(units, whole[2]) and np.array_equal(n, whole[3])


def test_scores_dont_hang_on_the_order_of_rows(spark, tmp_path):
    corpus = texts(60, 5)
    asked = spark.createDataFrame([(1, "the soil of the lime and water root leaf")], "query_id long, text string")
    frame = spark.createDataFrame(list(corpus.items()), "chunk_id string, text string")
    seen = set()
    for parts in (1, 2, 5):
        index = retrieval.build_index(frame.repartition(parts), str(tmp_path / str(parts)))
        seen.add(tuple(sorted(map(tuple, retrieval.bm25_search(index, asked, 50).select("chunk_id", "score", "rank").collect()))))
    assert len(seen) == 1


def clustered(n, seed=4, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    vectors = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.15, size=(n, dims))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def test_cells_search_exactly_and_nearly(spark, tmp_path):
    vectors = clustered(900)
    vectors[5:9] = vectors[4]  # ties
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<double>").repartition(3)
    asked = frame.where("chunk_id % 90 = 4").withColumnRenamed("chunk_id", "query_id")
    index = cells.build_cells(frame, str(tmp_path / "i"), cells.fit_centres(frame, 12))
    assert index.cells.agg({"rows": "sum"}).first()[0] == index.vectors.select("chunk_id").distinct().count() == 900
    whole = sorted(map(tuple, retrieval.dense_search(frame, asked, 7).collect()))
    exact = cells.cell_search(index, asked, 7, 1, str(tmp_path / "e"), exact=True).select("query_id", "chunk_id", "dense_score", "rank")
    assert sorted(map(tuple, exact.collect())) == whole
    probes = cells.enough_probes(index, 7)
    near = {(r["query_id"], r["chunk_id"]) for r in cells.cell_search(index, asked, 7, probes, str(tmp_path / "n")).collect()}
    assert probes < index.cells.count() and len(near & {(q, c) for q, c, *_ in whole}) >= 0.9 * len(whole)


def test_one_cell_holds_a_tiny_corpus(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    index = cells.build_cells(frame, str(tmp_path / "i"), cells.fit_centres(frame, 1))
    found = cells.cell_search(index, frame.withColumnRenamed("chunk_id", "query_id"), 1, 3, str(tmp_path / "s"))
    assert sorted((r["query_id"], r["chunk_id"], r["dense_score"]) for r in found.collect()) == [(1, 1, 1.0), (2, 2, 1.0)]


def test_parts_grow_with_the_corpus_and_not_with_the_session(spark, tmp_path, monkeypatch):
    """Ten times the limits in text, postings and pairs: more partitions than the session has, the same rows; a chunk id twice and null."""
    corpus = texts(200, 7)
    chunks = spark.createDataFrame([*corpus.items(), ("c000", corpus["c000"]), (None, "soil and lime")], "chunk_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", " ".join(WORDS[i:i + 4])) for i in range(8)], "query_id string, text string")
    rows = lambda index: sorted(map(tuple, retrieval.bm25_search(index, queries, 5).collect()))
    plain = retrieval.build_index(chunks, str(tmp_path / "plain"))
    wanted = sorted(map(str, plain.postings.collect())), rows(plain)
    monkeypatch.setattr(retrieval, "CHARS_PER_PART", retrieval.text_size(chunks) // 10)
    monkeypatch.setattr(retrieval, "POSTINGS_PER_PART", 100)
    small = retrieval.build_index(chunks, str(tmp_path / "small"))
    assert (sorted(map(str, small.postings.collect())), rows(small)) == wanted
    assert retrieval.in_parts(chunks, "chunk_id", 100, 10).rdd.getNumPartitions() == 10
    assert len({f for f in small.postings.inputFiles()}) > int(spark.conf.get("spark.sql.shuffle.partitions"))
