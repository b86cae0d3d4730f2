"""An index that grows by segments equals one built at once; batches that are tried again change nothing."""

import numpy as np
import pytest

from agrispark.operators import retrieval, segments

BATCHES = [
    [("a", "soil and lime", False), ("b", "root water", False), ("c", "leaf", False), ("c", "leaf", False)],
    [("a", "soil and lime", False), ("b", "root rain rain", False), ("d", "seed", False), ("x", None, True)],
    [("c", None, True), ("a", None, True), ("e", None, False)],
    [("a", "soil again", False), ("d", "seed", False), ("b", "root rain rain", True), ("b", "root rain", False)],
]
LEFT = {"a": "soil again", "b": "root rain", "d": "seed", "e": ""}


lengths = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])  # noqa: E731  (a lambda travels by value to the workers)


def batch(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string, deleted boolean")


def state(spark, path):
    index = segments.read_index(spark, path)
    return (
        sorted(map(tuple, index.postings.select("chunk_id", "doc_len", "term", "tf").collect())), sorted(map(tuple, index.vocabulary.collect())),
        index.chunks, index.mean_length, index.mean_raw_idf, sorted(r["chunk_id"] for r in segments.read_vectors(spark, path).collect()),
    )


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("segments") / "index")
    for k, rows in enumerate(BATCHES):
        segments.add_segment(batch(spark, rows), path, k, lengths)
    return path


def test_grown_index_equals_one_built_at_once(spark, grown, tmp_path):
    whole = retrieval.build_index(spark.createDataFrame(list(LEFT.items()), "chunk_id string, text string"), str(tmp_path))
    postings, vocabulary, chunks, mean, idf, vectors = state(spark, grown)
    assert postings == sorted(map(tuple, whole.postings.select("chunk_id", "doc_len", "term", "tf").collect()))
    assert vocabulary == sorted(map(tuple, whole.vocabulary.collect()))
    assert (chunks, mean) == (whole.chunks, whole.mean_length) and idf == pytest.approx(whole.mean_raw_idf)
    assert vectors == sorted(LEFT)


def test_unchanged_chunks_are_not_encoded_again(spark, grown):
    assert {r["chunk_id"]: r["times"] for r in segments.encodings(spark, grown).collect()} == {"a": 2, "b": 3, "c": 1, "d": 1, "e": 1}


def test_a_batch_tried_again_changes_nothing(spark, grown):
    before = state(spark, grown)
    segments.add_segment(batch(spark, [("z", "not seen", False)]), grown, len(BATCHES) - 1, lengths)
    assert state(spark, grown) == before


def test_a_failed_batch_is_not_seen_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.add_segment(batch(spark, BATCHES[0]), path, 0, lengths)
    before = state(spark, path)

    def broken():
        def fail(texts):
            raise RuntimeError("no encoder")
        return fail

    with pytest.raises(Exception, match="no encoder"):
        segments.add_segment(batch(spark, BATCHES[1]), path, 1, broken)
    assert state(spark, path) == before
    for k in (1, 2, 3):
        segments.add_segment(batch(spark, BATCHES[k]), path, k, lengths)
    assert state(spark, path)[5] == sorted(LEFT)


def test_compacted_index_is_the_same_and_goes_on(spark, grown, tmp_path):
    target = str(tmp_path / "compact")
    segments.compact(spark, grown, target)
    assert state(spark, target) == state(spark, grown)
    assert spark.read.parquet(f"{target}/vectors").count() == len(LEFT)
    segments.add_segment(batch(spark, [("d", "seed", False), ("a", None, True)]), target, 9, lengths)
    assert state(spark, target)[5] == ["b", "d", "e"] and segments.encodings(spark, target).where("chunk_id = 'd'").first()["times"] == 1


def test_parts_of_a_segment_grow_with_its_text(spark, tmp_path, monkeypatch):
    """With small parts postings of a batch lie in more files than the session has partitions; the index is the same."""
    rows = [(f"k{i:03d}", f"soil lime{i} root{i % 7}", False) for i in range(100)]
    for name, chars in (("plain", 8_000_000), ("small", 100)):
        monkeypatch.setattr(retrieval, "CHARS_PER_PART", chars)
        segments.add_segment(batch(spark, rows), str(tmp_path / name), 0, lengths)
    assert state(spark, str(tmp_path / "small")) == state(spark, str(tmp_path / "plain"))
    files = spark.read.parquet(str(tmp_path / "small" / "postings")).inputFiles()
    assert len(files) > int(spark.conf.get("spark.sql.shuffle.partitions"))
