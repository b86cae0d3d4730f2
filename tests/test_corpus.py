"""Cleaning, splitting, chunk store and corpus readers."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agrispark.functions import text as tx
from agrispark.operators import corpus
from agrispark.sources.corpus import read_chunks, read_markdown, write_chunks
from agrispark.streaming.corpus import ingest_stream, markdown_stream


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_clean(spark):
    assert one(spark, tx.clean, "  a\tb \x07 c\r\n\n\n\nd\x0ce  ​ f　") == "a b c \n\nd e ​ f"
    assert one(spark, tx.clean, "x 😀 y") == "x y"


def test_tokens_and_estimates(spark):
    assert one(spark, tx.tokens, "Soil pH-5, été a bb C3!") == ["soil", "ph", "bb", "c3"]
    assert [one(spark, tx.token_estimate, t) for t in ("", "ab", "abcdefgh", None)] == [0, 1, 2, 0]


def test_boilerplate(spark):
    text = "Keep me.\n\nHere is the summary of facts:\n\nLine one\nKey Points: x\nLine two\n\n  \n\nThis chapter DESCRIBES lime\nand more"
    assert one(spark, tx.drop_boilerplate, text) == "Keep me.\n\nLine one\nLine two"


def test_splitter_examples():
    assert corpus.split_text("") == [] and corpus.split_text("  short ") == ["short"]
    assert corpus.split_text("aaaa bbbb cccc dddd", 9, 4) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert corpus.split_text("one. two. three", 9, 0) == ["one. two", "three"]
    assert corpus.split_text("para one\n\npara two is long", 10, 0) == ["para one", "para two", "is long"]
    assert corpus.split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    # a carried tail may push a chunk over the size, as long as it fits the overlap
    assert corpus.split_text("aa bbbbbbb c", 8, 2) == ["aa", "aa bbbbbbb", "c"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,;:\n", max_size=400), st.integers(8, 60))
def test_splitter_properties(text, size):
    overlap = size // 4
    chunks = corpus.split_text(text, size, overlap)
    squeeze = lambda s: "".join(c for c in s if c in "ab")
    assert all(c.strip() and len(c) <= size + 2 * (overlap + 2) + 2 for c in chunks)
    if overlap == 0:
        assert squeeze("".join(chunks)) == squeeze(text)
    assert set(squeeze("".join(chunks))) == set(squeeze(text))
    assert len(squeeze("".join(chunks))) >= len(squeeze(text))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40))
def test_splitter_without_overlap_keeps_every_letter(text, size):
    squeeze = lambda s: "".join(c for c in s if c in "ab")
    assert squeeze("".join(corpus.split_text(text, size, 0))) == squeeze(text)


def test_chunks_in_spark_equal_the_splitter(spark):
    texts = {f"d{i}": ("Lime raises pH. " * (i * 37 % 400)).strip() for i in range(12)}
    docs = spark.createDataFrame([(k, 0, v) for k, v in texts.items()], "source string, page int, text string")
    got = {}
    for r in corpus.chunk_documents(docs).orderBy("source", "chunk_index").collect():
        got.setdefault(r["source"], []).append(r["text"])
        assert r["char_count"] == len(r["text"]) and len(r["chunk_id"]) == 32
    assert got == {k: corpus.split_text(v) for k, v in texts.items() if v}


def write_md(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_markdown_folder_and_store(spark, tmp_path):
    folder = tmp_path / "kb"
    folder.mkdir()
    write_md(folder, "a.md", "Compost feeds the soil. " * 100)
    write_md(folder, "b.md", "short")
    write_md(folder, "c.txt", "ignored")
    docs = read_markdown(spark, str(folder))
    assert sorted(r["source"] for r in docs.collect()) == ["a.md", "b.md"]
    chunks = corpus.long_enough(corpus.chunk_documents(corpus.clean_documents(docs)))
    store = str(tmp_path / "store")
    write_chunks(spark, chunks, store, clear=True)
    first = spark.read.parquet(store).count()
    assert first == chunks.count() > 1
    write_chunks(spark, chunks, store)
    assert spark.read.parquet(store).count() == first
    changed = chunks.withColumn("text", F.concat("text", F.lit(" changed at the end")))
    write_chunks(spark, changed, store)
    stored = read_chunks(spark, store)
    assert stored.count() == first and stored.where(F.col("text").endswith("changed at the end")).count() == first
    write_chunks(spark, chunks.limit(1), store, clear=True)
    assert corpus.store_size(read_chunks(spark, store)).first().asDict() == {"chunk_count": 1, "populated": True}


def test_stream_ingest_adds_only_new_chunks(spark, tmp_path):
    folder, store = tmp_path / "kb", str(tmp_path / "store")
    folder.mkdir()
    write_md(folder, "a.md", "Mulch keeps moisture in the ground. " * 60)
    ingest_stream(markdown_stream(spark, str(folder)), store, str(tmp_path / "cp"))
    first = read_chunks(spark, store).count()
    write_md(folder, "b.md", "Drainage helps roots breathe. " * 60)
    ingest_stream(markdown_stream(spark, str(folder)), store, str(tmp_path / "cp"))
    batch = corpus.long_enough(corpus.chunk_documents(corpus.clean_documents(read_markdown(spark, str(folder)))))
    ids = lambda f: {r["chunk_id"] for r in f.collect()}
    assert first < read_chunks(spark, store).count() and ids(read_chunks(spark, store)) == ids(batch)
    ingest_stream(markdown_stream(spark, str(folder)), store, str(tmp_path / "cp2"))
    assert spark.read.parquet(store).count() == batch.count()


def test_chunker_in_sql_equals_the_splitter():
    """Texts that need every separator, words longer than a chunk included."""
    import random

    import duckdb

    from oracle.chunker import chunks_sql
    from oracle.corpus import _strip

    rng = random.Random(11)
    glue = ["\n\n", "\n", ". ", "; ", ": ", ", ", " "]
    texts = ["", "short", "x" * 2500, "é" * 1001 + " end", "a" * 1000, "b " * 900]
    for _ in range(60):
        parts = ["".join(rng.choice("abc é") for _ in range(rng.choice([3, 40, 300, 900, 1600]))) for _ in range(rng.randint(1, 12))]
        some = rng.sample(glue, rng.randint(1, 4))
        texts.append("".join(p + rng.choice(some) for p in parts))
    con = duckdb.connect()
    con.execute("CREATE TABLE given (doc BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?)", list(enumerate(texts)))
    found = con.execute(f"WITH {chunks_sql('given', _strip)} SELECT doc, chunk_index, chunk FROM chunked ORDER BY doc, chunk_index").fetchall()
    wanted = [(d, i, c.strip()) for d, t in enumerate(texts) for i, c in enumerate(corpus.split_text(t))]
    assert found == wanted


def test_a_task_holds_few_chunks_at_once(spark, monkeypatch):
    """Frames of a bounded amount of text give the chunks of whole batches, blank documents included."""
    rows = [(f"d{i}", 0, "  " if i % 5 == 0 else f"soil {i} " * (20 * i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "source string, page int, text string").coalesce(1)
    whole = sorted(map(tuple, corpus.chunk_documents(docs).collect()))
    monkeypatch.setattr(corpus, "CHARS_PER_FRAME", 500)
    assert sorted(map(tuple, corpus.chunk_documents(docs).collect())) == whole and {r[2] for r in whole} == {s for s, _, t in rows if t.strip()}
