"""Awkward documents: nulls, empty and long texts, ties, repeated rows, and columns named like the operators' results."""

import random

from pyspark.sql import types as T

CLASHES = ["size", "taken", "kept", "component_id", "score", "lang_pred", "ids", "n_tokens", "tag", "row", "key", "_id", "node"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


def prose(rng, n, letters="etaoinshrdlu"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward(seed=1):
    """Rows (doc_id, text, lang, source, n_chars, clashes...) with unique ids, among them copies and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts = [
        None, "", " \t\n ", "word", "Word", "two words", "two  words\n", "...", "123 456", "▁ odd ▁marks", "a\u0000b   c",
        "naïve café ÉTÉ ÄÖÜ ß", "日本語 テキスト 한국어", "emoji 🙂🙂 end<|endoftext|>", "x" * 5000, prose(rng, 4000),
    ]
    base = prose(rng, 200)
    words = base.split()
    for k in range(6):
        changed = list(words)
        for at in rng.sample(range(200), 4):
            changed[at] = prose(rng, 1)
        texts += [" ".join(changed), base]
    for k in range(5):
        texts.append(prose(rng, 30 + k) + " " + passage + " " + prose(rng, 20))
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    out = []
    for i, text in enumerate(texts):
        out.append((i * 3, text, ("en", "de", None)[i % 3], (None, "a", "b", "c", "ä")[i % 5], len(text or ""), *["clash"] * len(CLASHES)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
