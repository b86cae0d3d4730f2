"""Intent, routing, measurements and history of messages.

The lexicon is a small table; it reaches each message as one scalar array, so classification neither joins nor
shuffles.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agrispark.functions import text as tx
from agrispark.functions.numeric import let, to_number
from agrispark.operators.cleanse import valid_messages
from agrispark.operators.latest import last_n_per_key
from agrispark.operators.sequences import overlapping_blocks, with_position_in_key
from agrispark.rules import lexicon as lx
from agrispark.sources import dims


def lexicon(spark: SparkSession) -> DataFrame:
    """(intent, intent_ord, kw_ord, keyword, weight)"""
    rows = [
        (intent, i, j, keyword, weight)
        for i, (intent, pairs) in enumerate(lx.INTENT_KEYWORDS.items()) for j, (keyword, weight) in enumerate(pairs)
    ]
    names = ["intent", "intent_ord", "kw_ord", "keyword", "weight"]
    columns = {n: [r[k] for r in rows] for k, n in enumerate(names)}
    return spark.createDataFrame(pa.table(columns)).select(
        "intent", F.col("intent_ord").cast("int"), F.col("kw_ord").cast("int"), "keyword", "weight"
    )


def _entries(table: DataFrame, intent: str, keywords: list[str | tuple[str, float]]) -> DataFrame:
    """New rows after the intent's present ones; an unknown intent yields none."""
    pairs = [(k, lx.BARE_KEYWORD_WEIGHT) if isinstance(k, str) else k for k in keywords]
    fresh = table.sparkSession.createDataFrame(pa.table({
        "n": list(range(1, len(pairs) + 1)), "keyword": [p[0] for p in pairs], "weight": [float(p[1]) for p in pairs],
    }))
    present = table.where(F.col("intent") == intent)
    return fresh.select(
        F.lit(intent).alias("intent"), present.agg(F.max("intent_ord")).scalar().alias("intent_ord"),
        (present.agg(F.max("kw_ord")).scalar() + F.col("n")).cast("int").alias("kw_ord"), "keyword", "weight",
    ).where(F.col("intent_ord").isNotNull())


def add_keywords(table: DataFrame, intent: str, keywords: list[str | tuple[str, float]]) -> DataFrame:
    return table.unionByName(_entries(table, intent, keywords))


def replace_keywords(table: DataFrame, intent: str, keywords: list[str | tuple[str, float]]) -> DataFrame:
    return table.where(F.col("intent") != intent).unionByName(_entries(table, intent, keywords))


def with_intents(messages: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds ``intents``: the matching intents, best first, each with confidence and matched keywords."""
    table = table if table is not None else lexicon(messages.sparkSession)
    entries = table.agg(F.sort_array(F.collect_list(
        F.struct("intent_ord", "kw_ord", "intent", "keyword", F.lower("keyword").alias("needle"), "weight")
    ))).scalar()
    hits = let(F.lower(F.col("text")), lambda low: F.filter(F.col("_lexicon"), lambda k: F.contains(low, k["needle"])))
    # Only the hits travel on: the lexicon column is dropped where they are found.
    found = messages.withColumn("_lexicon", entries).select(*messages.columns, hits.alias("_hits"))
    matched = F.transform(
        F.array_distinct(F.transform("_hits", lambda k: F.struct(k["intent_ord"].alias("ord"), k["intent"].alias("intent")))),
        lambda i: F.struct(i.alias("i"), F.filter("_hits", lambda k: k["intent_ord"] == i["ord"]).alias("keywords")),
    )
    weighed = F.transform("_matched", lambda m: F.struct(
        m["i"].alias("i"), F.aggregate(m["keywords"], F.lit(0.0), lambda acc, k: acc + k["weight"]).alias("weight"),
        F.transform(m["keywords"], lambda k: k["keyword"]).alias("keywords"),
    ))

    def score(m: Column) -> Column:
        share = m["weight"] / F.lit(lx.CONFIDENCE_FULL_WEIGHT)
        confidence = F.least(F.lit(lx.CONFIDENCE_BASE) + F.lit(lx.CONFIDENCE_SPAN) * share, F.lit(1.0))
        return F.struct(
            (-confidence).alias("order"), m["i"]["ord"].alias("intent_ord"), m["i"]["intent"].alias("intent"),
            m["weight"].alias("weight"), confidence.alias("confidence"), m["keywords"].alias("keywords"),
        )

    return (
        found.withColumn("_matched", matched)
        .withColumn("intents", F.sort_array(F.transform(weighed, score)))
        .drop("_hits", "_matched")
    )


def intent_scores(messages: DataFrame, keys: list[str], table: DataFrame | None = None) -> DataFrame:
    # An outer inline: for a plain one the optimizer adds a filter on the array and computes the array twice.
    scored = with_intents(messages, table).select(*keys, F.inline_outer("intents"))
    return scored.where(F.col("intent").isNotNull()).select(*keys, "intent", "intent_ord", "weight", "confidence", "keywords")


def top_intents(messages: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds intent, confidence, matched keywords, a close second intent and an explanation."""
    first, second = F.try_element_at("intents", F.lit(1)), F.try_element_at("intents", F.lit(2))
    empty = F.col("text").isNull() | (F.col("text") == "")
    scored = with_intents(messages, table).withColumns({
        "intent": F.coalesce(first["intent"], F.lit(lx.FALLBACK_INTENT)),
        "confidence": F.when(empty, lx.EMPTY_CONFIDENCE).otherwise(F.coalesce(first["confidence"], F.lit(lx.FALLBACK_CONFIDENCE))),
        "keywords": F.coalesce(first["keywords"], F.array().cast("array<string>")),
        "secondary_intent": F.when(second["confidence"] > first["confidence"] - lx.SECONDARY_GAP, second["intent"]),
    })
    level = F.when(F.col("confidence") > 0.75, "high").when(F.col("confidence") > 0.5, "moderate").otherwise("low")
    explained = F.concat(F.col("intent"), F.lit(" ("), level, F.lit(" confidence) — matched: "), F.array_join(F.slice("keywords", 1, 3), ", "))
    explanation = (
        F.when(empty, "Query is empty or invalid; defaulting to general knowledge.")
        .when(F.size("intents") == 0, "No specific keywords detected; defaulting to general knowledge.")
        .otherwise(explained)
    )
    return scored.withColumn("explanation", explanation).drop("intents")


def activation(messages: DataFrame, context: str | None = None) -> DataFrame:
    """Adds the four diagnosis flags found in message and context."""
    other = F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
    combined = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), other))

    def any_word(words: list[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.col("_text"), F.lit(word))
        return hit

    measured = F.lit(False)
    for pattern in lx.MEASUREMENT_ACTIVATION:
        measured = measured | F.col("_text").rlike(pattern)
    return messages.withColumn("_text", combined).withColumns({
        "telemetry_exists": any_word(lx.TELEMETRY_WORDS), "sensor_values_exist": any_word(lx.SENSOR_VALUE_WORDS),
        "symptoms_reported": any_word(lx.SYMPTOM_WORDS), "soil_measurements_provided": measured,
    }).drop("_text")


def route(messages: DataFrame, context: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """Adds the response mode and its attributes; diagnosis needs at least one activation flag."""
    flags = ["telemetry_exists", "sensor_values_exist", "symptoms_reported", "soil_measurements_provided"]
    active = F.lit(False)
    for flag in flags:
        active = active | F.col(flag)
    modes = dims.intent_modes(messages.sparkSession)
    targets = F.broadcast(modes.select("intent", F.col("mode").alias("intent_mode")))
    attributes = F.broadcast(modes.select("mode", "response_format", "requires_context", "requires_diagnostics", "memory_preference").distinct())
    mapped = top_intents(activation(messages, context), table).join(targets, "intent", "left")
    wanted = F.coalesce("intent_mode", F.lit("general_mode"))
    downgraded = (wanted == "diagnostic_mode") & ~active
    moded = mapped.withColumns({"downgraded": downgraded, "mode": F.when(downgraded, "general_mode").otherwise(wanted)}).drop("intent_mode")
    return moded.join(attributes, "mode", "left")


def measurements(messages: DataFrame, context: str | None = None, least: int = lx.LEAST_MEASUREMENTS) -> DataFrame:
    """Adds up to eight measurements read from text; all NULL unless enough of them are found."""
    other = F.concat(F.lit(" "), F.coalesce(F.col(context), F.lit(""))) if context else F.lit(" ")
    low = F.lower(F.concat(F.coalesce("text", F.lit("")), other))
    found = messages.withColumn("_text", low).withColumns({
        f"_{name}": to_number(F.regexp_extract("_text", lx.measurement_pattern(words), 1)) for name, words in lx.MEASUREMENT_WORDS.items()
    })
    count = sum((F.col(f"_{name}").isNotNull().cast("int") for name in lx.MEASUREMENT_WORDS), F.lit(0))
    enough = F.col("measurement_count") >= least
    return found.withColumn("measurement_count", count).withColumns({
        name: F.when(enough, F.col(f"_{name}")) for name in lx.MEASUREMENT_WORDS
    }).drop("_text", *[f"_{name}" for name in lx.MEASUREMENT_WORDS])


def last_messages(messages: DataFrame, n: int = lx.STORED_MESSAGES) -> DataFrame:
    """Newest n valid messages per conversation."""
    return last_n_per_key(valid_messages(messages), "conv_id", [F.col("turn").desc()], n, F.col("turn"))


def relevant_history(messages: DataFrame, block_turns: int = 4096) -> DataFrame:
    """Each user message as a question next to the earlier messages worth keeping.

    Of the last six messages before it: all when the question has few distinct words, else those sharing a word,
    else the last two. Conversations are processed in blocks of turns that repeat six border rows.
    """
    valid = valid_messages(messages)
    bucket = F.floor(F.col("turn") / block_turns).cast("long")
    numbered = with_position_in_key(valid, ["conv_id"], ["turn"], bucket)
    blocks = overlapping_blocks(numbered, lx.HISTORY_MESSAGES, 0, block_turns)
    before = W.partitionBy("conv_id", "_block").orderBy("seq").rowsBetween(-lx.HISTORY_MESSAGES, -1)
    recent = blocks.withColumn("recent", F.collect_list(F.struct("turn", "role", "text")).over(before))
    asked = recent.where(F.col("_own") & (F.col("role") == "user")).withColumn("_words", tx.query_words(F.col("text")))
    shares = F.filter("recent", lambda m: let(F.lower(m["text"]), lambda low: F.exists("_words", lambda w: F.contains(low, w))))
    latest = F.slice("recent", F.greatest(F.size("recent") - lx.HISTORY_FALLBACK + 1, F.lit(1)), lx.HISTORY_FALLBACK)
    kept = (
        F.when(F.size("_words") <= lx.HISTORY_FEW_WORDS, F.col("recent"))
        .when(F.size(shares) > 0, shares).otherwise(latest)
    )
    return asked.select("conv_id", "turn", "text", kept.alias("history"))
