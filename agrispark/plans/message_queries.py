"""Registered queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrispark.operators import cleanse, utterances
from agrispark.rules import lexicon as lx
from agrispark.session import spread
from agrispark.sources.conversations import append_turns

# Farm phrases added to the messages so that lexicon and patterns have something to find.
PHRASES = [
    "what should i plant alongside maize this season?",
    "my soil is acidic soil with ph: 4.8 and nitrogen 12 ppm, moisture=18",
    "leaves yellow with spots on leaves, is it blight or rust?",
    "how often water the maize field? irrigation schedule please",
    "telemetry from node_07 shows temp 31 and ec 2.1, om 1.8",
    "best fertilizer and manure dosage for higher yield",
    "explain the basics of soil science",
    "will rain and frost risk hurt the growing season",
    "phosphate: 9.5 potash= 88. salinity 1.2.3 and nitrogen: 20",
    "thank you",
]
PHRASE_EXPR = "case (conv_id*7+turn*3)%10 " + " ".join(
    f"when {i} then '{p}'" for i, p in enumerate(PHRASES)
) + " end"


def _messages(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet")


def _utterances(spark, sf):
    """Message text followed by a farm phrase; every fiftieth message is empty."""
    text = F.expr(f"case when (conv_id+turn)%50=0 then '' else coalesce(text,'')||' '||{PHRASE_EXPR} end")
    return spread(_messages(spark, sf), "conv_id", "turn").withColumn("text", text)


KEYS = ["conv_id", "turn"]


def intent_scores(spark, sf):
    scores = utterances.intent_scores(_utterances(spark, sf), KEYS)
    return scores.select(*KEYS, "intent", "weight", F.round("confidence", 6).alias("confidence"), F.array_join("keywords", "|").alias("keywords"))


def intent_top(spark, sf):
    return utterances.top_intents(_utterances(spark, sf)).select(
        *KEYS, "intent", F.round("confidence", 6).alias("confidence"), F.array_join("keywords", "|").alias("keywords"), "secondary_intent", "explanation"
    )


def intent_custom_lexicon(spark, sf):
    """Keywords added to one intent and replaced for another."""
    table = utterances.add_keywords(utterances.lexicon(spark), "weather_advice", ["the", ("on", 0.5)])
    table = utterances.replace_keywords(table, "intercropping", [("maize", 4.5), "alongside"])
    return utterances.top_intents(_utterances(spark, sf), table).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def activation_flags(spark, sf):
    return utterances.activation(_utterances(spark, sf)).select(
        *KEYS, "telemetry_exists", "sensor_values_exist", "symptoms_reported", "soil_measurements_provided"
    )


def routing_mode(spark, sf):
    return utterances.route(_utterances(spark, sf)).select(
        *KEYS, "intent", "mode", "downgraded", "response_format", "requires_context", "requires_diagnostics", "memory_preference"
    )


def measurements_in_text(spark, sf):
    return utterances.measurements(_utterances(spark, sf)).select(
        *KEYS, F.col("measurement_count").cast("long").alias("measurement_count"), *lx.MEASUREMENT_WORDS
    )


def valid_messages(spark, sf):
    return cleanse.valid_messages(_messages(spark, sf)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


# Conversation ids as a client might send them; some too short, some with forbidden characters.
ID_EXPR = "case conv_id%4 when 0 then 'c'||cast(conv_id as {STR}) when 1 then 'conv_'||cast(100000+conv_id as {STR}) when 2 then 'conv '||cast(100000+conv_id as {STR}) else '  conv-'||cast(100000+conv_id as {STR})||' ' end"


def conversation_ids(spark, sf):
    named = _messages(spark, sf).withColumn("client_id", F.expr(ID_EXPR.format(STR="string")))
    accepted, quarantined = cleanse.split_by_conversation_id(named, "client_id")
    count = lambda f, ok: f.groupBy("client_id").agg(F.count(F.lit(1)).alias("messages")).withColumn("accepted", F.lit(ok))
    return count(accepted, True).unionByName(count(quarantined, False))


def last_48_messages(spark, sf):
    return utterances.last_messages(_messages(spark, sf)).select(*KEYS, "role", F.col("rank").cast("long").alias("rank"))


def last_6_messages(spark, sf):
    return utterances.last_messages(_messages(spark, sf), lx.HISTORY_MESSAGES).select(*KEYS, "role", F.col("rank").cast("long").alias("rank"))


def relevant_history(spark, sf):
    history = utterances.relevant_history(_utterances(spark, sf))
    return history.select(
        *KEYS, F.size("history").cast("long").alias("kept"),
        F.array_join(F.transform("history", lambda m: m["turn"].cast("string")), ",").alias("kept_turns"),
    )


def appended_turns(spark, sf):
    """The user messages asked again, appended after each conversation's last turn."""
    stored = _messages(spark, sf)
    again = stored.where("role = 'user'").select("conv_id", "role", "text", "turn")
    return append_turns(stored, again, "turn").select(*KEYS, "role", F.length("text").cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in [
    intent_scores, intent_top, intent_custom_lexicon, activation_flags, routing_mode, measurements_in_text,
    valid_messages, conversation_ids, last_48_messages, last_6_messages, relevant_history, appended_turns,
]}
