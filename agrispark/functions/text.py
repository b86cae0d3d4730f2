"""Text cleaning, tokens, identifiers and token budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agrispark.functions.numeric import let
from agrispark.rules import corpus as rc
from agrispark.rules import lexicon


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.btrim(text, F.lit(rc.SPACES))


def clean(text: Column) -> Column:
    """Printable characters only, single blanks, at most one empty line in a row, no outer white space."""
    blanks = F.regexp_replace(text, rc.BLANK_OR_UNPRINTABLE, " ")
    return strip(F.regexp_replace(blanks, "\\n{3,}", "\n\n"))


def _is_boilerplate(part: Column) -> Column:
    hit = F.lit(False)
    for pattern in rc.BOILERPLATE:
        hit = hit | part.rlike("(?is)^(?:" + pattern.removeprefix("^") + ")")
    return hit


def drop_boilerplate(text: Column) -> Column:
    """Drop boilerplate paragraphs, then boilerplate lines in the paragraphs that stay."""
    paragraphs = F.filter(
        F.transform(F.split(text, "\\n\\n"), strip), lambda p: (p != "") & ~_is_boilerplate(p)
    )
    kept_lines = lambda p: F.filter(F.split(p, "\\n"), lambda line: ~_is_boilerplate(strip(line)))
    bodies = F.filter(F.transform(paragraphs, kept_lines), lambda lines: F.size(lines) > 0)
    joined = F.array_join(F.transform(bodies, lambda lines: F.array_join(lines, "\n")), "\n\n")
    return F.regexp_replace(joined, "\\n{3,}", "\n\n")


def tokens(text: Column) -> Column:
    """Lower-cased ASCII alphanumeric runs of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(rc.TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / rc.CHARS_PER_TOKEN))).cast("long")


def chunk_id(source: Column, page: Column, index: Column, text: Column) -> Column:
    key = F.concat(
        source, F.lit("::page"), page.cast("string"), F.lit("::chunk"), index.cast("string"),
        F.lit("::"), F.substring(text, 1, rc.ID_TEXT_CHARS),
    )
    return F.substring(F.sha2(key, 256), 1, rc.ID_LENGTH)


def lines(text: Column) -> Column:
    return F.split(text, rc.LINE_BREAK)


def budget_prefix(text: Column, query: Column) -> tuple[Column, Column]:
    """Leading lines of a context that fit the token budget left by the query, and whether it was cut."""
    used = token_estimate(text) + token_estimate(query)
    target = F.lit(rc.MAX_CONTEXT_TOKENS) - token_estimate(query) - rc.CONTEXT_RESERVE
    start = F.struct(F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("spent"), F.lit(True).alias("open"))

    def leading(parts: Column, limit: Column) -> Column:
        def take(acc: Column, line: Column) -> Column:
            return let(acc["spent"] + token_estimate(line), lambda spent: F.struct(
                F.when(acc["open"] & (spent <= limit), acc["kept"] + 1).otherwise(acc["kept"]).alias("kept"),
                spent.alias("spent"), (acc["open"] & (spent <= limit)).alias("open"),
            ))

        return F.aggregate(parts, start, take)["kept"].cast("int")

    def cut(parts: Column) -> Column:
        return let(let(target, lambda limit: leading(parts, limit)), lambda kept: (
            F.when(kept == 0, F.substring(text, 1, rc.CUT_FIRST_LINE))
            .otherwise(F.concat(F.array_join(F.slice(parts, 1, kept), "\n"), F.lit(rc.TRUNCATION_NOTE)))
        ))

    truncated = used > rc.MAX_CONTEXT_TOKENS
    short = F.when(target <= 0, F.substring(text, 1, rc.CUT_WITHOUT_BUDGET)).otherwise(let(lines(text), cut))
    return F.when(truncated, short).otherwise(text), truncated


def query_words(query: Column) -> Column:
    """Distinct lower-cased words longer than three characters, outer punctuation removed."""
    words = F.transform(
        F.split(query, rc.SPACE_CLASS + "+"), lambda w: F.regexp_replace(w, "^[.,!?;:]+|[.,!?;:]+$", "")
    )
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > lexicon.HISTORY_WORD_LENGTH), lambda w: F.lower(w)))
