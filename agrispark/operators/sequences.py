"""Row positions, overlapping windows, scaling and chronological splits.

Windows over readings are count-based, so a row's position within its node matters. Numbering a node with one
``PARTITION BY node`` window would put a hot node in one task. Instead rows are counted per (node, time bucket),
the small counts are accumulated per node, and rows are numbered inside their bucket; windows are then cut out of
blocks of consecutive positions that repeat the few neighbouring rows they need. A block can be stored: it has each
reading once, where windows have it as often as they are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agrispark.functions.numeric import min_max_scale, zero_if_missing
from agrispark.operators.cleanse import with_node_id
from agrispark.rules import crop_profile as cp
from agrispark.rules import limits
from agrispark.sources import dims

BLOCK_ROWS = 4096
BUCKET_WIDTHS = (86_400, 3_600, 60, 1)
ROWS_PER_BUCKET = 2_000_000
VALUES_PER_PART = 16_000_000  # values in the windows of one partition, about


def time_bucket(ts: str = "ts", seconds: int = BUCKET_WIDTHS[0]) -> Column:
    """Bucket number that grows with a zone-less time, whatever the session's time zone."""
    c = F.col(ts)
    total = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60 + F.floor(F.second(c))
    return F.floor(total / F.lit(seconds)).cast("long")


def fitting_bucket(frame: DataFrame, key: list[str], ts: str = "ts", limit: int = ROWS_PER_BUCKET) -> int:
    """Widest bucket in seconds whose fullest (key, bucket) group stays within the limit, measured on the data.

    Only key and time are read, and counts are combined before the shuffle; one pass unless some key is that hot.
    """
    for seconds in BUCKET_WIDTHS[:-1]:
        sizes = frame.groupBy(*key, time_bucket(ts, seconds).alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
        fullest = sizes.agg(F.max("n")).first()[0]
        if fullest is None or fullest <= limit:
            return seconds
    return BUCKET_WIDTHS[-1]


def with_position_in_key(frame: DataFrame, key: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Adds ``seq`` (0-based position within the key) and ``key_rows`` (rows of the key).

    ``bucket`` must not decrease along the order. Rows with a NULL key form a key of their own, and rows whose order is
    NULL come first in theirs: no row is lost.
    """
    bucketed = frame.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per_key = W.partitionBy(*key) if key else W.partitionBy(F.lit(0))
    placed = counts.select(
        *key, "_bucket",
        F.coalesce(F.sum("_n").over(per_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(per_key).alias("key_rows"),
    )
    inside = F.row_number().over(W.partitionBy(*key, "_bucket").orderBy(*order))
    numbered = bucketed.withColumn("_inside", inside)
    both = [*key, "_bucket"]
    right = placed.select(*[F.col(c).alias(f"_of_{c}") for c in both], "_before", "key_rows")
    same = F.lit(True)
    for c in both:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (
        numbered.join(right, same).drop(*[f"_of_{c}" for c in both])
        .withColumn("seq", (F.col("_before") + F.col("_inside") - 1).cast("long"))
        .drop("_bucket", "_inside", "_before")
    )


def overlapping_blocks(numbered: DataFrame, look_back: int, look_ahead: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of consecutive positions; border rows are repeated in the neighbours that look at them.

    ``_own`` marks the one copy of a row that produces output.
    """
    block = lambda position: F.floor(position / F.lit(block_rows)).cast("long")
    first = block(F.greatest(F.col("seq") - look_ahead, F.lit(0)))
    last = block(F.least(F.col("seq") + look_back, F.col("key_rows") - 1))
    return numbered.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_block") == block(F.col("seq"))
    )


def sliding_windows(readings: DataFrame, length: int, features: list[str] = cp.FEATURES, horizon: int = 0,
                    target: str | None = None, carry: list[str] | None = None, key: list[str] | None = None,
                    bucket_seconds: int | None = None, block_rows: int = BLOCK_ROWS, path: str | None = None) -> DataFrame:
    """All full windows of ``length`` consecutive readings per node, oldest row first.

    Output: key, seq and ts of the last row, ``carry`` columns of the last row, ``window`` as an array of feature
    arrays, and with a horizon the ``target`` value that many rows later (windows without one are dropped).
    ``key=[]`` treats the whole table as one series. Without a bucket width the data decides. Readings without a time
    have no place in a window. With a ``path`` the blocks are stored there, for windows that are read more than once,
    and dealt to partitions by the number of values in their windows.
    """
    readings = readings.where(F.col("ts").isNotNull())
    key = ["node_id"] if key is None else key
    bucket_seconds = bucket_seconds or fitting_bucket(readings, key)
    carry = carry or []
    needed = list(dict.fromkeys([*key, "event_id", "ts", *features, *carry, *([target] if target else [])]))
    numbered = with_position_in_key(readings.select(*needed), key, ["ts", "event_id"], time_bucket("ts", bucket_seconds))
    last = [c for c in dict.fromkeys(["seq", "event_id", "ts", "key_rows", *carry]) if c not in key]
    step = F.array(*[F.col(f).cast("double") for f in features])
    row = F.struct(*last, *([F.col(target).alias("_target")] if target else []), step.alias("_step"))
    blocks = (
        overlapping_blocks(numbered, length - 1, horizon, block_rows).groupBy(*key, "_block")
        .agg(F.sort_array(F.collect_list(row)).alias("_rows"))
        .select(*key, "_block", "_rows", F.col("_rows")["_step"].alias("_steps"))
    )
    if path:
        blocks = _stored_blocks(blocks, [*key, "_block"], length * len(features), path)
    out = [*key, *[c for c in ("event_id", "ts", "seq", "key_rows", *carry) if c not in key], "window", *(["target_value"] if target else [])]
    return _cut_windows(blocks, key, last, length, horizon, target is not None, block_rows).select(*dict.fromkeys(out))


def _stored_blocks(blocks: DataFrame, key: list[str], values: int, path: str) -> DataFrame:
    """Blocks written and read back; file sizes say nothing of their windows, so these decide on the partitions."""
    spark = blocks.sparkSession
    blocks.drop("_steps").write.parquet(path)
    stored = spark.read.parquet(path)
    rows = stored.agg(F.sum(F.size("_rows"))).first()[0] or 0
    parts = max(-(-rows * values // VALUES_PER_PART), spark.sparkContext.defaultParallelism)
    return stored.repartition(parts, *key).withColumn("_steps", F.col("_rows")["_step"])


def _cut_windows(blocks: DataFrame, key: list[str], last: list[str], length: int, horizon: int, target: bool, block_rows: int) -> DataFrame:
    """The windows that end in rows of the block itself; positions in a block have no gaps."""
    first_row = F.col("_rows")[0]
    start = F.greatest(F.col("_block") * block_rows, F.lit(length - 1)) - first_row["seq"]
    end = F.least((F.col("_block") + 1) * block_rows, first_row["key_rows"] - horizon) - 1 - first_row["seq"]

    def window(i: Column) -> Column:
        row = F.get("_rows", i)
        fields = [row[c].alias(c) for c in last] + [F.slice("_steps", i - (length - 2), F.lit(length)).alias("window")]
        return F.struct(*fields, *([F.get("_rows", i + horizon)["_target"].alias("target_value")] if target else []))

    places = F.when(start <= end, F.sequence(start.cast("int"), end.cast("int")))
    return blocks.select(*key, F.inline(F.transform(places, window)))


def scaler_params(readings: DataFrame, features: list[str] = cp.FEATURES) -> DataFrame:
    """(feature, min, max) over all rows, missing as zero, in one aggregation."""
    ends = readings.agg(*[f(zero_if_missing(F.col(c))).alias(f"{n}_{c}") for c in features for n, f in (("min", F.min), ("max", F.max))])
    return ends.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").alias("data_min"), F.col(f"max_{c}").alias("data_max")) for c in features
    ])))


def scale(readings: DataFrame, params: DataFrame, features: list[str] = cp.FEATURES) -> DataFrame:
    """Features scaled to 0..1 with stored parameters: one row per feature, read as a scalar subquery."""
    ends = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("data_min", "data_max"))))).scalar()
    with_ends = readings.withColumn("_p", ends)
    scaled = {
        c: min_max_scale(zero_if_missing(F.col(c)), F.col("_p")[c]["data_min"], F.col("_p")[c]["data_max"]) for c in features
    }
    return with_ends.withColumns(scaled).drop("_p")


def window_labels(windows: DataFrame) -> DataFrame:
    """Class index of the verdict carried by the last reading of each window."""
    from agrispark.functions.soil import label_index

    return windows.withColumn("label", label_index(F.col("suitability_label")))


def class_weights(labelled: DataFrame, label: str = "suitability_label") -> DataFrame:
    """total / (classes * count), 1.0 for a class without rows."""
    labels = dims.suitability_labels(labelled.sparkSession)
    counts = labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    joined = F.broadcast(labels).join(counts, "label", "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(F.lit(0)))
    weight = F.coalesce(total / F.nullif(F.lit(len(cp.SUITABILITY_LABELS)) * F.col("n"), F.lit(0)), F.lit(1.0))
    return joined.select("label_index", "label", F.coalesce("n", F.lit(0)).alias("n"), weight.alias("class_weight"))


def chronological_split(samples: DataFrame, key: list[str], train: float = 0.70, validation: float = 0.15,
                        order: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds ``split``: the first int(n*train) samples per key, then int(n*validation), then the rest.

    ``key=[]`` splits the table as one series.
    """
    bucket = time_bucket("ts", fitting_bucket(samples, key)) if bucket is None else bucket
    placed = with_position_in_key(samples.drop("seq", "key_rows"), key, order or ["ts", "event_id"], bucket)
    return _with_split(placed, train, validation)


def _with_split(placed: DataFrame, train: float, validation: float) -> DataFrame:
    train_end = F.floor(F.col("key_rows") * train)
    val_end = train_end + F.floor(F.col("key_rows") * validation)
    return placed.withColumn(
        "split", F.when(F.col("seq") < train_end, "train").when(F.col("seq") < val_end, "validation").otherwise("test")
    )


def split_windows(windows: DataFrame, length: int, horizon: int = 0, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``chronological_split`` of ``sliding_windows`` by their key, from the positions that they have already.

    A key's windows end at positions length - 1 to key_rows - horizon - 1, so nothing is numbered and no window moves.
    """
    placed = windows.withColumns({"seq": F.col("seq") - (length - 1), "key_rows": F.col("key_rows") - (length - 1 + horizon)})
    return _with_split(placed, train, validation)


def future_value(readings: DataFrame, column: str, horizon: int = limits.FORECAST_HORIZON,
                 bucket_seconds: int | None = None) -> DataFrame:
    """Each reading next to its own value ``horizon`` readings later."""
    slim = with_node_id(readings).select("node_id", "event_id", "ts", column)
    bucket_seconds = bucket_seconds or fitting_bucket(slim, ["node_id"])
    numbered = with_position_in_key(slim, ["node_id"], ["ts", "event_id"], time_bucket("ts", bucket_seconds))
    blocks = overlapping_blocks(numbered, 0, horizon)
    ahead = F.lead(column, horizon).over(W.partitionBy("node_id", "_block").orderBy("seq"))
    return blocks.withColumn("future_value", ahead).where(
        F.col("_own") & (F.col("seq") + horizon < F.col("key_rows"))
    ).drop("_block", "_own")
