"""Journal storage: reading with a fixed schema, decoding payloads, and validated appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.functions.canonical import canonical_json, payload_field


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EVENTS).parquet(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CHECKPOINTS).parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at this path before, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_ledger_ops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.LEDGER_OPS).parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Laid out by execution and sorted by sequence, so that reads of few executions or tails skip row groups.

    Parquet has one writer at a time here: an append does not guard against another one running.
    """
    events.select(*S.EVENTS.fieldNames()).repartitionByRange("execution_id", "sequence").sortWithinPartitions("execution_id", "sequence").write.mode(mode).parquet(path)


def decode(events: DataFrame) -> DataFrame:
    """One column per payload key; JSON values (arguments, result, error) as canonical text.

    Absent and null keys are both null.  Rows whose payload is no JSON are left to `unreadable`.
    """
    json_keys = ("arguments", "result", "error", "retry_policy")
    parsed = events.withColumn("_payload", F.try_parse_json("payload"))  # once for all keys
    field = lambda k, t: F.to_json(F.try_variant_get("_payload", f"$.{k}", "variant")) if k in json_keys else F.try_variant_get("_payload", f"$.{k}", t)
    columns = [F.nullif(field(k, t), F.lit("null")).alias(k) if k in json_keys else field(k, t).alias(k) for k, t in S.PAYLOAD.items()]
    return parsed.select("event_id", "execution_id", "sequence", "event_type", "timestamp", *columns)


def unreadable(events: DataFrame) -> DataFrame:
    """Events whose type is unknown, or whose payload or attempt cannot be read, with the reason."""
    attempt = payload_field(F.col("payload"), "attempt")
    reason = (
        F.when(~F.col("event_type").isin(*S.EVENT_TYPES) | F.col("event_type").isNull(), "unknown event type")
        .when(F.col("payload").isNotNull() & canonical_json(F.col("payload")).isNull(), "payload is not JSON")
        .when(attempt.isNotNull() & F.expr("try_cast(get_json_object(payload, '$.attempt') as double)").isNull(), "attempt is not a number")
    )
    return events.withColumn("reason", reason).where("reason is not null")


def encode(events: DataFrame) -> DataFrame:
    """The stored form of a decoded journal: keys without a value are left out of the payload."""
    pairs = [k for k in S.PAYLOAD if k in events.columns]
    parts = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f'"{k}":'), _as_json(k, events.schema[k].dataType.typeName()))) for k in pairs]
    payload = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
    event_id = F.col("event_id") if "event_id" in events.columns else F.concat(F.lit("evt_"), "execution_id", F.lit("_"), F.col("sequence").cast("string"))
    timestamp = F.col("timestamp") if "timestamp" in events.columns else F.lit(None).cast("string")
    return events.select(event_id.alias("event_id"), "execution_id", "sequence", "event_type", payload.alias("payload"), timestamp.alias("timestamp"))


def _as_json(key: str, kind: str) -> Column:
    if kind == "string" and key not in ("arguments", "result", "error", "retry_policy"):
        return F.regexp_extract(F.to_json(F.struct(F.col(key).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.col(key).cast("string")


def numbered(events: DataFrame, last: DataFrame, order: str = "timestamp") -> DataFrame:
    """Events of one batch with the sequences that follow each execution's last one.

    last: (execution_id, last_sequence).  One writer allocates at a time.
    """
    after = events.drop("sequence").join(last, "execution_id", "left")
    n = F.row_number().over(Window.partitionBy("execution_id").orderBy(order, "event_id"))
    return after.withColumn("sequence", (F.coalesce("last_sequence", F.lit(0)) + n).cast("long")).drop("last_sequence")


def rejected_appends(batch: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of a batch whose sequence is not the next one, with a reason; an empty result allows the append."""
    w = Window.partitionBy("execution_id").orderBy("sequence")
    expected = F.coalesce(F.lag("sequence").over(w), F.coalesce("last_sequence", F.lit(0))) + 1
    reason = F.when(F.col("sequence") < 1, "sequence below 1").when(F.col("sequence") < expected, "duplicate sequence").when(F.col("sequence") > expected, "gap")
    return batch.join(last, "execution_id", "left").withColumn("expected", expected).withColumn("reason", reason).where("reason is not null").drop("last_sequence")
