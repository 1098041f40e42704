"""Explicit schemas and the checks that stand for a store's structural doctor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column definitions; ``struct`` makes a schema of them once a session is there.
MEMORY = (
    "id bigint, user_id string, content string, tags array<string>, category string, entity string, namespace string, confidence double, status string, "
    "valid_from timestamp_ntz, valid_until timestamp_ntz, t_created timestamp_ntz, t_expired timestamp_ntz, superseded_by bigint, agent_id string, visibility string, "
    "access_count int, last_accessed timestamp_ntz, metadata map<string,string>"
)
EPISODE = "id bigint, conv_id bigint, turn bigint, user_text string, assistant_text string, user_ts timestamp_ntz, assistant_ts timestamp_ntz"
QUEUE = "id bigint, user_id string, state string, created_at timestamp_ntz, claimed_at timestamp_ntz, done_at timestamp_ntz, error string"
NODE = "key string, namespace string, display_name string, entity_type string"
EDGE = "src string, dst string, rel string, namespace string, event_date string"
struct = T.StructType.fromDDL
ROLES = ("user", "assistant", "system")


def missing_columns(df: DataFrame, ddl: str) -> list[str]:
    """Names of required columns that ``df`` lacks or has with another type."""
    schema = struct(ddl)
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule and number of rows for which its SQL predicate does not hold (null counts as not holding)."""
    counts = [F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(n) for n, p in rules.items()]
    wide = df.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])).alias("r")).select("r.*")


def check_dimension(df: DataFrame, column: str, size: int) -> DataFrame:
    """Fail the job that meets a vector of another length."""
    return df.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(F.format_string(f"{column} has %d values, not {size}", F.size(column)))))
