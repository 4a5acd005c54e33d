"""From parsed observations to bounded identities: labels without gaps, route templates, statement labels, caps and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.functions import route, sql_text
from wiretally.operators import cardinality, families, reduce
from wiretally.session import cut


def is_db() -> Column:
    return F.col("proto").isin("pg", "mysql")


def with_slot(red: DataFrame) -> DataFrame:
    """Reduced observations with label (of statements, exactly), fp and slot."""
    text = F.when(is_db(), F.col("text"))
    s = sql_text.norm_sql(text, F.when(F.col("proto") == "mysql", "mysql").otherwise("postgres"))
    out = red.drop("fp").withColumn("_s", s).withColumn("label", F.col("_s.label")).withColumn("fp", F.col("_s.fp")).drop("_s")
    return out.withColumn("slot", families.slot())


def with_labels(obs: DataFrame) -> DataFrame:
    """db and user without nulls: - where nobody was named, ? where the session's beginning wasn't seen."""
    absent = F.when(F.col("proto").isin("http", "s3"), S.ANONYMOUS).otherwise(S.UNKNOWN)
    return obs.withColumns({c: F.coalesce(c, absent) for c in ("db", "user")})


def with_route(obs: DataFrame, patterns=None) -> DataFrame:
    """The route of an HTTP observation: the one that the application gave, else the template of its target."""
    made = route.route(F.col("op"), F.col("text"), patterns) if patterns else route.route(F.col("op"), F.col("text"))
    found = F.coalesce(route.given(F.col("route")), made)
    return obs.withColumn("route", F.when((F.col("proto") == "http") & F.col("text").isNotNull(), found).otherwise(F.col("route")))


def identified(obs: DataFrame, slots: int = cardinality.SLOTS, dims: int = cardinality.DIM_CAP, errors: int = cardinality.ERROR_CAP) -> DataFrame:
    """Parsed observations, measured, with all labels bounded: what the metric families count. No row is added or lost.

    They are written once after parsing, as the dictionary, the caps and the families all read them. Identities beyond the dictionary, (db, user) pairs and error labels beyond their caps become other.
    """
    red = with_slot(reduce.reduce_observations(with_route(with_labels(obs))))
    red = cut(red.withColumn("depth", F.col("redis.pipeline_depth")) if "redis" in red.columns else red)
    red = cardinality.admit(red.withColumn("_id", F.when(F.col("slot") != S.OTHER, F.xxhash64("proto", "slot"))), slots, fp="_id")
    red = red.withColumn("slot", F.when(F.col("admitted"), F.col("slot")).otherwise(S.OTHER)).drop("_id", "admitted")
    return cardinality.cap_errors(cardinality.cap_dims(red, dims), errors)
