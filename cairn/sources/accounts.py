"""Accounts as JSON: {"users": {login: limits}, "tokens": {token: login}}."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMITS = "admin boolean, rate_per_second int, rate_per_day int, rate_by_ip boolean"
SCHEMA = f"users map<string,struct<{LIMITS.replace(' ', ':')}>>, tokens map<string,string>".replace(",:", ",")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users, tokens); limits that a user lacks are 0 and false. A missing or unreadable file gives empty tables."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    whole = text.select(F.from_json("value", SCHEMA).alias("j"))
    users = whole.select(F.explode("j.users").alias("login", "u")).select("login", *(F.coalesce(F.col("u")[c], F.lit(0).cast(k)).alias(c) for c, k in (x.split(" ") for x in LIMITS.split(", "))))
    return users, whole.select(F.explode("j.tokens").alias("token", "login"))


def save(users: DataFrame, tokens: DataFrame, path: str) -> None:
    """The same JSON, one line in one file."""
    u = users.agg(F.map_from_entries(F.collect_list(F.struct("login", F.struct(*(x.split(" ")[0] for x in LIMITS.split(", ")))))).alias("users"))
    t = tokens.agg(F.map_from_entries(F.collect_list(F.struct("token", "login"))).alias("tokens"))
    u.join(t).select(F.to_json(F.struct("users", "tokens")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
