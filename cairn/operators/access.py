"""Request accounting: tokens, fixed-window limits, usage; and the tables behind them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def validate(requests: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """``requests`` (req_id, ts, token, ip, ...) with login, limits and rate_key; all null for missing or unknown tokens."""
    known = tokens.join(users.select("login", "rate_per_second", "rate_per_day", "rate_by_ip"), "login")
    out = requests.join(known, "token", "left")
    return out.withColumn("rate_key", F.when(F.col("rate_by_ip"), F.concat_ws(":", "login", "ip")).otherwise(F.col("login")))


def limit_rate(valid: DataFrame, short: str = "second", long: str = "day") -> DataFrame:
    """``valid`` with ``status``: 401 without a login, 429 over a limit, else 200.

    Both counters are fixed windows; 0 is no limit. A request over the short limit does not count for the
    long one, and one over the long limit has counted for the short one. So two running counts suffice.
    """
    own = lambda unit: Window.partitionBy("rate_key", F.date_trunc(unit, "ts")).orderBy("ts", "req_id").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("login").isNotNull()
    some = valid.filter(ok).withColumn("_s", F.count(F.lit(1)).over(own(short)))
    some = some.withColumn("_ok", (F.col("rate_per_second") == 0) | (F.col("_s") <= F.col("rate_per_second")))
    some = some.withColumn("_d", F.sum(F.col("_ok").cast("int")).over(own(long)))
    status = F.when(~F.col("_ok") | ((F.col("rate_per_day") > 0) & (F.col("_d") > F.col("rate_per_day"))), 429).otherwise(200)
    none = valid.filter(~ok).withColumn("status", F.lit(401))
    return some.withColumn("status", status).drop("_s", "_ok", "_d").unionByName(none)


def daily_usage(limited: DataFrame) -> DataFrame:
    """(login, day, used): what counts for the day. Users without a daily limit, or counted by address, show none."""
    counted = limited.filter("status IS NOT NULL AND login IS NOT NULL AND rate_per_day > 0 AND NOT rate_by_ip")
    own = Window.partitionBy("rate_key", F.date_trunc("second", "ts")).orderBy("ts", "req_id").rowsBetween(Window.unboundedPreceding, 0)
    through = (F.col("rate_per_second") == 0) | (F.col("_s") <= F.col("rate_per_second"))
    return counted.withColumn("_s", F.count(F.lit(1)).over(own)).filter(through).groupBy("login", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("used"))


def respond(limited: DataFrame, answers: DataFrame) -> DataFrame:
    """(req_id, status, body): the answer of an accepted request, else why there is none."""
    body = F.when(F.col("status") == 200, F.col("json")).when(F.col("status") == 429, "Rate limit exceeded").when(F.col("token").isNull(), "Missing API key").otherwise("Invalid API key")
    return limited.join(answers.select(F.col("qid").alias("req_id"), "json"), "req_id", "left").select("req_id", "status", body.alias("body"))


def create_user(users: DataFrame, by: str | None, login: str, rate_per_second: int = 1, rate_per_day: int = 1000, rate_by_ip: bool = False, admin: bool = False) -> DataFrame:
    """The first user of all is an administrator; later ones are made by administrators only, and are none."""
    first = users.isEmpty()
    if not first and (by is None or users.filter((F.col("login") == by) & F.col("admin")).isEmpty()):
        raise PermissionError(f"{by} may not create users")
    row = users.sparkSession.createDataFrame([(login, first and admin or first, rate_per_second, rate_per_day, rate_by_ip)], "login string, admin boolean, rate_per_second int, rate_per_day int, rate_by_ip boolean")
    return users.filter(F.col("login") != login).select(*row.columns).unionByName(row)


def delete_user(users: DataFrame, tokens: DataFrame, by: str, login: str) -> tuple[DataFrame, DataFrame]:
    """Administrators may, but not themselves; the user's tokens go as well."""
    if by == login or users.filter((F.col("login") == by) & F.col("admin")).isEmpty():
        raise PermissionError(f"{by} may not delete {login}")
    return users.filter(F.col("login") != login), tokens.filter(F.col("login") != login)


def create_token(tokens: DataFrame, login: str) -> tuple[DataFrame, str]:
    token = secrets.token_hex(16)
    return tokens.unionByName(tokens.sparkSession.createDataFrame([(token, login)], "token string, login string")), token


def delete_token(tokens: DataFrame, by: str, token: str) -> DataFrame:
    """Only its owner's; another's stays."""
    return tokens.filter((F.col("token") != token) | (F.col("login") != by))
