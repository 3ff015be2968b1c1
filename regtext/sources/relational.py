"""Relational tables over JDBC, both ways.

A table is read in ranges of a key that hold about as many rows each: the key alone is read first, and its quantiles are the bounds, so a
key with gaps or with a crowded stretch doesn't leave one task with most of the rows. Rows are written into a staging table by all
tasks and go into place in one transaction, so a job that fails midway leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative error of the bounds: a range is off by at most 1 / ACCURACY of all rows.
ACCURACY = 10_000


def _reader(spark: SparkSession, url: str, name: str, options: dict[str, str]):
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def key_bounds(spark: SparkSession, url: str, name: str, key: str, parts: int, **options: str) -> list:
    """At most parts - 1 bounds of a numeric key, ascending, between ranges of about as many rows."""
    keys = f"(select {_quoted(key)} from {name}) as keys_only"
    low, high = _reader(spark, url, keys, options).load().agg(F.min(key), F.max(key)).first()
    if low is None or low == high or parts < 2:
        return []
    even = _reader(spark, url, keys, options).options(partitionColumn=_quoted(key), lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(parts)).load()
    cuts = even.agg(F.percentile_approx(key, F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(ACCURACY)).alias("c")).first()["c"]
    return [c for c in sorted(set(cuts)) if c > low]


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table; with a numeric key it is read in so many ranges of it (rows without a key come with the last one)."""
    if key is None:
        return _reader(spark, url, name, options).load()
    bounds, own = key_bounds(spark, url, name, key, parts, **options), _quoted(key)
    if not bounds:
        return _reader(spark, url, name, options).load()
    inner = [f"{own} >= {a} and {own} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    predicates = [f"{own} < {bounds[0]}", *inner, f"{own} >= {bounds[-1]} or {own} is null"]
    return spark.read.jdbc(url, name, predicates=predicates, properties=options)


def _transaction(spark: SparkSession, url: str, statements: list[str]) -> None:
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def _exists(spark: SparkSession, url: str, name: str, options: dict[str, str]) -> bool:
    try:
        _reader(spark, url, name, options).load()
        return True
    except Exception as error:
        if "42X05" in str(error) or "42P01" in str(error) or "does not exist" in str(error):
            return False
        raise


def write_table(rows: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Append rows to a table (it is made if it isn't there), or put them in its place (mode overwrite): all of them, or none."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode}")
    spark, staged = rows.sparkSession, f"staged_{uuid.uuid4().hex[:12]}"
    rename = (lambda a, b: f"RENAME TABLE {a} TO {b}") if url.startswith("jdbc:derby") else (lambda a, b: f"ALTER TABLE {a} RENAME TO {b}")
    try:
        rows.write.format("jdbc").options(url=url, dbtable=staged, **options).mode("error").save()
        there = _exists(spark, url, name, options)
        if there and mode == "append":
            have = {c.lower(): c for c in _reader(spark, url, name, options).load().columns}
            if unknown := [c for c in rows.columns if c.lower() not in have]:
                raise ValueError(f"{name} has no column {', '.join(unknown)}")
            into = ", ".join(_quoted(have[c.lower()]) for c in rows.columns)
            _transaction(spark, url, [f"INSERT INTO {name} ({into}) SELECT {', '.join(map(_quoted, rows.columns))} FROM {staged}", f"DROP TABLE {staged}"])
        elif there:
            old = f"{staged}_old"
            _transaction(spark, url, [rename(name, old), rename(staged, name), f"DROP TABLE {old}"])
        else:
            _transaction(spark, url, [rename(staged, name)])
    except BaseException:
        if _exists(spark, url, staged, options):
            _transaction(spark, url, [f"DROP TABLE {staged}"])
        raise
