"""Equi-joins that broadcast only behind a size check, and split hot keys otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quill.session import cut

#: Rows up to which a side may be broadcast.
BROADCAST_ROWS = 200_000
#: Slices into which the larger side of a salted join is cut.
SALTS = 16
#: Bytes up to which a side may be broadcast, and rows of one key from which join_hot cuts it into slices.
BROADCAST_BYTES, HOT_ROWS = 64 << 20, 100_000


def _hash(df: DataFrame) -> Column:
    """A hash of the row; of maps, which have no order, the JSON."""
    return F.xxhash64(*[F.to_json(c.name) if isinstance(c.dataType, T.MapType) else F.col(c.name) for c in df.schema])


def within_bounds(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and, where a column may be long, ``size`` bytes; one job."""
    long = [c.name for c in small.schema if isinstance(c.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    width = sum((F.coalesce(F.octet_length(c if isinstance(small.schema[c].dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))), F.lit(0)) for c in long), F.lit(8 * len(small.columns)))
    n, b = small.agg(F.count("*"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return n <= rows and b <= size


def join_checked(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join small (already materialised, unique or nearly so by key) to large.

    Counts small and its bytes; up to ``rows`` and BROADCAST_BYTES it is broadcast. Beyond that the join shuffles on the keys plus a salt:
    rows of large are spread over ``salts`` slices and small is repeated in each slice, so a key that holds a
    third of large does not end in one task. how: inner, left, left_semi or left_anti.
    """
    if within_bounds(small, rows):
        return large.join(F.broadcast(small), on, how)
    salted = large.withColumn("_salt", F.pmod(_hash(large), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def join_hot(large: DataFrame, small: DataFrame, on: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of large, already materialised, to small on its keys, most of which are rare. Keys of more than ``rows``
    rows in large are counted first and cut into slices, small's rows of them repeated in each; few keys can be that
    frequent, so only their rows are copied."""
    counts = large.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_slices"))
    hot = cut(counts)
    if not hot.head(1):
        return large.join(small, on)
    cut_large = join_checked(large, hot, on, "left")
    cut_large = cut_large.withColumn("_slice", F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(_hash(large), F.col("_slices"))).cast("int")).drop("_slices")
    copies = join_checked(small, hot, on, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
    return cut_large.join(copies, [*on, "_slice"]).drop("_slice")
