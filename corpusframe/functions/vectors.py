"""Vector columns: parsing, products and norms over arrays, in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2norm(a) * l2norm(b) + 1e-9)


def normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (l2norm(a) + 1e-9))


# Keys of a dictionary that may hold the vector, in the order in which they are looked at.
VECTOR_KEYS = ("data", "values", "value", "vector", "embedding")


def _unwrapped(c: Column) -> Column:
    """The text of the vector in a keyed form like ``{"data": [1, 2]}``; others as they are. No known key: null."""
    text = F.trim(c)
    keyed = text.startswith("{") & F.contains(text, F.lit(":"))
    return F.when(keyed, F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in VECTOR_KEYS])).otherwise(text)


def parse_vector(c: Column) -> Column:
    """Numbers of a text like ``[1,2]``, ``(1 2)``, ``{1, 2}`` or ``{"data": ...}`` (one inside another too); null if it has
    none or any part is no number."""
    inner = F.regexp_replace(_unwrapped(_unwrapped(c)), r"^[\[\](){}]+|[\[\](){}]+$", "")
    parts = F.filter(F.split(inner, r"[,\s]+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def parsed_vectors(df: DataFrame, text_col: str, key: str = "library_id", name: str = "embedding") -> DataFrame:
    """``df`` with the vector of each row as ``name``; a library that has rows, none of which parses, is an error.

    The error is part of the plan: it is raised where such a library's vectors are computed. Counts are partial sums.
    """
    rows = df.withColumn("_vector", parse_vector(F.col(text_col)))
    parsed = rows.groupBy(key).agg(F.count("_vector").alias("_parsed"), F.count(F.lit(1)).alias("_rows"), F.min(text_col).alias("_sample"))
    message = F.concat(F.lit("Embeddings exist ("), F.col("_rows").cast("string"), F.lit(" rows) but none could be parsed: "), F.coalesce(F.substring("_sample", 1, 120), F.lit("null")))
    known = rows.join(parsed, rows[key].eqNullSafe(parsed[key])).drop(parsed[key])
    return known.withColumn(name, F.when(F.col("_parsed") > 0, F.col("_vector")).otherwise(F.raise_error(message).cast("array<double>"))).drop("_vector", "_parsed", "_rows", "_sample")
