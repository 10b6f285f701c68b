"""Vector expressions over `array<float>` columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(col) -> Column:
    vector = F.col(col) if isinstance(col, str) else col
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def unit(col) -> Column:
    """L2-normalised float32 vector; a zero vector stays zero."""
    vector = F.col(col) if isinstance(col, str) else col
    length = norm(vector)
    return F.transform(
        vector,
        lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)).cast("float"),
    )


def inner_product(a, b) -> Column:
    """Inner product in double precision."""
    left = F.col(a) if isinstance(a, str) else a
    right = F.col(b) if isinstance(b, str) else b
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
