import pytest
from pyspark.sql import functions as F

from packetloom.functions.narrative import fixed


@pytest.mark.parametrize(
    "value, digits, want",
    [(40.925, 2, "40.92"), (0.125, 2, "0.13"), (-0.125, 2, "-0.13"), (1.005, 2, "1.00"), (2.5, 0, "3"), (7.0, 1, "7.0"), (99999.99, 1, "100000.0")],
)
def test_numbers_are_rounded_as_stored(spark, value, digits, want):
    """40.925 and 1.005 are a little less than a half as binary numbers, 0.125 is a half."""
    assert spark.range(1).select(fixed(F.lit(value), digits).alias("s")).first().s == want
