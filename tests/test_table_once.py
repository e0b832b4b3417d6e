"""Table lines are computed once, not once per mention of them."""

from pyspark.sql import functions as F

from themeloom.functions import markdown as M


def test_cells_are_stripped_once(spark):
    for build in (M.table_lines, M.plain_table_lines):
        assert str(build(F.col("rows"))).count("regexp_replace") == 1
