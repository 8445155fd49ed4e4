"""What evaluating paths sorts."""

from panels import make_panel
from pyspark.sql import functions as F

from panelyard.operators import paths


def test_groups_are_aggregated_and_each_order_is_sorted_once(spark):
    panel = spark.createDataFrame(make_panel(days=12, stocks=4)).withColumns({"is_buyable": F.lit(True), "is_sellable": F.col("trade_date") != "2024-01-08"})
    made = paths.evaluate_paths(panel, F.col("adj_close") > 20, [1, 3], 10.0)
    sorts = [line for line in made._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window [" in line]
    assert sorts and not any("windowspecdefinition(trade_date" in line for line in sorts)  # no group's rows are sorted whole
    back = ["trade_date" in line and "DESC" in line.split("windowspecdefinition(")[1] for line in sorts]
    assert sum(a != b for a, b in zip(back, back[1:])) <= 3  # each order once: the signals' two, the means' one
    late = {r["exit_delay"] for r in made.filter("planned_exit_date = date'2024-01-08'").collect()}
    assert late == {1}
