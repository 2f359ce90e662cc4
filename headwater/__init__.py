"""headwater: forecasting operators for many irregular time series, on Spark.

Every operator takes and returns DataFrames. Work is expressed with columns,
joins, aggregates and windows; Python runs only inside tasks, for HTML tables,
small linear solves, nearest neighbours and adaptive drift windows.
"""
