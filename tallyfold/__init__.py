"""tallyfold: event logs to season features, projections and forecasts on Spark.

``functions``  column expressions (safe ratios, rounding, dates, conditions)
``sources``    parquet and CSV readers, writers
``operators``  DataFrame -> DataFrame building blocks with named columns as arguments
``plans``      the playing-time forecast composed from those blocks
"""
