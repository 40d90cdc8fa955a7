"""Point-in-time time-series analytics on Spark: declarative plans over DataFrames."""
