"""Document analytics on Spark: DataFrame transformations for extracted documents."""
