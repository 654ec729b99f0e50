"""strata: a Spark-native analytics engine for stacked terrain rasters, graphs over them, and routes on those graphs."""
