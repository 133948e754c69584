"""Query registry: name -> callable(spark, data_dir) and the matching SQL."""
