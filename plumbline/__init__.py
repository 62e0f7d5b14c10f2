"""Statistics, time-series and data-pipeline operators expressed as Spark plans."""
