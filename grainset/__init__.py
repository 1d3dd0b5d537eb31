"""grainset: Parquet dataset preparation and metric reports as Spark DataFrame operators."""

__version__ = "0.1.0"
