"""pitchloom: Spark DataFrame operators for football event analytics."""

__version__ = "0.1.0"
