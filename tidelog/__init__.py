"""tidelog: container-log analytics on PySpark DataFrames."""
