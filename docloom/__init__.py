"""docloom: a PySpark engine that turns document collections into fine-tuning datasets."""
