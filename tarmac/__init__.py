"""Road-collision analytics expressed as PySpark DataFrame functions."""
