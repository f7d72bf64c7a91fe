"""Evidence-store analytics and training-data operators on PySpark."""
