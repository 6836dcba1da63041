"""obslake: observation analytics and data preparation on PySpark."""
