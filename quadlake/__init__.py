"""Spark-native analytics over course-offering style tables.

Every operator is a plain function from DataFrames (and parameters) to a lazy
DataFrame or Column; nothing here collects rows to the driver.
"""
