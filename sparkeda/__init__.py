"""sparkeda: exploratory data analysis as Spark jobs.

Every public operator takes DataFrames and returns a DataFrame; nothing but
schema-sized facts ever travels through the driver.
"""
