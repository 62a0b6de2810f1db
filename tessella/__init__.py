"""Map-data analytics on PySpark: tagged entities, roads, areas, addresses and elevation tiles as DataFrames."""
