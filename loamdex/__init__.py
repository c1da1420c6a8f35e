"""loamdex: a PySpark engine for search and graph analytics over code and text corpora.

Every operator takes DataFrames and returns a DataFrame. Query work stays in
Spark: plans are declared with the DataFrame API, Python runs only inside
Arrow batches.
"""
