"""weftline: string search, text indexing and sequence-table processing on PySpark DataFrames."""
