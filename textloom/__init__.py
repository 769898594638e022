"""textloom: a document-dataflow engine on PySpark DataFrames."""
