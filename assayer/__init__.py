"""assayer: measures collections of text, code, manifests, markup and history as Spark DataFrames."""
