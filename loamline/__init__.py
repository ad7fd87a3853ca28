"""A Spark-native engine for corpora of text and source files and for the run logs of tools that work on them."""
