"""Operators that prepare text corpora for language-model training, built on Spark DataFrames."""
