"""Phrase mining and translation mining on Spark DataFrames."""
