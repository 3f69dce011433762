"""Operators that Spark lacks or spells otherwise, as builders of DataFrames."""
