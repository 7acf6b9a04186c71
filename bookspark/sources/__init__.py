"""Readers of book files: codecs as pure functions, and the DataFrames made from them."""
