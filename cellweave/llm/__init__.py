"""Training-data operators: ten corpus components, each a function from DataFrames to a DataFrame.

Nothing outside this package imports it; removing the folder leaves the rest of the library working.
"""
