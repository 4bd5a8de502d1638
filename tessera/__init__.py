"""Analytics over collections of small attributed graphs and sparse multi-task label tables, as Spark DataFrames."""
