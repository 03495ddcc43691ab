"""Analytics over captured web sites, as Spark DataFrames."""
