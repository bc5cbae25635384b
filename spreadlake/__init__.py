"""spreadlake: offer matching and price-spread analytics on Spark DataFrames."""
