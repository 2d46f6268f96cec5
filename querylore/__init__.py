"""Analytics over SQL corpora, database catalogs, documentation chunks and question logs, on Spark DataFrames."""
