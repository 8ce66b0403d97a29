"""gridloom: multi-region analytics, execution evidence and intervention analysis on Spark DataFrames."""
