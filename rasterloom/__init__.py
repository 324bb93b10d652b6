"""Image, signal and scanned-page analytics expressed over Spark DataFrames."""
