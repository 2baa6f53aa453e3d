"""tidelane: ordered-record, write-ahead-log and trace processing on Spark DataFrames."""
