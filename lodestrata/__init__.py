"""Evidence retrieval, table analytics, answer screening and event-log jobs on Spark DataFrames."""
