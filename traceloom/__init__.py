"""traceloom: transcript retrieval and usage analytics as Spark DataFrame operators."""
