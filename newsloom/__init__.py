"""newsloom: a Spark-first analytics engine for news-style document streams."""
