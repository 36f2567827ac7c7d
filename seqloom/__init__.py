"""seqloom: Spark jobs over corpora of short symbol sequences."""
