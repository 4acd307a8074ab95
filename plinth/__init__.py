"""plinth: batch retrieval, retrieval evaluation and corpus preparation on Spark."""
