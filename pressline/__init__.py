"""pressline: news and engagement analytics expressed as Spark DataFrame jobs."""
