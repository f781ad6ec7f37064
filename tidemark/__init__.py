"""tidemark: event studies over intraday bars and announcements, as Spark DataFrame and SQL plans."""
