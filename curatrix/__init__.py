"""Social-post curation and training-data preparation as Spark DataFrame jobs."""
