"""corpusmill: corpus curation as composable Spark DataFrame transformations."""
