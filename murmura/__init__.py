"""murmura: evaluation of tagged speech-synthesis corpora as Spark DataFrame jobs."""
