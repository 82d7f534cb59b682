"""relloom: a Spark-first engine for building, sampling, labelling and evaluating relevance data."""
