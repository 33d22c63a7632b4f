"""winnow: a Spark-first engine for scoring, sifting and curating large tables of assets."""
