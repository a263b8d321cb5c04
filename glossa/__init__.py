"""glossa: lexicon-driven text analytics expressed as Spark DataFrame plans."""
