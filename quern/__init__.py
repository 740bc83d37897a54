"""quern: ranked full-text retrieval and corpus processing as Spark DataFrame plans."""
