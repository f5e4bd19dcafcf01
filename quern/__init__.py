"""quern: semantic-cache analytics expressed as Spark plans."""
