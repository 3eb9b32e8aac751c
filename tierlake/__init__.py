"""tierlake: tiered memory tables, lexical retrieval and event mining as Spark plans."""
