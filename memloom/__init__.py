"""memloom: conversational-memory analytics expressed as Spark plans."""
