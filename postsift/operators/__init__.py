"""DataFrame -> DataFrame operators over postings, history and outcomes."""
