"""Reading transcripts and reading and writing the store."""
