"""The questions: reports, notes, repeated prompts, store health and ingest."""
