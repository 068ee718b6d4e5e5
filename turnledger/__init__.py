"""Usage analytics over coding-agent transcripts, as Spark jobs.

Transcripts (JSON lines) become a table of events and a table of prompts; the
plans answer questions about tokens, cost, tools, files and repeated prompts.
"""
