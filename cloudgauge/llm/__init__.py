"""Corpus operators over logged answers: deduplication, quality, privacy, search, tokens.

The records are those of the call log: `cell_id` names a call and `response_content` is
the text that came back. Every operator reads the two columns by these names (or by the
names given) and leaves other columns alone.
"""
