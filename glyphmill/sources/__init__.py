"""Readers of dictionaries, configurations, word models, corpora and books, and the sink of books."""
