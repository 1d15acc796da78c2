"""Operators for large text corpora: near copies, tokens, secrets, shards, quality, languages."""
