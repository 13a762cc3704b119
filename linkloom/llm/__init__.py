"""Training-data operators: scoring, privacy, quality, tokens, contamination, mixing, chat, licences, search, joins."""
