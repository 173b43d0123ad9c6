"""Rules kept as data: word lists, caps, texts and regex tables that callers may replace."""
