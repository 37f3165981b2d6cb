"""Training-data operators: language ID, LM scoring, licence scans, tool calls, search, clean-up and mixing."""
