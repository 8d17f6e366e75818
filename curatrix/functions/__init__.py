"""Column functions: text, keywords, addresses, times, covers, prompts."""
