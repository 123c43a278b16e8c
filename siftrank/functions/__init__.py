"""Column builders: text cleaning, tokenizing, URL rules."""
