"""Texts that every operator must stand."""

LONG = "word " * 60_000 + "end"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old stone bridge"),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, LONG),
    (6, "one two"),
    (6, "one two"),
    (7, "The quick brown fox jumps over the lazy dog near the old stone bridge"),
    (None, "a text whose id is null, with password=abcdef123"),
    (8, "Füße über Straßen, 你好 😀   x"),
]


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)
