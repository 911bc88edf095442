"""Documents that every operator has to cope with."""

LONG = " ".join(f"word{i % 977} of{i % 13}." for i in range(20_000))
NASTY = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "Same text, twice."), (6, "Same text, twice."), (7, "same  TEXT, twice."),
    (8, LONG), (9, LONG + " end"), (10, "x" * 30_000), (11, "  double  blanks\n\n and\ttabs 　 wide "), (12, "ﬁne ÀÉ ñandú Straße ΣΑΣ İ"),
    (13, "a<|endoftext|>b <|startoftext|> c"), (14, "I'll don't we've 's 12345 ½ ²"), (15, "\u0000\u001c\u001d nul 🙂🙃 emoji"), (16, None),
    (17, "The quick brown fox. Jumps over! The lazy dog? Yes."), (18, "1 2 3 4 5 6 7 8 9 0 " * 500), (19, "..." * 3000), (20, "é" * 999),
]


def frame(spark, rows=NASTY, schema="doc_id long, text string, range string, digest int", partitions=3):
    """Rows with two more columns, whose names clash with some that operators make inside."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], schema).repartition(partitions)
