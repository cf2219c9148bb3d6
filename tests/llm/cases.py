"""Rows that every operator must bear."""

#: Nulls, empties, ties, repeats, a very long text.
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "same text here again and again"), (6, "same text here again and again"), (7, "ab" * 150_000), (8, "Ünïcödé 日本語 text <|endoftext|>"), (9, "x\x00y\x85z"), (10**12, "far id")]


def with_lost_row(spark, frame):
    """The rows and one without an id."""
    lost = spark.createDataFrame([(None, "nobody can name this row here")], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS segment", "NULL AS kept")
    return frame.unionByName(lost)
