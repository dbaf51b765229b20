"""Small frames with every odd case, for all operators."""

LONG = "ab cd ef gh ij " * 40_000


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and further columns with clashing names."""
    rows = [(1, "one two three four five", "x", None, 1), (1, "one two three four five", "x", None, 1),
            (None, "one two three four five", None, "k", None), (2, None, "x", "k", 2), (3, "", "x", "k", 2),
            (4, " \t\n ", "x", "k", 2), (5, LONG, "x", "k", 2), (None, None, None, None, None), (6, "solo", "x", "k", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, fp string, n_chars bigint").selectExpr(
        "*", "'?' AS mark", "1 AS words", "2 AS seeds", "3 AS shard", "4 AS length", "5 AS row_mark", "6 AS text_mark",
        "7 AS clean_text", "8 AS toxicity_grade", "9 AS component_id")


def no_documents(spark):
    return odd_documents(spark).limit(0)


def columns(df):
    return [tuple(r) for r in df.collect()]
