"""Documents that break careless code: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = ("The quick brown fox jumps over the lazy dog and runs away from it. " * 2000).strip()
TEXTS = [
    None, "", " \t\n", "a", "one two three four", "x" * 5000, "9" * 3000, "é 日本語 𝒳 ß́ ​", "<|endoftext|> <|startoftext|>x",
    "same text here with some words in it to be long enough", "same text here with some words in it to be long enough", LONG, LONG, "line\nline\nline\n\n\nline", "%%% ### $$$ | < >",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    # A null id, an id that repeats, and a row that repeats.
    return [*out, (None, "text of a document without an id", "en", "s1", 5), (3, "another text for the id three", None, None, 1), out[9], out[9]]


def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS)


def clashing(spark, *names):
    """The documents with extra columns of the given names."""
    from pyspark.sql import functions as F

    return docs(spark).withColumns({n: F.lit(f"kept {n}") for n in names})


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
