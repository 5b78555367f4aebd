import pytest

# Names that the operators use inside; a table may have them too.
CLASHING = "id row text_ spans open one two band key slot shard keep_id kept group_size score rank label letters cell same words bands samples".split()


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang]) as a table with the columns of documents and some that clash."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), *[f"x{i}" for i in range(len(CLASHING))]) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame(full, schema).repartition(parts, "source", "n_chars", "doc_id")

    return make


ODD = [
    (1, None), (2, ""), (3, ""), (4, "a"), (5, "one two three"), (6, "One Two THREE"), (7, " \n\t "), (8, "### $$$"),
    (9, "x" * 300_000), (10, "word " * 40_000), (11, "Ünïcode ß 漢字 😀 \u0000 end"), (12, "same text again"), (12, "same text again"),
    (13, "it's <|endoftext|> <|ENDOFTEXT|> áb  —,é×÷ don't"),
]
