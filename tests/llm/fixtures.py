"""Small tables with every awkward case."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("text_hash", "fingerprint", "component", "part", "batch", "size", "rate", "copies", "perplexity", "keep", "round", "held_out", "dropped", "own_hash", "n")

LONG_LINE = "A line that several of the documents share with one another."
LICENSE = "Licensed under the Apache License, Version 2.0."


def rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    texts = [
        (1, f"{base}\n{LONG_LINE}\nend one", "en", "a"),
        (2, f"  {LONG_LINE.upper()} \t\nsecond text", "en", "a"),
        (3, f"{LONG_LINE}\n{LONG_LINE}\nthird", "de", "b"),
        (4, base, "en", None),
        (5, base, "en", "b"),
        (6, base + " again", None, "c"),
        (7, "", "en", "a"),
        (8, None, "en", "a"),
        (9, " \n\t ", "fr", "b"),
        (10, f"Some code.\n# {LICENSE}\nMore code follows here", "en", "z"),
        (11, "word", "en", "z"),
        (12, "é à ü ß 日本 🙂 É́ <|endoftext|> <s>", "fr", "é"),
        (13, "x" * 3000, "en", "a"),
        (14, ("many words in one long text " * 700).strip(), "en", "b"),
        (None, base, "en", "a"),
        (15, f"{base}\n{LONG_LINE}", "en", "a"),
        (15, f"{base}\n{LONG_LINE}", "en", "a"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(spark):
    df = documents(spark)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
