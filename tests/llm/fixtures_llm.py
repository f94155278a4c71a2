"""A documents table with extra columns whose names clash with results."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_tokens string, score string"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], SCHEMA)
