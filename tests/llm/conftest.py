import pytest

#: names that the operators use inside; extra columns of these names must not disturb them
CLASHES = ("part", "unit", "bucket", "key", "k", "rep", "w", "size", "seed", "fingerprint", "n_tokens", "quality_score", "lang_pred", "lang_score",
           "copies", "ids", "h1", "band", "tail", "ord", "bad_id", "gone", "_k", "_copies", "cell", "block", "start", "viterbi_score")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, source[, lang]]) tuples, with extra columns of clashing names."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])
        return df

    return make


@pytest.fixture(scope="session")
def empty_docs(docs_of):
    return docs_of([])
