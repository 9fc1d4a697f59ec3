"""Small tables with the odd cases that every operator must take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = "word " * 40_000 + "password = abcdefghij1234567 " + "tail é ß " * 500
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, "One two THREE four five six seven", "en", "b", 33),
        (4, "One two THREE four five six seven", None, None, 33),
        (5, long, "en", "b", len(long)),
        (None, "token: 'ABCDEFGH12345678' deadbeefdeadbeef", "de", "c", 9),
        (7, " \n\t ", "en", "", 4),
    ]
    clash = ("fp", "node", "size", "sources", "taken", "spans", "ids", "score", "toxic", "kept", "tie", "doc", "next_text", "fingerprint", "term", "rank", "shard")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in clash})
