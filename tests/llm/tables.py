"""Small tables with the cases every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes int, score string, component_id string, label string"


def documents(spark, texts, first=0):
    """Documents with ids from ``first``; extra columns carry names that operators produce."""
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", None, 7, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "\n\n", "a", "é ß　日本 ", "a  b\t c \r\n", "word " * 400, "x" * 3000, "tie", "tie", "<|endoftext|> a <|endoftext|>", "it's we'll 've 12 3.4", "▁mark"]
