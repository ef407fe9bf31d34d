import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [
        (1, "a b c d e f g h i j k l m n o p", "en", "s1", 1, "k", 0.5),
        (1, "a b c d e f g h i j k l m n o p", "en", "s1", 1, "k", 0.5),
        (2, None, None, None, None, None, None),
        (None, "null id text with more than ten words in it so that it stays in", "en", "s1", 2, "k", 0.1),
        (3, "", "en", "s2", 0, None, 0.2),
        (4, " \t\n ", "en", "s2", 0, None, 0.2),
        (5, long, "en", "s1", len(long), "k", 0.3),
        (6, "A B C D E F G H I J K L M N O P", "en", "s3", 3, "k", 0.4),
        (7, "é" * 3000, "fr", "s3", 3000, "k", 0.4),
        (8, "▁ odd <|endoftext|> \x00 \x1c marks 漢字 🙂 <0x41>  two\r\n", "xx", "s3", 3, "k", 0.4),
        (8, "another text of the same id, which is allowed to be there as well", "xx", "s3", 3, "k", 0.4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
