import pytest

import public_tokenizers


@pytest.fixture(scope="session")
def vocab():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def docs_of(spark):
    """A small table of documents from (doc_id, text) pairs, with columns that clash with inner names."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "x", 7) for i, t in rows]
        return spark.createDataFrame(
            full,
            "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, kind int",
        )

    return make


#: Nulls, empty and blank texts, ties, repeated rows, control characters, long texts.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today. " * 3),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today. " * 3),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today. " * 3),
    (3, None),
    (3, ""),
    (None, "Null ids take part, too, with some words that make this text long enough to matter here."),
    (None, None),
    (4, " \n\t \n"),
    (5, "é中🙂\x00\x1c\x85\xa0 <|endoftext|> ▁ a  b\n\nc\r\nd"),
    (6, "word " * 20000),
    (7, "x" * 30000),
    (9, "one two three"),
    (10, "one two three"),
    (-5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]
