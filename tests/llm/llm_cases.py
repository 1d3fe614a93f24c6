"""Tables and texts for the tests of the text operators."""

import pytest

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return make


#: Texts on which most code goes wrong first.
AWKWARD = [
    None, "", " ", "\n", "\n\n \t", "a", "é", "the the the the", "a  b   c", " lead", "trail ", "x\r\ny", "tab\tbed", "\x1c\x1d odd \x85 next line",
    "<|endoftext|> stays", "don't WE'LL it's 'S", "日本語のテキスト 中文", "é ́ ä", "🙂🙃 👩‍👩‍👧", "1234567890 12 ٣٤", "#$%&|<>***", "ß İ ı Σς ﬁ",
    "​ nbsp　wide", "a" * 5000, "word " * 3000, "-" * 300 + " " * 300 + "\n" * 50, "�\U0010ffff\x00\x7f",
]
