import pytest

WORDS = "the of and ing er tion café naïve straße niño don't 42 x-y idiot you".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows and ids, ties, a very long text,
    a text without spaces, special tokens, and columns with clashing names."""
    long_text = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(9000))
    rows = [
        (1, "the of and ing er tion the of and"), (2, "the of and ing er tion the of and"), (2, "the of and ing er tion the of and"),
        (3, None), (4, ""), (5, " \n\t "), (None, "a text without an id, the of and"), (6, long_text), (7, "ab" * 20000),
        (8, "<|endoftext|> and <|startoftext|>"), (9, "日本語 テキスト é\u0301 \u00a0 x"), (10, "one\ntwo\nthree\nfour\nfive\nsix\nseven"),
        (11, "zero\none\ntwo\nthree\nfour\nfive\nsix\nseven\nmore"), (2**60 + 1, "short"), (-5, "THE OF AND ing er tion the of and"),
    ]
    cols = "doc_id long, text string, size int, shard string, start int, n_lines int, score string, features string, kept string, row_id int, label string, prediction string, x int, y int"
    return spark.createDataFrame([(*r, 1, "s", 2, 3, "q", "f", "k", 4, "l", "p", 5, 6) for r in rows], cols)
