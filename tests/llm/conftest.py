from __future__ import annotations

import pytest

PLAIN = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 700}x" for i in range(30_000))
BASE = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
#: NULL and empty texts, ties, repeated rows, odd white space, a very long text, near copies.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\v\f\r"),
    (4, BASE + " and more words that follow them"),
    (5, BASE.upper() + " AND MORE WORDS THAT FOLLOW THEM"),
    (5, BASE.upper() + " AND MORE WORDS THAT FOLLOW THEM"),
    (6, BASE + "\n" + BASE + "\n  " + BASE + "\t\n\n\nshort\nshort"),
    (7, "ÉÀ   word \x1c\x85 ÉÀÉÀÉÀÉÀÉÀ\nÉÀÉÀÉÀÉÀÉÀ\nßßßßßßßßßß"),
    (8, "ÉÀÉÀÉÀÉÀÉÀ\nßßßßßßßßßß\n" + BASE),
    (9, LONG),
    (10, LONG + " tail"),
    (11, "a a a a a a a a a a a a a a a a a a a a a a a"),
    (12, "### $$$ %%% &&& ||| <<< >>>"),
    (None, BASE),
    (None, None),
    (13, "<|endoftext|> <|STARTOFTEXT|> don't we'll 12345 Á x‍y 你好 😀"),
    (14, "x"),
    (15, "one two"),
    (16, "one  two"),
    (16, "another text on the same id, which is one document with the other row"),
]


@pytest.fixture(scope="module")
def given(spark):
    """Documents of the smallest test table, as rows."""
    return [(r[0], r[1]) for r in spark.read.parquet(f"{PLAIN}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def as_documents(spark):
    """A table of documents with further columns, some named like those the operators add."""

    def build(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, fingerprint string, uid int, _kept int"
        return spark.createDataFrame([(*r, None, "src0", 1, "k", "f", 0, 0) for r in rows], schema).repartition(3)

    return build


@pytest.fixture(autouse=True, scope="session")
def scratch(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def expected(rows):
    return sorted((tuple(r) for r in rows), key=repr)
