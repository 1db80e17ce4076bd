from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000)) + "."
#: Texts that every operator must take: null, empty, blank, short, odd characters, very long.
ODD_TEXTS = [None, "", " \n\t ", "one", "a b c", "Ünïcödé \U0001f600 中文   x y", "<|im_end|> <\\|a|b", "x" * 100_000, LONG, f"x@{'b.' * 2000}com"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls in every column, repeated rows and ids, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"src{i % 2}", 1, i, True, 7, 1, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, "the same row twice here now", "en", None, 1, 1, None, None, None, None)] * 2
    rows += [(None, "a text without an id is here", None, "src1", None, None, None, None, 0, None)]
    rows += [(3, "another text for id three", "en", "src0", 2, 5, False, 3, 0, "y")]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept boolean, "
        "_id bigint, label int, _found string"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
