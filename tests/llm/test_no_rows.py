"""Licences and token counts of tables without rows, with columns of clashing names, and of NULL texts."""

import pytest
from pyspark.sql import functions as F

from clickmart.llm import queries
from tests.llm.conftest import rows_of

NAMES = ["op5_license_scan", "op6_token_counts"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "MIT License"), (3, "licensed under Apache 2")] * 2, "doc_id long, text string")
    clashing = docs.withColumns({name: F.lit(1) for name in ("labels", "n_words", "score", "detections", "n_tokens")})
    told = {}
    for name, df in (("odd", clashing), ("none", clashing.where("false"))):
        told[name] = str(tmp_path_factory.mktemp(name))
        df.write.parquet(f"{told[name]}/documents.parquet")
    return told


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, folders, name):
    assert queries.queries()[name](spark, folders["none"]).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_each_row_has_one_even_if_repeated(spark, folders, name):
    found = queries.queries()[name](spark, folders["odd"])
    assert sorted(r.doc_id or 0 for r in found.collect()) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_labels_of_odd_rows(spark, folders):
    found = queries.queries()["op5_license_scan"](spark, folders["odd"])
    assert set(rows_of(found, "doc_id", "n_words", "labels")) == {(1, 0, ""), (2, 0, ""), (None, 2, "mit"), (3, 4, "apache-2.0")}
