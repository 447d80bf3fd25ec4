import json

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table from rows with columns of the documents table and extra ones."""

    def make(rows, schema="doc_id long, text string", slices=2):
        return spark.createDataFrame(rows, schema).repartition(slices)

    return make


def dump(rows):
    return json.dumps(rows, default=str, indent=1)
