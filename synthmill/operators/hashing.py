"""Schema hashes for tables of schema documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from synthmill.schema import Schema


@F.pandas_udf(T.StringType())
def _hash(documents: pd.Series) -> pd.Series:
    return documents.map(lambda text: None if text is None else Schema.from_json(text).hash())


def schema_hash(document: Column) -> Column:
    """Hash of each JSON schema document; equal to ``Schema.hash`` of the parsed schema."""
    return _hash(document)
