from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import ODD, SMALL  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    """The small documents table as Python rows [(doc_id, text)]."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)


@pytest.fixture(scope="session")
def odd(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, fp long, "
    names += "piece int, target double, component_id long, fingerprint string, n_words long, mark long, root long, "
    names += "row_mark string, pii_key int, pii_found int, mix_order int, mix_part int, mix_source int, mix_cut int"
    rows = [
        (i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, *[None] * 17)
        for k, (i, t) in enumerate(ODD)
    ]
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
