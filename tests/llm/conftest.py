import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import documents, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, odd_texts(), extra=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def strange(spark):
    """Repeated ids, repeated rows and null ids."""
    texts = [t for t in odd_texts() if t is None or len(t) < 5000]
    ids = [None if i % 5 == 0 else i // 3 for i in range(len(texts))]
    return documents(spark, texts + texts[:4], ids=ids + ids[:4])
