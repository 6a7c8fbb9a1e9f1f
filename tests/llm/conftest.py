from __future__ import annotations

import pytest

from quillmill.llm import common


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """A few buckets are enough for fixtures; more would only cost time."""
    monkeypatch.setattr(common, "MIN_BUCKETS", 3)
