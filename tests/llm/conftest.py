import pytest

pytest.importorskip("pagespark.llm")
