import pytest

pytest.importorskip("codeloom.llm")
