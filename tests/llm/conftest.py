import datetime

import pytest

LONG = "lorem ipsum dolor " * 4000


@pytest.fixture
def docs(make):
    """A small documents table from (doc_id, text), with columns whose names operators use themselves."""

    def build(rows):
        day = datetime.date(2024, 1, 1)
        full = [(i, t, "en", "src0", None if t is None else len(t), "d", -1, "b", day) for i, t in rows]
        return make(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept int, blob string, day date")

    return build
