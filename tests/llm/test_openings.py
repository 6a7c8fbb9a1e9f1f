"""The secret scan on what opens and never ends, and on comments within bindings."""

from __future__ import annotations

import time

import pytest

from quillmill.llm import secrets

PIECES = ['"a=/*"', "a=(/*\n", "a=(#", "a=(//", "<!--a=(", 'a="""', "a='", "a=[", "a=`", "a=\"'`", "a=(\n", "a=/**/", "a={", "a='''b=\"\"\"", "a=(/**/\n"]


@pytest.mark.parametrize("end", ["", "*/" + '"x"+' * 60_000])
@pytest.mark.parametrize("piece", PIECES)
def test_openings_without_an_end(piece, end):
    start = time.monotonic()
    secrets.spans(piece * ((1 << 19) // len(piece)) + end)
    assert time.monotonic() - start < 40  # growing with the square, this took a quarter of an hour


def test_comments_bound_what_they_hold():
    found = lambda text: [text[s:e] for s, k, e in secrets.spans(text)[1] if k == 3]
    assert found('a = /* db_secret = /* "Zx81kQpL0vT3nM6w" */ "plain words here"\n# my_token = ("Hq72LmX0aPzRt5Yc"\nnext = 1') == ["Hq72LmX0aPzRt5Yc"]
    assert found('db_secret = /* why */ "Zx81kQpL0vT3nM6w"\nmy_token = ( # why\n "Hq72LmX0aPzRt5Yc")') == ["Zx81kQpL0vT3nM6w", "Hq72LmX0aPzRt5Yc"]
