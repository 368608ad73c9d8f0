"""Comparison of rows."""


def same(got, want):
    """Equal as bags of rows."""
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
