"""Helpers that tests import by this name; conftest holds fixtures only."""

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Sorted tuples, floats rounded."""
    out = df.select(*cols).collect()
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in out), key=str)
