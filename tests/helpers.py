"""Small helpers of the tests."""


def rows(df):
    """All rows as tuples, in any order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
