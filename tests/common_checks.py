"""What the tests share."""

SF = "/root/testdata/sf0.001"


def same_rows(frame, duck, sql):
    """Compare a Spark result to a DuckDB result, columns by name, rows in any order."""
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    theirs = [tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in found.fetchall()]
    assert sorted(frame.columns) == sorted(names)
    ours = [tuple(r) for r in frame.select(*sorted(names)).collect()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(ours, key=order) == sorted(theirs, key=order)
