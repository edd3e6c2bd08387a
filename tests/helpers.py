def table(df, *keys):
    """Rows as a dict keyed by the given columns, remaining columns as a tuple."""
    rest = [c for c in df.columns if c not in keys]
    out = {}
    for row in df.collect():
        k = tuple(row[c] for c in keys)
        assert k not in out, f"repeated key {k}"
        value = tuple(row[c] for c in rest)
        out[k[0] if len(k) == 1 else k] = value[0] if len(value) == 1 else value
    return out


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
