"""Comparison of results across engines."""

SMALL = "/root/testdata/sf0.001"


def plain(value):
    """A comparable form of a cell of either engine."""
    if value is None or str(value) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype") and getattr(value, "ndim", 1) == 0:
        return round(float(value), 6) if not hasattr(value, "isoformat") else str(value)
    return str(value)[:10] if hasattr(value, "isoformat") and str(value).endswith("00:00:00") else str(value)


def table(frame):
    """Column names and the rows as a sorted list, whatever their order."""
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)
