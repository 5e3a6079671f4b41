"""Shorthand for window frames in the SQL twins."""

P = "PARTITION BY symbol ORDER BY date"


def frame(n: int, skip: int = 0, by: str = P) -> str:
    last = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"OVER ({by} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {last})"


def over(by: str = P) -> str:
    return f"OVER ({by})"


def running(by: str = P) -> str:
    return f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rolled(call: str, counted: str, n: int, least: int | None = None, skip: int = 0) -> str:
    f = frame(n, skip)
    return f"CASE WHEN count({counted}) {f} >= {n if least is None else least} THEN {call} {f} END"


def prev(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({P})"
