"""Name → SQL text of the independent check."""

ORACLES: dict[str, str] = {}
