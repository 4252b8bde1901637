"""Hand-made frames."""

import datetime as dt

FIRST = dt.date(2020, 1, 1)


def day(n: int) -> dt.date:
    return FIRST + dt.timedelta(days=n)


def bars(spark, closes: dict[str, list[float]], volumes: dict[str, list[float]] | None = None):
    rows = [
        (ticker, day(i), c, c + 1, c - 1, c, (volumes or {}).get(ticker, [100.0] * len(values))[i])
        for ticker, values in closes.items()
        for i, c in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "ticker string, date date, open double, high double, low double, close double, volume double"
    )


def rows_by(frame, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in frame.collect()}
