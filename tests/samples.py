"""Small tables for the unit tests: the loans of a library, and readings of water meters."""

from datetime import date, datetime


def loans(spark):
    """15 loans: two cards twice, two without a due date, one without renewals, three states."""
    rows = []
    for i in range(1, 16):
        card = {6: 2, 11: 4}.get(i, i)
        state = "open" if i % 5 == 0 else "lost" if i in (4, 8) else "back"
        rows.append((i, f"C-{card:02d}", None if i in (3, 9) else date(2025, 6, i), f" Reader {i} " if i % 4 == 0 else f"Reader {i}",
                     ("Mill", "North", "South")[i % 3], "ABCD"[i % 4], None if i == 5 else i % 3, i * i / 4, state))
    return spark.createDataFrame(rows, "loan int, card string, due date, reader string, branch string, shelf string, renewals int,"
                                       " fee double, state string")


def meters(spark):
    """7 readings of 4 meters."""
    rows = [(f"M{i % 4}", f"{i} Brook Lane", 1.5 * i, 3.0 - i / 4, "ok" if i % 3 else "leak", datetime(2025, 6, 1, 6 + i // 4, 5 * i)) for i in range(7)]
    return spark.createDataFrame(rows, "meter string, street string, flow double, pressure double, state string, read_at timestamp_ntz")
