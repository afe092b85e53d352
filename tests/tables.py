"""Paths, small tables and helpers that the tests share."""

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

FIVE = [
    ("POL001", "auto", 800.0, 24, 2, 0, 1, 1.0, 20.0, 35, "Direct", 1, 0.0, 30),
    ("POL002", "home", 520.0, 60, 5, 1, 3, 0.8, 50.0, 55, "Broker", 3, 3.0, 200),
    ("POL003", "auto", 1200.0, 6, 0, 2, 2, 0.5, 60.0, 22, "Online", 1, 12.0, 10),
    ("POL004", "health", 600.0, 36, 3, 0, 0, 1.0, 0.0, 40, "Agent", 2, -2.0, None),
    ("POL005", "auto", 900.0, 120, 10, 0, 5, 1.0, 15.0, 68, "Direct", 2, 1.5, 365),
]
LABELS = [0, 1, 0, 1, 0]



def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
