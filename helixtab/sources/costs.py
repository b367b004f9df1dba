"""Cost sets as four small tables; NULL cost means infinite. All are keyed by cost_set and small enough to broadcast:
a set has at most some hundred rows, and sets are chosen by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "cost_set string, p string, s string, dir string, cost bigint"
STEP = "cost_set string, name string, lo bigint, hi bigint, cost bigint"
SUBST = "cost_set string, tbl string, c1 string, c2 string, cost bigint"
GAPS = "cost_set string, tbl string, c string, open bigint, extend bigint"
FAR = 1 << 40

# The three cost sets. base: reverse costs of RR, RQ, QR, QQ; the others as breakpoints (input, cost).
# The gap function for the forward direction is 0 up to 0 and infinite after; forward base costs as the reverse ones.
SETS = {
    "sample": {"base": (3, 2, 2, 3), "offset": (-100, 100), "length": [(0, None), (5, 5), (6, 3), (7, 1), (8, 0), (100, None)], "difference": [(-FAR, None), (-100, 0), (101, None)], "primary": (2, 3, 1, 0), "secondary": (8, 9, 2, 4)},
    "bench": {"base": (2, 2, 2, 2), "offset": (-100, 100), "length": [(0, None), (10, 0), (200, None)], "difference": [(-FAR, None), (-100, 4), (-20, 2), (-10, 0), (11, 2), (21, 4), (101, None)], "primary": (2, 3, 1, None), "secondary": (4, 3, 2, None)},
    "experiments": {"base": (3, 2, 2, 3), "offset": (-300, 300), "length": [(0, None), (10, 0), (200, None)], "difference": [(-FAR, None), (-100, 4), (-20, 2), (-10, 0), (11, 2), (21, 4), (101, None)], "primary": (2, 3, 1, 0), "secondary": (4, 3, 2, 1)},
}


def _rows() -> dict[str, list[tuple]]:
    base, step, subst, gaps = [], [], [], []
    for name, c in SETS.items():
        for (p, s), cost in zip(("RR", "RQ", "QR", "QQ"), c["base"]):
            base += [(name, p, s, "R", cost), (name, p, s, "F", cost)]
        lo, hi = c["offset"]
        functions = {"RQQROffset": [(-FAR, None), (lo, 0), (hi + 1, None)], "RRQQOffset": [(-FAR, None), (lo, 0), (hi + 1, None)], "Length": c["length"], "LengthDifference": c["difference"], "ReverseAntiPrimaryGap": [(-FAR, 0)], "ForwardAntiPrimaryGap": [(-FAR, 0), (1, None)]}
        for fn, points in functions.items():
            step += [(name, fn, x, y, cost) for (x, cost), (y, _) in zip(points, [*points[1:], (FAR, None)])]
        for table in ("primary", "secondary"):
            sub, open_, extend, n = c[table]
            letters = "ACGT" + "N" * (n is not None)
            subst += [(name, table, a, b, (n if "N" in a + b and not a == b == "N" else 0 if a == b else sub)) for a in letters for b in letters]
            gaps += [(name, table, a, open_, extend) for a in letters]
    return {"base_cost": base, "step_fn": step, "subst": subst, "gaps": gaps}


def load_costs(spark: SparkSession, path: str | None = None) -> dict[str, DataFrame]:
    """The tables base_cost, step_fn, subst and gaps from JSON files of these names in a folder, or the sets above."""
    schemas = {"base_cost": BASE, "step_fn": STEP, "subst": SUBST, "gaps": GAPS}
    if path:
        return {t: spark.read.schema(s).json(f"{path}/{t}") for t, s in schemas.items()}
    return {t: spark.createDataFrame(rows, schemas[t]) for t, rows in _rows().items()}


def of_set(costs: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    return {t: df.where(F.col("cost_set") == name).drop("cost_set") for t, df in costs.items()}
