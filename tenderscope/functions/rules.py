"""Rule ladders and classes as native column expressions (no UDFs).

All thresholds, weights and category names below are fixed values of the
analysis and must stay equal to the published rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
# procedure risk ladder (Q12)
PROCEDURE_RISK_TOP = ("NEGOTIATED_WITHOUT_PUBLICATION", "OUTRIGHT_AWARD")   # 1.0
PROCEDURE_RISK_NEGOTIATED_PATTERN = "%NEGOTIATED%"                         # 0.75
PROCEDURE_RISK_RESTRICTED = ("RESTRICTED", "COMPETITIVE_DIALOG")           # 0.35
PROCEDURE_RISK_OPEN = "OPEN"                                               # 0.05, else 0.50
# competition risk ladder (Q12): bids <= 1 -> 1.0, = 2 -> 0.65, 3..5 -> 0.30, else 0.05
# dependency class (Q02): ratio > 0.8 HIGH, > 0.5 MEDIUM, else LOW
# risk class (M06): prob >= 0.75 HIGH, >= 0.45 MEDIUM, else LOW
RISK_CLASS_HIGH = 0.75
RISK_CLASS_MEDIUM = 0.45
# risk label (F5): level 2 needs dependency > 0.7 and amendments > 2;
# level 1 fires on dependency > 0.5 or amendments between 1 and 2
LABEL_DEPENDENCY = (0.7, 0.5)
LABEL_AMENDMENTS = 2
# --------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# the ladders as tables: (kind of test, values, score), first match wins
PROCEDURE_LADDER = (("in", PROCEDURE_RISK_TOP, 1.0), ("ilike", PROCEDURE_RISK_NEGOTIATED_PATTERN, 0.75),
                    ("in", PROCEDURE_RISK_RESTRICTED, 0.35), ("in", (PROCEDURE_RISK_OPEN,), 0.05))
PROCEDURE_RISK_ELSE = 0.50
COMPETITION_LADDER = ((None, 1, 1.0), (2, 2, 0.65), (3, 5, 0.30))  # (lowest, highest bid count, score)
COMPETITION_RISK_ELSE = 0.05


def procedure_risk(procedure_type="procedure_type") -> Column:
    p = _c(procedure_type)
    out = F
    for kind, values, score in PROCEDURE_LADDER:
        out = out.when(p.isin(*values) if kind == "in" else p.ilike(values), F.lit(score))
    return out.otherwise(F.lit(PROCEDURE_RISK_ELSE))


def competition_risk(bid_count="bid_count") -> Column:
    b = _c(bid_count)
    out = F.when(b.isNull(), F.lit(None).cast("double"))
    for low, high, score in COMPETITION_LADDER:
        out = out.when(b <= high if low is None else b.between(low, high), F.lit(score))
    return out.otherwise(F.lit(COMPETITION_RISK_ELSE))


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def procedure_risk_sql(p: str = "procedure_type") -> str:
    """The procedure ladder as an SQL expression."""
    tests = [f"WHEN {p} IN ({_quoted(v)}) THEN {s}" if kind == "in" else f"WHEN {p} ILIKE '{v}' THEN {s}"
             for kind, v, s in PROCEDURE_LADDER]
    return f"CAST(CASE {' '.join(tests)} ELSE {PROCEDURE_RISK_ELSE} END AS DOUBLE)"


def competition_risk_sql(b: str = "bid_count") -> str:
    """The competition ladder as an SQL expression."""
    tests = [f"WHEN {b} <= {high} THEN {s}" if low is None else f"WHEN {b} >= {low} AND {b} <= {high} THEN {s}"
             for low, high, s in COMPETITION_LADDER]
    return f"CAST(CASE WHEN {b} IS NULL THEN NULL {' '.join(tests)} ELSE {COMPETITION_RISK_ELSE} END AS DOUBLE)"


def risk_class_sql(prob: str) -> str:
    """The risk classes as an SQL expression."""
    return f"CASE WHEN {prob} >= {RISK_CLASS_HIGH} THEN 'HIGH' WHEN {prob} >= {RISK_CLASS_MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END"


def risk_label_sql(p: str, bids: str, dependency: str, amendments: str) -> str:
    """The three-level label as an SQL expression (``dependency`` not null)."""
    single = f"COALESCE({bids} <= 1, FALSE)"
    top = f"{p} IN ({_quoted(PROCEDURE_RISK_TOP)})"
    some = " OR ".join((f"{p} ILIKE '{PROCEDURE_RISK_NEGOTIATED_PATTERN}'", f"{p} = '{PROCEDURE_RISK_RESTRICTED[0]}'", single,
                        f"{dependency} > {LABEL_DEPENDENCY[1]}", f"{amendments} >= 1 AND {amendments} <= {LABEL_AMENDMENTS}"))
    both = f"{top} AND {single} AND {dependency} > {LABEL_DEPENDENCY[0]} AND {amendments} > {LABEL_AMENDMENTS}"
    return f"CASE WHEN {both} THEN 2 WHEN {some} THEN 1 ELSE 0 END"


def dependency_class(ratio) -> Column:
    r = _c(ratio)
    return F.when(r > 0.8, F.lit("HIGH")).when(r > 0.5, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def risk_class(prob) -> Column:
    p = _c(prob)
    return (F.when(p >= RISK_CLASS_HIGH, F.lit("HIGH"))
            .when(p >= RISK_CLASS_MEDIUM, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def single_bid_zero_null(bid_count="bid_count", le_one: bool = True) -> Column:
    """SQL rule: a NULL bid count counts as *not* single (0.0)."""
    b = _c(bid_count)
    cond = (b <= 1) if le_one else (b == 1)
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def single_bid_observed(bid_count="bid_count") -> Column:
    """Null-skipping rule: NULL stays NULL so ``avg`` ignores it."""
    b = _c(bid_count)
    return (b <= 1).cast("double")


def risk_label(procedure_type="procedure_type", bid_count="bid_count",
               dependency="buyer_dependency_ratio", amendments="contract_amendments") -> Column:
    """Three-level rule label (F5); dependency NULL counts as 0."""
    p, b, a = _c(procedure_type), _c(bid_count), _c(amendments)
    d = F.coalesce(_c(dependency), F.lit(0.0))
    single = b.isNotNull() & (b <= 1)
    level2 = p.isin(*PROCEDURE_RISK_TOP) & single & (d > LABEL_DEPENDENCY[0]) & (a > LABEL_AMENDMENTS)
    level1 = (p.ilike(PROCEDURE_RISK_NEGOTIATED_PATTERN) | (p == "RESTRICTED") | single
              | (d > LABEL_DEPENDENCY[1]) | a.between(1, LABEL_AMENDMENTS))
    return F.when(level2, F.lit(2)).when(level1, F.lit(1)).otherwise(F.lit(0))


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def mean_of(total, count) -> Column:
    """total / count, NULL when the count is 0."""
    t, n = _c(total), _c(count)
    return t / F.nullif(n.cast("double"), F.lit(0.0))
