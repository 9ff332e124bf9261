"""Column-level functions (JVM-side expressions, no Python UDFs).

Every function takes and returns ``pyspark.sql.Column`` so it stays inside
whole-stage codegen.  NaN is turned into NULL at ingest (``nan_to_null``)
so Spark's NULL semantics match the source's "missing is dropped" rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- B8 / B9 / B10: coercion ------------------------------------------------

def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def coerce_numeric(c) -> Column:
    """``to_numeric(errors='coerce')``: bad text becomes NULL, NaN becomes NULL."""
    return nan_to_null(_c(c).try_cast("double"))


def comma_numeric(c) -> Column:
    """Thousands-separated text ("1,533.790") to double; bad → NULL."""
    return nan_to_null(F.regexp_replace(_c(c).cast("string"), ",", "").try_cast("double"))


DEFAULT_TS_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)
DAYFIRST_TS_FORMATS = (
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
)


def coerce_timestamp(c, dayfirst: bool = False, formats: Sequence[str] | None = None) -> Column:
    """Text to TIMESTAMP_NTZ trying each format in turn; unparseable → NULL."""
    fmts = list(formats) if formats else (
        list(DAYFIRST_TS_FORMATS) + list(DEFAULT_TS_FORMATS) if dayfirst
        else list(DEFAULT_TS_FORMATS) + list(DAYFIRST_TS_FORMATS))
    s = F.trim(_c(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in fmts])


# --- B11 / B15 / B19 / B20: clock arithmetic -------------------------------

def floor_hour(c) -> Column:
    """Floor to the hour without touching the session time zone.

    Built from field extraction so a TIMESTAMP_NTZ stays wall-clock exact
    even in zones with half-hour offsets.
    """
    c = _c(c)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.lit(0), F.lit(0))


def floor_day(c) -> Column:
    c = _c(c)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.lit(0),
                                F.lit(0), F.lit(0))


def shift_hours(c, hours: int) -> Column:
    return _c(c) + F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def lag_hours(later: str, earlier: str) -> Column:
    """(later - earlier) in hours as double (column names)."""
    return F.expr(f"timestampdiff(MICROSECOND, `{earlier}`, `{later}`)") / F.lit(3.6e9)


def forecast_time(c, hours: int = 1) -> Column:
    """Base hour + h, formatted ``yyyy-MM-dd HH:mm``."""
    return F.date_format(shift_hours(c, hours), "yyyy-MM-dd HH:mm")


# --- B12 / B13: material rules ---------------------------------------------

def classify_material(brand, rules=None, default: str = K.MATERIAL_DEFAULT) -> Column:
    """First-match-wins substring rules on the trimmed, upper-cased brand."""
    rules = rules or K.MATERIAL_RULES
    b = F.upper(F.trim(_c(brand).cast("string")))
    expr = None
    for group, subs in rules:
        cond = None
        for s in subs:
            t = b.contains(s)
            cond = t if cond is None else (cond | t)
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    return expr.otherwise(F.lit(default))


def keyword_pattern(words: Sequence[str]) -> str:
    return "|".join(words)


def keyword_weight(brand, weight, words: Sequence[str]) -> Column:
    """Weight if the lower-cased brand matches any keyword, else 0 (non-exclusive)."""
    b = F.lower(F.trim(_c(brand).cast("string")))
    return F.when(b.rlike(keyword_pattern(words)), _c(weight)).otherwise(F.lit(0.0))


# --- B16-B18, I7: ratios ------------------------------------------------------

def safe_div(num, den) -> Column:
    """x / y with 0 or NULL denominator → NULL (ANSI-safe)."""
    return F.try_divide(_c(num), F.when(_c(den) == 0, F.lit(None)).otherwise(_c(den)))


def guarded_ratio(num, den, floor: float = 1.0, num_default=None, den_default=None) -> Column:
    """Inference-time ratio: num / max(den, floor) with defaults for missing."""
    n = _c(num) if num_default is None else F.coalesce(_c(num), F.lit(float(num_default)))
    d = _c(den) if den_default is None else F.coalesce(_c(den), F.lit(float(den_default)))
    return n / F.greatest(d, F.lit(float(floor)))


# --- I1-I6, I9, I10: labels and checks ------------------------------------------

def cut_right_closed(x, edges: Sequence[float], labels: Sequence[str],
                     missing_label: str | None = "nan") -> Column:
    """``pd.cut`` with right-closed bins (-inf, e1], (e1, e2], ..., (ek, inf)."""
    x = _c(x)
    expr = F.when(x.isNull(), F.lit(missing_label))
    for e, lab in zip(edges, labels):
        expr = expr.when(x <= F.lit(float(e)), F.lit(lab))
    return expr.otherwise(F.lit(labels[len(edges)]))


def tertile_label(x, q_lo, q_hi) -> Column:
    """x < q33 → 0, x ≤ q66 → 1, else 2 (asymmetric edges); NULL stays NULL."""
    x = _c(x)
    return (F.when(x.isNull(), F.lit(None).cast("int"))
            .when(x < _c(q_lo), F.lit(0)).when(x <= _c(q_hi), F.lit(1)).otherwise(F.lit(2)))


def in_spec(x, lo, hi) -> Column:
    """Closed interval check; NULL input → false."""
    x = _c(x)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.coalesce((x >= lo) & (x <= hi), F.lit(False))


def quality_grade(si, temp, s=None, p=None, si_spec=K.SI_SPEC, temp_spec=K.TEMP_SPEC_NARROW,
                  s_max: float = K.S_MAX, p_max: float = K.P_MAX) -> Column:
    """Count failed checks (missing counts as failed): 0 → A, 1 → B, ≥2 → C."""
    fails = [F.when(in_spec(si, *si_spec), 0).otherwise(1),
             F.when(in_spec(temp, *temp_spec), 0).otherwise(1)]
    if s is not None:
        fails.append(F.when(F.coalesce(_c(s) <= F.lit(s_max), F.lit(False)), 0).otherwise(1))
    if p is not None:
        fails.append(F.when(F.coalesce(_c(p) <= F.lit(p_max), F.lit(False)), 0).otherwise(1))
    n_off = fails[0]
    for f in fails[1:]:
        n_off = n_off + f
    return F.when(n_off == 0, "A").when(n_off == 1, "B").otherwise("C")


def desirability(target: str, label) -> Column:
    """Class → desirability score for one target; unknown → 0."""
    table = K.DESIRABILITY.get(target, {})
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]) \
        if table else None
    if m is None:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(m, _c(label)), F.lit(0.0))


def alert_text(score) -> Column:
    return F.when(_c(score) >= F.lit(K.ALERT_THRESHOLD), "OK").otherwise("OFF-SPEC")


def feature_family(name) -> Column:
    return F.when(F.upper(_c(name)).startswith("BRD_"), "Burden").otherwise("Process")


def guidance(delta_si, delta_temp) -> Column:
    """Text from the signs of last−first response deltas."""
    a, b = _c(delta_si), _c(delta_temp)
    return (F.when((a > 0) & (b > 0), "raises both silicon and temperature")
            .when((a < 0) & (b < 0), "lowers both silicon and temperature")
            .when((a > 0) & (b <= 0), "raises silicon, not temperature")
            .when((a <= 0) & (b > 0), "raises temperature, not silicon")
            .when((a == 0) & (b < 0), "lowers temperature, not silicon")
            .when((a < 0) & (b == 0), "lowers silicon, not temperature")
            .otherwise("little effect on either target"))


def linspace(a, b, n: int = K.SENSITIVITY_POINTS) -> Column:
    """Array of ``n`` equally spaced points from a to b (inclusive)."""
    a, b = _c(a), _c(b)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: a + (b - a) * i.cast("double") / F.lit(float(n - 1)))
