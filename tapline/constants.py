"""Domain constants.

FIXED VALUES — these must equal the source application's values for the
results to agree (material rules, keyword groups, specification limits,
class edges, desirability scores).  They are plain data, listed in their
natural order; every operator takes them as overridable parameters.
"""

from __future__ import annotations

# --- fixed values: burden material classifier, first match wins ----------
# (group column, substrings tested against the upper-cased brand code)
MATERIAL_RULES: list[tuple[str, list[str]]] = [
    ("coke_kg", ["COKE", "NUTCOKE"]),
    ("sinter_kg", ["SINTER"]),
    ("pellet_kg", ["PELLET"]),
    ("ore_kg", ["ORE", "BHQ"]),
    ("limestone_kg", ["LIMESTONE"]),
    ("dolomite_kg", ["DOLOMITE"]),
    ("dri_kg", ["DRI"]),
    ("mixedmaterial_kg", ["MIXED"]),
]
MATERIAL_DEFAULT = "other_kg"
# The six-target variant adds one more rule before the default.
MATERIAL_RULES_WITH_SCRAP = MATERIAL_RULES + [("scrap_kg", ["SCRAP"])]

MATERIAL_GROUPS = [g for g, _ in MATERIAL_RULES] + [MATERIAL_DEFAULT]

# --- fixed values: keyword weight groups, non-exclusive (regex OR) -------
# time-series variant
KEYWORD_GROUPS: list[tuple[str, list[str]]] = [
    ("coke_kg", ["coke", "cok"]),
    ("sinter_kg", ["sinter", "sint", "smallsinter"]),
    ("pellet_kg", ["pellet", "pell"]),
    ("ore_kg", ["ironore", "ore", "bhq"]),
    ("flux_kg", ["limestone", "lime", "dolomite", "dolo", "quartzite", "quartz"]),
    ("nutcoke_kg", ["nutcoke", "nut"]),
    ("dri_kg", ["dri"]),
    ("mix_kg", ["mix", "return", "mixed"]),
]
# classification variant
KEYWORD_GROUPS_CLS: list[tuple[str, list[str]]] = [
    ("coke_kg", ["coke", "cok"]),
    ("sinter_kg", ["sinter", "sint"]),
    ("pellet_kg", ["pellet", "pell"]),
    ("ore_kg", ["ore", "bhq"]),
    ("flux_kg", ["lime", "dolo"]),
    ("pci_kg", ["pci", "coal"]),
    ("dri_kg", ["dri"]),
]

# --- fixed values: specification limits (target, lo, hi), closed ---------
SPEC_LIMITS: dict[str, tuple[float, float]] = {
    "hm_c": (4.30, 4.90),
    "hm_si": (0.25, 0.80),
    "hm_s": (0.00, 0.055),
    "hm_mn": (0.80, 1.80),
    "hm_p": (0.00, 0.180),
    "hm_temp": (1470.0, 1540.0),
}
# the time-series / classification variant of the temperature window
TEMP_SPEC_NARROW = (1480.0, 1535.0)
SI_SPEC = (0.25, 0.80)

# --- fixed values: right-closed class edges ------------------------------
SI_EDGES = (0.25, 0.80)
SI_LABELS = ("Low", "Normal", "High")
TEMP_EDGES = (1480.0, 1535.0)
TEMP_LABELS = ("Low", "Normal", "High")
TEMP_LABELS_HOTCOLD = ("Cold", "Normal", "Hot")

# --- fixed values: quality grade limits ----------------------------------
S_MAX = 0.055
P_MAX = 0.180

# --- fixed values: desirability of a predicted class ---------------------
DESIRABILITY: dict[str, dict[str, float]] = {
    "si_class": {"Normal": 1.0, "Low": -1.0, "High": -1.0},
    "temp_class": {"Normal": 1.0, "Cold": -1.0, "Hot": -1.0},
    "quality_grade": {"A": 1.0, "B": 0.5, "C": -1.0},
}
ALERT_THRESHOLD = 0.5

# --- fixed values: process timing ----------------------------------------
BURDEN_DESCENT_HOURS = 8
ASOF_TOLERANCE_HOURS = 4
IQR_K = 3.0
IQR_K_WIDE = 3.5
SENSITIVITY_POINTS = 25
TOP_K_FEATURES = 9
