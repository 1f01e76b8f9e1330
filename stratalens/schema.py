"""Column groups, sentinels, category levels and labels of the survey tables.

Everything here is a fixed value of the published survey layout. The naming
convention (three-letter items, six-letter demographics, ``_befor_``,
``EVER_``, ``_IMP``) is the schema: later steps select columns by pattern.
"""

from __future__ import annotations

# --- fixed values: sentinels inside age columns --------------------------------
NON_USER = 991          # non-user
USER_AGE_UNKNOWN = 993  # user, age not known
NEVER_USED = 999        # never used
REAL_AGE_BELOW = 100    # an age is real below this value
SOFT_USER_BELOW = 150   # a soft item was used when its age is below this value

# --- fixed values: raw columns --------------------------------------------------
RAW_DESIGN = ["VEREP", "VESTR_C", "ANALWT2_C"]
RAW_SOFT = ["IRCDUAGE", "IRCIGAGE", "IRNICVAPAGE", "IRALCAGE", "IRMJAGE"]
RAW_NONMEDICAL = ["IRCOCAGE", "IRHERAGE", "IRCRKAGE", "IRHALLUCAGE", "IRMETHAMAGE"]
RAW_PRESCRIPTION = ["IRSEDNMAGE", "IRTRQNMAGE", "IRPNRNMAGE", "IRSTMNMAGE"]
RAW_IMPUTATION = [
    "IICDUAGE", "IICIGAGE", "IINICVAPAGE", "IIALCAGE", "IIMJAGE",
    "IICOCAGE", "IIHERAGE", "IICRKAGE", "IIHALLUCAGE",
    "IISEDNMAGE", "IITRQNMAGE", "IIPNRNMAGE", "IISTMNMAGE", "IIMETHAMAGE",
]
RAW_DEMOGRAPHIC = [
    "IRSEX", "AGE3", "CATAGE", "INCOME", "NEWRACE2",
    "SNRLDCSN", "YERLDCSN", "EDUHIGHCAT", "PDEN10",
]
RAW_DEMOGRAPHIC_IMPUTATION = ["IIEDUHIGHST2", "IIFAMIN3"]
RAW_COLUMNS = (
    RAW_DESIGN + RAW_SOFT + RAW_NONMEDICAL + RAW_PRESCRIPTION
    + RAW_DEMOGRAPHIC + RAW_IMPUTATION + RAW_DEMOGRAPHIC_IMPUTATION
)

# --- fixed values: raw name -> analysis name -----------------------------------
RENAME = {
    "IRCDUAGE": "ESM", "IRCIGAGE": "FSM", "IRNICVAPAGE": "VAP", "IRALCAGE": "ALC", "IRMJAGE": "MRJ",
    "IRCOCAGE": "COC", "IRHERAGE": "HER", "IRCRKAGE": "CRK", "IRHALLUCAGE": "HAL",
    "IRSEDNMAGE": "SED", "IRTRQNMAGE": "TRQ", "IRPNRNMAGE": "PNK", "IRSTMNMAGE": "STM",
    "IRMETHAMAGE": "MTH",
    "IICDUAGE": "ESM_IMP", "IICIGAGE": "FSM_IMP", "IINICVAPAGE": "VAP_IMP", "IIALCAGE": "ALC_IMP",
    "IIMJAGE": "MRJ_IMP", "IICOCAGE": "COC_IMP", "IIHERAGE": "HER_IMP", "IICRKAGE": "CRK_IMP",
    "IIHALLUCAGE": "HAL_IMP", "IISEDNMAGE": "SED_IMP", "IITRQNMAGE": "TRQ_IMP",
    "IIPNRNMAGE": "PNK_IMP", "IISTMNMAGE": "STM_IMP", "IIMETHAMAGE": "MTH_IMP",
    "IRSEX": "GENDER", "CATAGE": "AGECAT", "AGE3": "AGEPRC", "INCOME": "TOTINC",
    "IIFAMIN3": "TOTINC_IMP", "NEWRACE2": "ETHNIC", "SNRLDCSN": "RLGIFA", "YERLDCSN": "RLGIFY",
    "EDUHIGHCAT": "EDUCAT", "IIEDUHIGHST2": "EDUCAT_IMP", "PDEN10": "POPDEN",
}

# --- fixed values: analysis column groups --------------------------------------
PSU, STRATUM, WEIGHT = "VEREP", "VESTR_C", "ANALWT2_C"
SOFT = ["ESM", "FSM", "VAP", "ALC", "MRJ"]
NONMEDICAL = ["COC", "HER", "CRK", "HAL", "MTH"]
PRESCRIPTION = ["SED", "TRQ", "PNK", "STM"]
AGGREGATES = {
    "MED": PRESCRIPTION,
    "NMD": NONMEDICAL,
    "HDG": NONMEDICAL + PRESCRIPTION,
}
HARD = ["MED"] + PRESCRIPTION + ["NMD"] + NONMEDICAL + ["HDG"]
SINGLE_HARD = ["COC", "HER", "CRK", "HAL", "SED", "TRQ", "PNK", "STM", "MTH"]
ITEMS = SOFT + NONMEDICAL + PRESCRIPTION
PRIOR_USE = ["ALC", "VAP", "SMK", "MRJ"]
IMPUTED = ITEMS + ["TOTINC", "EDUCAT"]
DEMOGRAPHIC = ["GENDER", "AGEPRC", "TOTINC", "ETHNIC", "EDUCAT", "POPDEN", "RLGINF"]
MODEL_DEMOGRAPHIC = ["GENDER", "ETHNIC", "RLGINF"]

# --- fixed values: level lists --------------------------------------------------
PREDICTOR_LEVELS = {
    "ALC_befor": [0, 1], "VAP_befor": [0, 1], "SMK_befor": [0, 1, 2], "MRJ_befor": [0, 1],
    "GENDER": [1, 2], "ETHNIC": [1, 2, 3, 4], "RLGINF": [1, 2, 3, 4],
}
TERM_ORDER = [
    "(Intercept)", "ALC_befor1", "VAP_befor1", "SMK_befor1", "SMK_befor2", "MRJ_befor1",
    "GENDER2", "ETHNIC2", "ETHNIC3", "ETHNIC4", "RLGINF2", "RLGINF3", "RLGINF4",
]
METRIC_ORDER = ["R_NK", "Precision", "Recall", "F1_Score", "AUC"]
METRIC_TERMS = ["R_boot", "R_NK", "Recall", "Precision", "F1_Score", "AUC"]
METRIC_LABELS = {"R_NK": "R_{NK}", "F1_Score": "F1 score"}
AGE_BAND_LOWER = {1: 12, 2: 14, 3: 16, 4: 18, 5: 21, 6: 24, 7: 26, 8: 30, 9: 35, 10: 50, 11: 65}
ITEM_ORDER = [
    "ALC", "FSM", "MRJ", "VAP", "ESM", "HDG", "NMD", "COC", "HER", "CRK", "HAL", "MTH",
    "MED", "PNK", "STM", "TRQ", "SED",
]

# --- fixed values: category labels ----------------------------------------------
LABELS = {
    "GENDER": ["M", "F"],
    "AGEPRC": ["12-13", "14-15", "16-17", "18-20", "21-23", "24-25", "26-29", "30-34",
               "35-49", "50-64", "65+"],
    "ETHNIC": ["White", "Black", "Hispanic", "Other"],
    "TOTINC": ["≤ $20k", "$20k–$49k", "$50k–$74k", "$75k+"],
    "POPDEN": ["CBSA ≥1 mln", "CBSA <1 mln", "Outside CBSA"],
    "EDUCAT": ["Element.", "Średnie", "Stud. cz.", "Higher", "12–17 lat"],
    "RLGINF": ["1 S. No", "2 No", "3 Yes", "4 S. Yes"],
}
SHORT_LABELS = {
    "ETHNIC": ["White", "Black", "Hispanic", "Other"],
    "GENDER": ["Sex M", "Sex F"],
    "RLGINF": ["R1 S. No", "R2 No", "R3 Yes", "R4 S. Yes"],
}
USAGE_LABELS = {0: " never used", 1: " used"}
USAGE_OTHER = " addiction"
GROUP_SOFT, GROUP_AGGREGATE, GROUP_HARD = "'Soft'", "'Hard' aggregated", "'Hard'"
REGEX_RULES = [("EVER_(ALC|FSM|MRJ|VAP|ESM)", GROUP_SOFT), ("EVER_(HDG|NMD|MED)", GROUP_AGGREGATE)]
SET_RULES = [
    (["ALC", "FSM", "MRJ", "VAP", "ESM"], GROUP_SOFT),
    (["HDG", "MED", "NMD"], GROUP_AGGREGATE),
    (NONMEDICAL + PRESCRIPTION, GROUP_HARD),
]


def befor(soft: str, hard: str) -> str:
    return f"{soft}_befor_{hard}"


def ever(item: str) -> str:
    return f"EVER_{item}"
