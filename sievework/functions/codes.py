"""Code sets, limits and weights.

Fixed values: they have to equal the published domain values for results to agree.
"""

STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS",
    "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY",
    "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV",
    "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
)
PERMIT_STATUS_CODES = ("ADC", "EFF", "EXP", "NON", "TRM", "RET")
ACTIVE_PERMIT_CODES = ("ADC", "EFF")
MAJOR_MINOR_FLAGS = ("Y", "N", "M")
CORE_MAJOR_MINOR = ("Major", "Minor", "N")
COMPLIANCE_STATUS_CODES = ("SNC", "RNC", "VIO", "NOV", "COM")
HLRNC_CODES = ("", " ", "S", "C", "X", "T", "D", "E")
PROGRAM_SYSTEMS = ("TRIS", "NETS", "GHGP", "CAMD")
HAP_VOC_FLAGS = ("", " ", "Y", "N", "HAP", "VOC", "BOTH")
UNIT_NAMES = ("Pounds", "Tons", "Kilograms", "Grams", "Short Tons", "Metric Tons")
PROGRAM_TYPES = ("AIR", "WATER", "WASTE", "DRINKING_WATER", "TRI")
RUN_STATUSES = ("RUNNING", "SUCCESS", "FAILED", "CANCELLED")
FINDING_TYPES = (
    "MISSING_VALUE", "INVALID_FORMAT", "OUT_OF_RANGE", "DUPLICATE_KEY", "REFERENTIAL_INTEGRITY",
    "BUSINESS_RULE", "DATA_ANOMALY",
)
FINDING_SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RESOLUTION_STATUSES = ("OPEN", "RESOLVED", "ACCEPTED")
LINEAGE_TYPES = ("DIRECT_COPY", "CALCULATED", "LOOKUP", "AGGREGATED", "DERIVED", "SPLIT", "MERGED")

NPDES_ID_PATTERN = r"^[A-Z]{2}[0-9A-Z]+$"
REGISTRY_ID_PATTERN = r"^\d{11,12}$"
YEARQTR_PATTERN = r"^(19|20)\d{2}[1-4]$"

LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
REGION_RANGE = (1, 10)
PH_RANGE = (0.0, 14.0)
EMISSION_RANGE = (0.0, 1_000_000_000.0)
FLOW_RANGE = (0.0, 10_000.0)
VIOLATION_COUNT_RANGE = (0, 999)
MAX_PENALTY = 50_000_000.0
FIRST_YEAR = 1970
FIRST_EMISSION_YEAR = 1990

NULL_TOKENS = ("nan", "NaN", "NULL", "null", "")

# Weight of one violation of each kind in the compliance score.
VIOLATION_WEIGHTS = (("nume90q", 3.0), ("numcvdt", 2.0), ("numpsch", 1.5), ("numsvcd", 1.0))
VIOLATIONS_FOR_ZERO_SCORE = 20.0
COMPLIANT_FROM = 80.0

# Deductions of the row quality score.
ROW_DEDUCTIONS = {"required": 0.4, "coordinates": 0.2, "range": 0.1, "anomaly": 0.1}
REVIEW_BELOW = 0.7

# Abbreviations spelled out in names, applied in this order.
NAME_EXPANSIONS = (
    ("CORP?", "CORPORATION"),
    ("CO", "COMPANY"),
    ("INC", "INCORPORATED"),
    ("LLC", "LIMITED LIABILITY COMPANY"),
    ("LTD", "LIMITED"),
    ("&", "AND"),
    ("WWTP", "WASTEWATER TREATMENT PLANT"),
    ("WTP", "WATER TREATMENT PLANT"),
)

# Boxes for the region derived from a position: region, lat from, lat below, lon above, lon up to.
REGION_BOXES = (
    (1, 40, None, None, -70),
    (2, 40, None, -80, -70),
    (3, 35, 40, -85, -75),
    (4, 35, 45, -90, -80),
    (5, 35, 45, -100, -85),
    (6, 30, 40, -110, -95),
    (7, 35, 45, -110, -95),
    (8, 40, None, -115, -100),
    (9, 35, None, None, -115),
    (10, 45, None, None, -110),
)

# Unit spellings, upper case, with the name to show and the factor to pounds.
UNITS = (
    ("LBS", "Pounds", 1.0),
    ("POUNDS", "Pounds", 1.0),
    ("TON", "Tons", 2000.0),
    ("TONS", "Tons", 2000.0),
    ("KG", "Kilograms", 2.20462),
    ("KILOGRAMS", "Kilograms", 2.20462),
    ("G", "Grams", 0.00220462),
    ("GRAMS", "Grams", 0.00220462),
    ("SHORT TONS", "Short Tons", 2000.0),
    ("METRIC TONS", "Metric Tons", 2204.62),
)

# Dimensions of the overall quality score.
QUALITY_WEIGHTS = {
    "completeness": 0.25, "accuracy": 0.30, "consistency": 0.20, "uniqueness": 0.15, "timeliness": 0.10,
}
LETTER_GRADES = ((90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D"))
FINE_GRADES = ((95.0, "A+"), (90.0, "A"), (85.0, "B+"), (80.0, "B"), (75.0, "C+"), (70.0, "C"))
