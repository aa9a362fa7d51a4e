"""Word lists and abbreviation tables of the linkage data model."""

from __future__ import annotations

# fixed values
GENERIC_TOKENS = (
    "the", "private", "limited", "ltd", "llc", "inc", "incorporated", "corp", "corporation", "company", "co", "pvt",
    "plc", "llp", "group", "holdings", "holding", "services", "service", "solutions", "international", "india", "usa",
    "us",
)

# fixed values
NAME_STOP = (
    "the", "and", "for", "ltd", "pvt", "inc", "corp", "llc", "company", "limited", "private", "services", "solutions",
    "enterprises", "center", "centre", "group", "india", "us", "usa", "co", "of",
)

# fixed values
NAME_STOP_LONG = (
    *NAME_STOP, "international", "technology", "management", "incorporated", "corporation", "association", "department",
    "manufacturing",
)

# fixed values
ADDRESS_STOP = (
    "street", "avenue", "road", "floor", "building", "opposite", "near", "block", "colony", "nagar", "sector",
    "pennsylvania", "california", "texas", "maharashtra", "karnataka", "delhi", "haryana", "tamil", "nadu", "kerala",
    "bengal", "pradesh", "mumbai", "bangalore", "chennai", "kolkata",
)

# fixed values
NAME_STOP_SHORT = (
    "the", "and", "for", "ltd", "pvt", "inc", "corp", "llc", "company", "limited", "private", "services", "solutions",
    "enterprises",
)

# fixed values
NAME_STOP_RARE = (
    "private", "limited", "incorporated", "corporation", "company", "services", "enterprises", "associates",
    "consultants", "industries", "international", "solutions", "technologies", "holdings", "management", "development",
    "commercial", "general", "medical", "dental", "health", "center", "national", "global",
)

# fixed values
BRAND_LEGAL = ("private", "limited", "incorporated", "corporation", "company", "llc", "llp", "services")

# fixed values
STRIPPED_LEGAL = ("llc", "llp", "inc", "incorporated", "corp", "corporation", "pvt", "private", "ltd", "limited", "co", "company")

# fixed values: abbreviation -> legal form, in order of application
LEGAL_FORMS = (
    ("pvt", "private"), ("ltd", "limited"), ("inc", "incorporated"), ("corp", "corporation"), ("co", "company"),
    ("llc", "llc"), ("llp", "llp"), ("dept", "department"), ("assoc", "association"), ("intl", "international"),
    ("mfg", "manufacturing"), ("tech", "technology"), ("svcs", "services"), ("mgmt", "management"), ("sarl", "sarl"),
    ("sas", "sas"), ("sasu", "sasu"), ("sa", "sa"), ("eurl", "eurl"), ("snc", "snc"), ("gie", "gie"), ("ste", "societe"),
)

# fixed values: abbreviation -> address word, in order of application
ADDRESS_FORMS = (
    ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("dr", "drive"), ("ln", "lane"), ("blvd", "boulevard"),
    ("hwy", "highway"), ("pkwy", "parkway"), ("ct", "court"), ("pl", "place"), ("sq", "square"), ("apt", "apartment"),
    ("ste", "suite"), ("bldg", "building"), ("fl", "floor"), ("opp", "opposite"), ("nr", "near"), ("rue", "street"),
    ("bd", "boulevard"), ("av", "avenue"), ("all", "allee"), ("allee", "allee"), ("chemin", "chemin"), ("ch", "chemin"),
    ("impasse", "impasse"), ("imp", "impasse"), ("cedex", "cedex"),
)

# fixed values: state codes by country; without a country the later of two equal codes holds
STATES_US = (
    ("ca", "california"), ("ny", "new york"), ("tx", "texas"), ("fl", "florida"), ("il", "illinois"),
    ("pa", "pennsylvania"), ("oh", "ohio"), ("ga", "georgia"), ("nc", "north carolina"), ("mi", "michigan"),
    ("nj", "new jersey"), ("va", "virginia"), ("wa", "washington"), ("az", "arizona"), ("ma", "massachusetts"),
    ("wi", "wisconsin"), ("co", "colorado"), ("mn", "minnesota"), ("mo", "missouri"), ("md", "maryland"),
    ("in", "indiana"), ("tn", "tennessee"),
)

# fixed values
STATES_IN = (
    ("mh", "maharashtra"), ("ka", "karnataka"), ("tn", "tamil nadu"), ("dl", "delhi"), ("up", "uttar pradesh"),
    ("wb", "west bengal"), ("gj", "gujarat"), ("rj", "rajasthan"), ("mp", "madhya pradesh"), ("ap", "andhra pradesh"),
    ("ts", "telangana"), ("kl", "kerala"), ("hr", "haryana"), ("pb", "punjab"), ("br", "bihar"), ("or", "odisha"),
)

# fixed values: state names in their own scripts
SCRIPT_ALIASES = (
    ("পশ্চিমবঙ্গ", "west bengal"), ("ગુજરાત", "gujarat"), ("महाराष्ट्र", "maharashtra"), ("मध्य प्रदेश", "madhya pradesh"),
    ("मध्यप्रदेश", "madhya pradesh"), ("उत्तर प्रदेश", "uttar pradesh"), ("उत्तरप्रदेश", "uttar pradesh"), ("राजस्थान", "rajasthan"),
    ("कर्नाटक", "karnataka"), ("तमिलनाडु", "tamil nadu"), ("केरल", "kerala"), ("हरियाणा", "haryana"), ("पंजाब", "punjab"),
    ("दिल्ली", "delhi"), ("बिहार", "bihar"), ("ओडिशा", "odisha"),
)

# fixed values
HOUSE_PATTERN = r"(?:^|#|\bno\.?|\bplot\.?|\bflat\.?|\bunit\s*)\s*(\d+[a-z]?)"
# fixed values
POSTAL_PATTERN = r"\b(\d{5,6})\b"
# fixed values: web addresses, domain endings, phone numbers and id tags that a full normal form drops
SCRUBBED_PATTERNS = (
    r"(?i)https?://\S+|www\.\S+",
    r"(?i)\.(?:com|org|net|co|in|us|fr|gov|edu|info|biz)\b",
    r"(?:-\s*\d{7,}|\b\d{10}\b|#\d{5,})",
)
# fixed values: honorific and trading prefixes of a name
HONORIFIC_PATTERN = r"^(?:shri|sri|sree|m\s*s|dr|prof)\s+"
# fixed values
TRADING_PATTERN = r"^(?:d\s*b\s*a|t\s*a|trading\s+as)\s+"
# fixed values: a house number after its mark, in a full normal form
MARKED_HOUSE_PATTERN = r"(?:^|#|plot\s*no\.?|q\.?no\.?|flat\s*no\.?|unit\s*)\s*(\d+[a-zA-Z]?)"
# fixed values
UNIT_PATTERN = r"(?:unit|plot|flat|shop|room|floor)\s+([a-z0-9]+)"
# fixed values
TRADE_PATTERN = r"(?i)\b(?:d/?b/?a|t/?a|trading as|doing business as|m/s\.?|c/o)\s+(.*)"
# fixed values
FORMERLY_PATTERN = r"(?i)(?:formerly|aka|d/?b/?a|t/?a|c/?o)\s*:?\s*(.*)"
# fixed values
PLOT_PATTERN = r"(?:plot|door|flat|unit|h\.?no\.?|q\.?no\.?)\s*(?:no\.?)?\s*([a-z]?[0-9]+)"
# fixed values: probability of a token-index pair by the tokens it shares, at least
SHARED_PROBABILITY = ((4, 0.82), (3, 0.77), (2, 0.72))
# fixed values: probability a deterministic rule or channel states
RULE_PROBABILITY = {"R1": 0.9995, "R2": 0.9990, "R3": 0.9992, "R4": 0.9988, "R5": 0.9995, "R6": 0.9994, "R7": 0.95, "R8": 0.88, "R9": 0.85}
