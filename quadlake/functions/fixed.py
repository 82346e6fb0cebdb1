"""They must equal the published conventions for right results."""

# Sort order of terms inside a year (highest is latest).
TERM_ORDER = {"Fall": 5, "Summer2": 4, "Summer10wk": 3, "Summer1": 2, "Spring": 1, "Winter": 0}

# Chronological order of terms used for term constraints of degree rules.
TERM_ORDINAL = {"Winter": 0, "Spring": 1, "Summer1": 2, "Summer10wk": 3, "Summer2": 4, "Fall": 5}

# Academic-year order of the six terms in a calendar page.
CALENDAR_TERMS = ("Fall", "Winter", "Spring", "Summer1", "Summer10wk", "Summer2")

SUMMER_SESSIONS = ("Summer1", "Summer10wk", "Summer2")

# Long display names: prefix that stands before the year.
TERM_LONG = {
    "Fall": "Fall Quarter",
    "Winter": "Winter Quarter",
    "Spring": "Spring Quarter",
    "Summer1": "Summer Session 1",
    "Summer10wk": "10-wk Summer",
    "Summer2": "Summer Session 2",
}

# Names used when telling the current week.
TERM_WEEK = {
    "Fall": "Fall Quarter",
    "Winter": "Winter Quarter",
    "Spring": "Spring Quarter",
    "Summer1": "Summer Session I",
    "Summer10wk": "Summer Session 10WK",
    "Summer2": "Summer Session II",
}

# General-education categories.
CATEGORY_CODES = (
    "GE-1A", "GE-1B", "GE-2", "GE-3", "GE-4", "GE-5A", "GE-5B", "GE-6", "GE-7", "GE-8",
)
CATEGORY_PATTERNS = {
    "GE-1A": r"\bI[Aa]\b",
    "GE-1B": r"\bI[Bb]\b",
    "GE-2": r"\bII\b",
    "GE-3": r"\bIII\b",
    "GE-4": r"\bIV\b",
    "GE-5A": r"\bV\.?[Aa]\b",
    "GE-5B": r"\bV\.?[Bb]\b",
    "GE-6": r"\bVI\b",
    "GE-7": r"\bVII\b",
    "GE-8": r"\bVIII\b",
}

# Enrolment restriction codes.
RESTRICTION_CODES = (
    "A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L", "M", "N", "O", "R", "S", "X",
)

# Course levels: label -> (lowest number, highest number or None).
LEVEL_BANDS = {"LowerDiv": (1, 99), "UpperDiv": (100, 199), "Graduate": (200, None)}

# Day tokens in meeting strings, in week order from Monday.
DAY_TOKENS = ("M", "Tu", "W", "Th", "F", "Sa", "Su")

# Spellings callers may use for a day.
DAY_ALIASES = {
    "M": "M", "Mo": "M", "Mon": "M",
    "Tu": "Tu", "Tue": "Tu", "Tues": "Tu",
    "W": "W", "We": "W", "Wed": "W",
    "Th": "Th", "Thu": "Th", "Thur": "Th",
    "F": "F", "Fr": "F", "Fri": "F",
    "S": "Sa", "Sa": "Sa", "Sat": "Sa",
    "Su": "Su", "Sun": "Su",
}

# Day tokens in opening hours, in week order from Sunday.
HOURS_DAYS = ("Su", "Mo", "Tu", "We", "Th", "Fr", "Sa")

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")

# Department code -> common alias in search queries.
DEPARTMENT_ALIASES = {
    "COMPSCI": "CS",
    "EARTHSS": "ESS",
    "I&C SCI": "ICS",
    "IN4MATX": "INF",
    "ENGRMAE": "MAE",
    "WRITING": "WR",
}

# Weights of the four text fields (A strongest), as documented for PostgreSQL ranking.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

# English stop words, as published with the Snowball stemmers.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

# Degree-rule credit and term clauses.
CREDIT_CODES = ("DWCREDIT", "DWCREDITS")
TERM_CODES = ("DWTERM",)
INVERTED_OPERATOR = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "=": "<>", "<>": "="}

# Surnames of this length may be cut off in section listings.
SURNAME_CUTOFF = 14

# Sections per request chunk, and the end of the code space.
CHUNK_SIZE = 891
LAST_SECTION_CODE = 97999
