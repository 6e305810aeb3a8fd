"""Texts, patterns and word lists whose exact content defines the results."""

# Three-letter month prefixes, English and Spanish.
MONTH_PREFIXES = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12, "set": 9,
}

# Date texts, after normalization.
ABSOLUTE_EN = r"\b([a-z]{3,10})\s+(\d{1,2})(?:,?\s*(\d{4}))?\b"
ABSOLUTE_ES = r"\b(\d{1,2})\s+([a-z]{3,10})(?:\s+(\d{4}))?\b"
RELATIVE_AGO = r"(\d+)\s*(minute|min|mins|m|hour|hr|hrs|h|day|d|día)s?\s*ago"
RELATIVE_SHORT = r"(\d+)\s*(min|m|hr|h|d|day)s?\b"

# Stand-alone unit words of the first-generation date rules.
UNIT_WORDS_V1 = (
    ("min", "m", "mins", "minutos"),
    ("h", "hr", "hrs", "hour", "hours", "hora", "horas"),
    ("d", "day", "days", "día", "días"),
)

# Labels of the recency verdict.
NO_DATE_LABEL = "No date/Search"
UNKNOWN_LABEL = "Unknown"
RECENCY_OVERLAP_MINUTES = 5

# Interface noise deleted from article text, in this order.
NOISE = (
    r"\bAsk follow[- ]*up\b",
    r"\bSources\b",
    r"\bView more\b",
    r"\bDiscover more\b",
    r"\bRelated stories\b",
    r"\bCopy link\b",
    r"\bCopy\b",
    r"\bShare\b",
    r"\bModel\b",
    r"\bBack to Discover\b",
    r"\bView original\b",
    r"\bRead more\b",
    r"^\s*\+\d+\s*$",
    r"^\s*\d+\s*source(s)?\s*$",
    r"^\s*\d+\s*$",
    r"Published\s+on\s+.*",
    r"Search for anything\b",
    r"Explore Discover\b",
    r"Ask anything\.\.\.\b",
    r"Ad\s*$",
)
NOISE_V1 = (
    r"Ask follow[- ]*up\b",
    r"Sources\b",
    r"View more\b",
    r"Discover more\b",
    r"Related stories\b",
    r"Copy link\b",
    r"Share\b",
    r"Model\b",
    r"Back to Discover\b",
)

# Terms tagged in article text. The site's own name is added to the companies by
# ``entities.site_lexicon``.
LEXICON = {
    "skills": ("python", "javascript", "react", "playwright", "scraping",
               "ai", "ml", "automation", "api", "cloud"),
    "companies": ("google", "microsoft", "openai", "meta", "apple", "nvidia", "amazon"),
    "keywords": ("gpu", "cdp", "browser", "stable", "cli", "concurrency", "performance"),
}

# Dates on article pages: what a date element looks like, then patterns for the page text.
DATE_ELEMENT = r"\d+\s*(m|h|d|min|hour|day|ago)|\d{4}"
DATE_IN_TEXT = (
    r"Published\s*\n\s*(\d+)\s*(minute|min|mins|hour|hr|hrs|day|d)s?\s*ago",
    r"Publicado\s*\n\s*(\d+)\s*abr",
    r"Publicado\s*el\s*(\d+.*202\d)",
    r"(\d+)\s*(minute|min|mins|hour|hr|hrs|day|d)s?\s*ago",
    r"(\d+)(min|h|d|m|hr)s?\s*ago",
    r"\d{1,2}\s+(?:de\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ene|abr|ago|dic|[a-z]{4,10})"
    r"\s+(?:de\s+)?202\d",
)
DATE_STRING_V1 = r"(ago|hace|minutes|hours|days|ayer|yesterday|minuto|hora|día)"
FEED_TIME = r"\d+\s*(m|h|d|min|hour|day|seg|sec|hora|día)|yesterday|ayer|ago|hace"

# Classes of the row that shows the time on a first-generation card.
CARD_ROW_CLASSES = ("gap-x-xs", "items-center")
MONTHS_V1 = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNTITLED = "Noticia Sin Título"
UNTITLED_V1 = "Untitled"
UNTITLED_SOURCE = "External Source"
NO_CONTENT = "No content."

# Pages that are not articles.
CHALLENGE_TITLE = "Just a moment..."
CHALLENGE_MARKS = ("Verify you are human", "cf-challenge")
LOGIN_BUTTONS = ("Sign Up", "Sign In")
