"""Rule tables: aliases, word lists, weights and patterns. Fixed values, which results depend on."""

from __future__ import annotations

# Country labels and the label each is published under.
COUNTRY_ALIASES = {
    "China (Mainland)": "China",
    "Hong Kong SAR": "Hong Kong",
    "Macau SAR": "Macau",
    "Türkiye": "Turkey",
    "U.S.": "United States",
    "USA": "United States",
    "U.K.": "United Kingdom",
}

# The alias tables of other steps, each used where it is named.
ALIAS_COUNTRIES = {"Hong Kong SAR": "Hong Kong", "China (Mainland)": "China", "United States of America": "United States", "USA": "United States"}
TARGET_COUNTRIES = {
    "China-Hong Kong": "Hong Kong", "China-Macau": "Macau", "China-Taiwan": "Taiwan", "Macao": "Macau", "Czech Republic": "Czechia", "Russian Federation": "Russia", "Türkiye": "Turkey",
}
REGISTRY_COUNTRIES = {
    "czech republic": "czechia", "hong kong sar": "hong kong", "korea": "south korea", "republic of korea": "south korea", "russian federation": "russia",
    "taiwan, province of china": "taiwan", "turkiye": "turkey", "united states of america": "united states", "uk": "united kingdom", "u k": "united kingdom",
}
COUNTRY_CODES = {
    "us": "united states", "gb": "united kingdom", "uk": "united kingdom", "cn": "china", "ca": "canada", "au": "australia", "de": "germany",
    "fr": "france", "it": "italy", "es": "spain", "ch": "switzerland", "nl": "netherlands", "be": "belgium", "se": "sweden", "fi": "finland",
    "at": "austria", "pl": "poland", "cz": "czechia", "tr": "turkey", "pt": "portugal", "no": "norway", "dk": "denmark", "ie": "ireland",
    "jp": "japan", "kr": "south korea", "in": "india", "tw": "taiwan",
}

# Regions of countries; others are their own region.
REGIONS = {
    "United States": "North America", "USA": "North America", "Canada": "North America",
    "United Kingdom": "United Kingdom", "U.K.": "United Kingdom",
    "Germany": "Western Europe", "France": "Western Europe", "Switzerland": "Western Europe",
    "Netherlands": "Western Europe", "Belgium": "Western Europe",
    "Sweden": "Northern Europe", "Norway": "Northern Europe", "Denmark": "Northern Europe",
    "Finland": "Northern Europe", "Italy": "Southern Europe", "Spain": "Southern Europe",
    "Austria": "Western Europe", "Ireland": "Northern Europe", "Portugal": "Southern Europe",
    "China": "China", "Japan": "Asia", "South Korea": "Asia", "Singapore": "Asia",
    "Hong Kong": "Asia", "Taiwan": "Asia", "Australia": "Oceania", "New Zealand": "Oceania",
}

# Words that institution names are compared without.
NAME_STOP_WORDS = ("the", "of", "university", "universite", "universitat", "universidad", "institute", "technology", "technische", "technical", "royal", "school", "college")

# Words that tell no institution from another, tokens and their English forms, and words in parentheses that are part of a name.
TOKEN_STOP_WORDS = (
    "and", "at", "college", "de", "for", "institute", "of", "school", "the", "universidad", "universita", "universitat", "universite", "universiteit", "university",
)
TOKEN_TRANSLATIONS = {
    "autonoma": "autonomous", "catolica": "catholic", "cattolica": "catholic", "catholique": "catholic", "nacional": "national", "nationale": "national",
    "politecnico": "polytechnic", "polytechnique": "polytechnic", "tecnica": "technical", "technische": "technical", "technique": "technical",
    "firenze": "florence", "koeln": "cologne", "koln": "cologne", "lisboa": "lisbon", "milano": "milan", "muenchen": "munich", "munchen": "munich",
    "napoli": "naples", "padova": "padua", "praha": "prague", "roma": "rome", "sevilla": "seville", "torino": "turin", "wien": "vienna",
}
PROTECTED_QUALIFIERS = ("branch", "campus", "college", "faculty", "hospital", "institute", "medical", "metropolitan", "school", "system")

# Application materials and their published names.
MATERIAL_ALIASES = {
    "cv": "CV", "curriculum vitae": "CV", "transcript": "Transcript", "bachelor transcript": "Transcript",
    "transcript of records": "Transcript", "degree": "Degree certificate", "degree certificate": "Degree certificate",
    "bachelor degree": "Degree certificate", "recommendation": "Recommendation letter",
    "recommendation letter": "Recommendation letter", "recommendation letters": "Recommendation letter",
    "letter of recommendation": "Recommendation letter", "reference letter": "Recommendation letter",
    "2 references": "Recommendation letter", "2 recommendation letters": "Recommendation letter",
    "two recommendation letters": "Recommendation letter", "motivation letter": "Motivation letter",
    "letter of motivation": "Motivation letter", "statement of purpose": "Motivation letter",
    "project essay": "Motivation letter", "english proof": "English proof", "english proof (b2)": "English proof",
    "english proof (b2/c1)": "English proof", "english proof (c1)": "English proof",
    "english certificate (c1)": "English proof", "english certificate (b2/c1)": "English proof",
    "english/french proof": "Language proof", "language certificate": "Language proof",
    "application form": "Application form", "online application": "Application form", "passport": "Passport",
    "portfolio": "Portfolio", "course descriptions": "Course descriptions", "gre": "GRE",
}
LOW_SIGNAL_MATERIALS = ("bachelor", "gre")

# Months by name.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

# Slugs that name no programme, and file names at the end of a path.
GENERIC_SLUGS = (
    "master", "masters", "program", "programs", "programme", "programmes", "all-programmes", "international-study-programmes", "specialized-master-degree",
    "recherche-html", "en", "fr", "studies", "education",
)
GENERIC_FILES = ("titulacio.html", "index.html", "default.html")

# Query keys that only track.
TRACKING_KEY = "^(?:utm_.+|fbclid|gclid|mc_cid|mc_eid|ref|source)$"

# Admission evidence by category, any case.
EVIDENCE_PATTERNS = {
    "requirements": r"\b(?:admission|entry|academic|eligibility|application)\s+requirements?\b|\b(?:admission|entry)\s+criteria\b|\bprerequisites?\b|\beligib(?:le|ility)\b|\b(?:minimum|required)\s+(?:gpa|grade|degree|credits?)\b|\b(?:requirements?|conditions?)\s+(?:for|of)\s+admission\b",
    "applicationWindow": r"\bapplication\s+(?:period|window|round|timeline|dates?|opens?|closes?)\b|\b(?:admission|application)\s+deadlines?\b|\bdeadline\s+(?:for|to)\s+appl(?:y|ication)\b|\bapplications?\s+(?:open|close|start|end)\b|\b(?:fall|spring|autumn|winter)\s+intake\b",
    "deadline": r"\b(?:admission|application|submission)\s+deadlines?\b|\bapplication\s+closes?\b|\bdeadline\s+(?:for|to)\s+(?:appl(?:y|ication)|submit|submission)\b|\b(?:submit|apply)\s+(?:before|by|no later than)\b",
    "documents": r"\b(?:required|supporting|application)\s+documents?\b|\bdocument(?:s|ation)\s+(?:required|needed)\b|\b(?:upload|submit|provide)\s+(?:the\s+following\s+)?documents?\b|\b(?:curriculum vitae|motivation letter|statement of purpose|academic transcript|recommendation letters?|letters? of recommendation)\b",
    "language": r"\b(?:english|language)\s+(?:language\s+)?(?:requirements?|proficiency|certificate|test|score)\b|\bproof of (?:english|language)\b|\b(?:ielts|toefl|cambridge english)\b|\b(?:minimum|required)\s+(?:ielts|toefl)\s+score\b",
}

# Discipline terms (group, term, weight).
DISCIPLINE_TERMS = (
    ("computer-science", "computer science", 12), ("computer-science", "computing", 8), ("computer-science", "informatics", 7),
    ("software", "software engineering", 12), ("software", "software", 8),
    ("data-ai", "data science", 12), ("data-ai", "data analytics", 9), ("data-ai", "artificial intelligence", 12), ("data-ai", "machine learning", 12), ("data-ai", "deep learning", 10),
    ("electrical-electronics", "electrical engineering", 12), ("electrical-electronics", "electronic engineering", 12), ("electrical-electronics", "electronics", 8), ("electrical-electronics", "embedded systems", 10), ("electrical-electronics", "telecommunications", 8),
    ("mechanical", "mechanical engineering", 12), ("mechanical", "mechatronics", 11), ("civil", "civil engineering", 12), ("civil", "structural engineering", 11),
    ("chemical", "chemical engineering", 12), ("chemical", "process engineering", 8),
    ("biomedical", "biomedical engineering", 12), ("biomedical", "bioengineering", 11), ("biomedical", "biotechnology", 7),
    ("aerospace", "aerospace engineering", 12), ("aerospace", "aeronautical engineering", 12),
    ("environmental-energy", "environmental engineering", 12), ("environmental-energy", "energy engineering", 11), ("environmental-energy", "energy systems", 9), ("environmental-energy", "renewable energy", 9),
    ("materials", "materials science", 11), ("materials", "materials engineering", 12),
    ("industrial-systems", "industrial engineering", 12), ("industrial-systems", "systems engineering", 10), ("industrial-systems", "engineering management", 6), ("industrial-systems", "construction management", 8),
    ("data-ai", "digital transformation", 7), ("robotics", "robotics", 12), ("robotics", "autonomous systems", 10), ("robotics", "robotic", 10),
    ("engineering-general", "master of technology", 10), ("engineering-general", "m tech", 8), ("engineering-general", "engineering", 5),
)

# Subjects by pattern on the folded title, the first that matches counts.
SUBJECTS = (
    ("Computer Science", r"computer|informatics|data|software|algorithm|\bai\b|artificial intelligence|machine learning"),
    ("Electrical Engineering", "electrical|electronic|embed|power|signal|telecomm|communication and information technology"),
    ("Mechanical Engineering", "mechan|robot|mechatron|aerospac|automot"),
    ("Mathematics", "math|statistic"),
    ("Physics", "physic"),
    ("Civil/Environmental Engineering", "civil|architect|construct|environ|geotec"),
    ("Economics/Management", "econ|manage|business|finance"),
    ("Life Sciences", "biolog|chemistr|life|bio|medical|health"),
)

# Hosts that are never an official source.
DENIED_HOSTS = (
    "wikipedia.org", "mastersportal.com", "studyportals.com", "findamasters.com", "masterstudies.com", "university-directory.eu", "globaladmissions.com", "collegelearners.org",
    "mygermanuniversity.com", "topuniversities.com", "timeshighereducation.com", "usnews.com", "globalstudyprep.com", "mastermania.com", "standyou.com", "goaustria.org",
)

# Platforms by marker, the first that matches counts.
PLATFORMS = (
    ("cloudflare", ("cloudflare", "cf-ray", "cf-mitigated", "cf-cache-status")),
    ("akamai", ("akamai", "akamai ghost", "x-akamai", "ak_bmsc")),
    ("imperva", ("imperva", "incapsula", "x-iinfo", "incap_ses")),
    ("sucuri", ("sucuri", "x-sucuri")),
    ("cloudfront", ("cloudfront", "x-amz-cf-")),
    ("azure-front-door", ("azure front door", "x-azure-ref")),
    ("fastly", ("fastly", "x-served-by")),
)
CAPTCHA_GATE = r"(?:captcha\s+(?:challenge|verification|required)|verify\s+(?:that\s+)?you(?:'|&#39;|&apos;)?re\s+human|verify\s+you\s+are\s+(?:a\s+)?human|are\s+you\s+(?:a\s+)?human|cf-chl-|challenges\.cloudflare\.com/turnstile)"
CAPTCHA_WIDGET = "(?:g-recaptcha|hcaptcha)"
CAPTCHA_INVISIBLE = r"""(?:size(?:=|%3D)(?:&quot;|['"])?invisible|grecaptcha-badge[^>]*visibility\s*:\s*hidden)"""

# Precedence of page statuses, and of capture statuses.
PAGE_STATUSES = {"captured": 5, "blocked": 4, "error": 3, "pending": 2, "missing": 1, "unknown": 0}
CAPTURE_STATUSES = {"captured": 5, "checked-no-program": 4, "needs-review": 3, "blocked": 2, "pending": 1}
