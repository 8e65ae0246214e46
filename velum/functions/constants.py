"""Weights, thresholds and word lists that results depend on."""

# Certifications by country.
FAMILY_US = ["G", "PG"]
FAMILY_ES = ["A", "Ai", "APTA", "7", "TP"]
TEEN_US = ["PG-13"]
TEEN_ES = ["12"]
ADULT_US = ["R", "NC-17"]
ADULT_ES = ["16", "18"]

# Genres and terms that speak for or against a family audience.
SENSITIVE_GENRES = ["Horror", "Crime", "War", "Thriller"]
BOOST_GENRES = ["Animation", "Family", "Adventure", "Fantasy", "Comedy"]
FAMILY_TERMS = ["pixar", "disney", "magic", "friendship", "superhero", "superheroes", "school", "robot", "dinosaur", "time travel", "alien", "wizard", "family", "fantasy world"]
BLOCKED_TERMS = ["adolf hitler", "dictator", "drug", "fascism", "genocide", "gore", "hitler", "holocaust", "murder", "nazi", "nazism", "neo-nazi", "prison", "psychopath", "rape", "self harm", "serial killer", "slavery", "stand-up comedy", "suicide", "terrorism", "third reich", "torture"]

# Display score.
STAND_WEIGHTS = {"suitability": 0.22, "genre": 0.20, "recognition": 0.23, "recency": 0.16, "terms": 0.11, "reliability": 0.08}
STAND_SUITABILITY = {"family_friendly": 1.0, "teen": 0.80}
STAND_CERTIFIED_TEEN = 0.86
STAND_GENRES = {"Animation": 1.00, "Family": 1.00, "Adventure": 0.75, "Fantasy": 0.70, "Comedy": 0.60, "Science Fiction": 0.35, "Action": 0.30}
STAND_GENRE_FULL = 3.0
STAND_TERMS = {"pixar": 1.00, "disney": 1.00, "friendship": 0.85, "magic": 0.80, "family": 0.80, "fantasy world": 0.75, "school": 0.65, "robot": 0.60, "dinosaur": 0.60, "wizard": 0.60, "superhero": 0.45, "superheroes": 0.45, "time travel": 0.35, "alien": 0.30}
STAND_TERM_FULL = 2.5
STAND_GENRE_PENALTIES = {"Horror": 0.082, "Thriller": 0.06, "War": 0.05, "Crime": 0.03}
STAND_PENALTY_CAP = 0.10
STAND_CONTEXT_FACTOR = 0.35
STAND_CONTEXT_GENRES = ["Animation", "Comedy", "Adventure", "Fantasy"]
STAND_CATEGORY_PENALTIES = {"adult_or_sensitive": 0.25, "unknown": 0.15}
STAND_POPULARITY_FULL = 110.0

# Public catalogue.
COMMON_LANGUAGES = ["en", "es"]
PROTECTED_GENRES = ["Animation", "Family"]
MIN_STAND_SCORE = 0.5
LOW_COUNT, LOW_POPULARITY, LOW_SCORE = 250, 10.0, 0.55
MIN_RUNTIME = 70
REASON_LABELS = {"documentary": "Documental", "short_runtime": "Corto (< 70 min)"}

# Candidate score.
RELIABILITY_COUNT, RELIABILITY_AVERAGE = 0.65, 0.35
CANDIDATE_WEIGHTS = (0.60, 0.25, 0.15)
TAGS_FULL, TAGS_KEPT = 20, 35

# Models.
POPULARITY_PRIOR, POPULARITY_WEIGHTS = 250, (0.85, 0.15)
USER_SHRINK, CANDIDATE_SHRINK, SESSION_CENTRE = 25, 5, 3.0
CONTENT_WEIGHTS = {"genres": 1.0, "userTags": 0.95, "keywords": 0.90, "text": 0.70, "suitability": 0.25, "context": 0.20}
CONTENT_SCORE = (0.88, 0.12)
MMR_WEIGHT, POOL = 0.70, 100
FOLD_STEPS, FOLD_RATE, FOLD_REGULAR = 25, 0.01, 0.05

# Evidence of content explanations.
SIGNAL_WEIGHTS = {"tag": 1.00, "keyword": 0.95, "text": 0.70, "genre": 0.55}
SIGNAL_OTHER = 0.82
SIGNAL_FACTORS = {"generic": 0.72, "telling_pair": 1.18, "tagged": 1.08, "genre": 0.92, "idle_share": 0.40, "idle_least": 0.45, "five_words": 0.74, "four_words": 0.88, "three_words": 1.05}
GENERIC_SIGNALS = ["action", "adventure", "animation", "comedy", "family", "fantasy", "science fiction", "drama", "romance"]
SILENT_SIGNALS = ["duringcreditsstinger", "aftercreditsstinger", "woman director", "based on novel or book", "based on true story", "sequel", "from", "his", "her", "to stop", "cliche", "anti villain", "villain arrested", "dyslexia", "pin-up", "u.s. air force", "pearl harbor", "young", "man", "woman", "finds"]
