"""Fixed values. They must stay as they are for results to be right."""

# Topic words, matched as substrings of lower-cased text (fixed values).
CRIME_WORDS_V1 = [
    "crime", "police", "theft", "robbery", "smuggl", "arrest", "kidnap",
    "homicide", "murder", "offence", "violence", "money laund",
]
CRIME_WORDS = [
    "crime", "criminal", "police", "theft", "robbery", "smuggl", "arrest", "kidnap",
    "homicide", "murder", "offence", "violence", "money laund",
]
INCOME_WORDS = [
    "salary", "income", "housing", "mortgage", "liability", "debt", "expensive",
    "afford", "job", "work", "strike", "compensation", "luxur", "finance",
    "financial", "equality", "fairness", "inequal", "unfair",
]
# None means every post belongs to the topic.
TOPICS = {"crime": CRIME_WORDS, "income": INCOME_WORDS, "sentiment": None}

# State names and their abbreviations, replaced in this order (fixed values).
STATES = [
    ("australian capital territory", "act"),
    ("new south wales", "nsw"),
    ("northern territory", "nt"),
    ("queensland", "qld"),
    ("south australia", "sa"),
    ("tasmania", "tas"),
    ("victoria", "vic"),
    ("western australia", "wa"),
]

# Places that name no suburb; an optional filter list (fixed values).
INVALID_PLACES = [
    "act australia", "nsw australia", "nt australia", "qld australia", "sa australia",
    "tas australia", "vic australia", "wa australia", "australia",
]

# Names of the nine score points (fixed values).
SCORE_LABELS = {
    1: "Extremely Negative",
    2: "Very Strongly Negative",
    3: "Strongly Negative",
    4: "Negative",
    5: "Neutral",
    6: "Positive",
    7: "Strongly Positive",
    8: "Very Strongly Positive",
    9: "Extremely Positive",
}
INVALID_SCORE = "Invalid score"

PERCENTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
FENCE_FACTOR = 1.5
MIN_ID_LENGTH = 15
PAGE_SIZE = 40
BATCH_SIZE = 1000
ID_PARTITIONS = 4
SERVERS = ["SOCIAL", "AU", "TICTOC_SOCIAL"]

# Official crime table: source column -> metric name (fixed values).
OFFENCES = {
    " total_division_a_offences": "against the person",
    " total_division_b_offences": "property and deception",
    " total_division_c_offences": "drug offences",
    " total_division_d_offences": "public order and security",
    " total_division_e_offences": "justice procedures",
    " total_division_f_offences": "other offences",
}
TOTAL_OFFENCES = "total_all_offences"

# Official income table: metrics, and those that take part in outlier removal (fixed values).
INCOME_METRICS = ["mean_aud", " median_aud", " sum_aud", " median_age_of_earners_years"]
INCOME_FENCED = ["mean_aud", " median_aud", " sum_aud"]
STATE_OF_INTEREST = "Victoria"
