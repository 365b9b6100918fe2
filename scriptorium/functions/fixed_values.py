"""Fixed values.

Everything in this module is data that must stay exactly as written for the
results to be right: rule lists whose *order* defines first-match semantics,
phrase lists, class maps, the stop-word list, sentinels and the stand-in
templates used to derive test inputs from the driver tables.
"""

# --- FIXED VALUES: country rule tiers (order is significant) -----------------

COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Antigua and Barbuda",
    "Argentina", "Armenia", "Australia", "Austria", "Azerbaijan", "Bahamas",
    "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium", "Belize",
    "Benin", "Bhutan", "Bolivia", "Bosnia and Herzegovina", "Botswana", "Brazil",
    "Brunei", "Bulgaria", "Burkina Faso", "Burundi", "Cape Verde", "Cambodia",
    "Cameroon", "Canada", "Central African Republic", "Chad", "Chile", "China",
    "Colombia", "Comoros", "Congo", "Costa Rica", "Croatia", "Cuba",
    "Cyprus", "Czech Republic", "Democratic Republic of the Congo", "Denmark",
    "Djibouti", "Dominica", "Dominican Republic", "Ecuador", "Egypt", "El Salvador",
    "Equatorial Guinea", "Eritrea", "Estonia", "Eswatini", "Ethiopia", "Fiji",
    "Finland", "France", "Gabon", "Gambia", "Georgia", "Germany",
    "Ghana", "Greece", "Grenada", "Guatemala", "Guinea", "Guinea-Bissau",
    "Guyana", "Haiti", "Honduras", "Hungary", "Iceland", "India",
    "Indonesia", "Iran", "Iraq", "Ireland", "Israel", "Italy",
    "Jamaica", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati",
    "Korea", "Kuwait", "Kyrgyzstan", "Laos", "Latvia", "Lebanon",
    "Lesotho", "Liberia", "Libya", "Liechtenstein", "Lithuania", "Luxembourg",
    "Madagascar", "Malawi", "Malaysia", "Maldives", "Mali", "Malta",
    "Marshall Islands", "Mauritania", "Mauritius", "Mexico", "Micronesia",
    "Moldova", "Monaco", "Mongolia", "Montenegro", "Morocco", "Mozambique",
    "Myanmar", "Namibia", "Nauru", "Nepal", "Netherlands", "New Zealand",
    "Nicaragua", "Niger", "Nigeria", "North Macedonia", "Norway", "Oman",
    "Pakistan", "Palau", "Palestine", "Panama", "Papua New Guinea",
    "Paraguay", "Peru", "Philippines", "Poland", "Portugal", "Qatar",
    "Romania", "Russia", "Rwanda", "Saint Kitts and Nevis", "Saint Lucia",
    "Saint Vincent and the Grenadines", "Samoa", "San Marino", "São Tomé and Príncipe",
    "Saudi Arabia", "Senegal", "Serbia", "Seychelles", "Sierra Leone",
    "Singapore", "Slovakia", "Slovenia", "Solomon Islands", "Somalia",
    "South Africa", "South Sudan", "Spain", "Sri Lanka", "Sudan",
    "Suriname", "Sweden", "Switzerland", "Syria", "Tajikistan",
    "Tanzania", "Thailand", "Togo", "Tonga", "Trinidad and Tobago",
    "Tunisia", "Turkey", "Turkmenistan", "Tuvalu", "Uganda", "Ukraine",
    "United Arab Emirates", "United Kingdom", "United States", "Uruguay",
    "Uzbekistan", "Vanuatu", "Vatican City", "Venezuela", "Vietnam",
    "Yemen", "Zambia", "Zimbabwe",
]

COUNTRY_ALIASES = [
    ("US", "United States"),
    ("USA", "United States"),
    ("United States of America", "United States"),
    ("UK", "United Kingdom"),
    ("BR", "Brazil"),
    ("Brasil", "Brazil"),
    ("RU", "Russia"),
    ("Russian Federation", "Russia"),
]

US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL",
    "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT",
    "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI",
    "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

US_INSTITUTIONS = [
    "University of California", "UC Berkeley", "UC Davis", "UC Irvine", "UC Los Angeles",
    "UC Riverside", "UC San Diego", "UC Santa Barbara", "UC Santa Cruz", "UCLA",
    "Harvard University", "Yale University", "Princeton University",
    "Columbia University", "University of Pennsylvania", "Dartmouth College",
    "Brown University", "Cornell University",
    "Massachusetts Institute of Technology", "MIT", "Stanford University",
    "California Institute of Technology", "Caltech",
    "University of Chicago", "University of Michigan",
    "University of Wisconsin-Madison", "University of Illinois Urbana-Champaign",
    "Johns Hopkins University", "University of Washington", "University of Texas at Austin",
    "Duke University", "Northwestern University", "Emory University",
    "University of Southern California", "USC", "Vanderbilt University",
    "Rice University", "Washington University in St. Louis",
    "Mayo Clinic", "Cleveland Clinic", "MD Anderson Cancer Center",
    "National Institutes of Health", "NIH", "Fred Hutchinson Cancer Research Center",
    "Scripps Research Institute", "Broad Institute", "Howard Hughes Medical Institute",
    "Los Alamos National Laboratory", "Lawrence Berkeley National Laboratory",
    "Argonne National Laboratory", "Oak Ridge National Laboratory",
    "Sandia National Laboratories", "Jet Propulsion Laboratory", "JPL",
]

UNITED_STATES = "United States"
NO_AFFILIATION = "No Affiliation"
UNKNOWN_COUNTRY = "Unknown"
# rows made only of repeated "No Affiliation" (with at most one space between)
NO_AFFILIATION_ONLY = r"(No Affiliation;?\s?)+"

# --- FIXED VALUES: citation cleaning -----------------------------------------

FORBIDDEN_PHRASES = [
    "BACKGROUND:", "METHODS:", "OBJECTIVES:", "RESULTS:", "[Figurre: see text]", "•",
    "<strong>BACKGROUND</strong>",
    "CONCLUSIONS:", "CONCLUSION:", "INTRODUCTION:", "Conclusion:", "[Image: see text]",
    "Introduction:", "Methods:", "Results:", "Conclusions:", "Objectives:",
    "[reaction: see text]",
]

# sections whose markup is removed before the XML parse (all text is kept)
MIXED_SECTIONS = ["ArticleTitle", "AbstractText"]

# --- FIXED VALUES: missing-value sentinels -----------------------------------

NO_DATA = "No Data"
UNKNOWN_PMID = "Unknown PMID"
NO_TITLE = "No Title"
NO_NAME = "No Name"
NO_AUTHORS = "No Authors"
NO_JOURNAL = "No Journal"
NO_DATE = "No Date"
NO_ABSTRACT = "No Abstract"
NOT_AVAILABLE = "N/A"
UNKNOWN_CLASS = "Unknown Class"

# --- FIXED VALUES: chemistry --------------------------------------------------

CHEBI_CLASS_NAMES = [
    ("CHEBI:23432", "Non-steroidal anti-inflammatory drug"),
    ("CHEBI:23431", "Analgesic"),
    ("CHEBI:23638", "Xanthine alkaloid"),
    ("CHEBI:23400", "Anti-inflammatory drug"),
]
ENTITY_TYPE = "Chemical"

# --- FIXED VALUES: topics -----------------------------------------------------

N_TOPICS = 5
TOP_WORDS = 50
SEED = 42
YEAR_RANGE = (2020, 2025)

# English stop words (the 179-word list of the common public NLP toolkit).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it",
    "it's", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "that'll", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've",
    "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# --- FIXED VALUES: k-NN / SMOTE / batching -----------------------------------

MAX_NEIGHBOURS = 5
TEST_SHARE = 0.2
BATCH_SIZE = 50
SAVE_EVERY_BATCHES = 10
MAX_TOKENS = 512
MODEL_NAME = "PubMedBERT"
MITIGATION = "SMOTE"
NO_OVERSAMPLING = "No Oversampling"
