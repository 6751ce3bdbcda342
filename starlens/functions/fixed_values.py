"""Rule lists, word lists and constants the results depend on."""

# Theme rules in priority order; a review takes the first theme one of whose
# phrases occurs anywhere in its lower-cased text (substring, not word, match).
THEME_RULES = [
    ("Pricing/Subscription", [
        "subscription", "pay", "paid", "premium", "expensive", "cost", "charge",
        "billing", "refund", "paywall", "upgrade", "pricing",
    ]),
    ("Bugs/Performance", [
        "bug", "crash", "glitch", "freeze", "broken", "performance", "lag",
        "loading failed", "not working", "keeps crashing",
    ]),
    ("Accuracy/Logic Issues", [
        "wrong answer", "incorrect", "inaccurate", "hallucin", "mislead",
        "unreliable", "wrong information", "false information", "logic error",
        "accuracy",
    ]),
]
DEFAULT_THEME = "General"
THEMES = [theme for theme, _ in THEME_RULES] + [DEFAULT_THEME]

# Words left out of the keyword tables.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
    "my", "your", "his", "its", "our", "their", "this", "that", "these", "those",
    "what", "which", "who", "how", "when", "where", "why", "not", "no", "so", "if",
    "as", "by", "from", "up", "about", "than", "then", "just", "more", "very", "too",
    "app", "use", "using", "used", "also", "get", "got", "one", "like", "would", "really",
    "much", "even", "still", "good", "great", "bad", "cant", "dont", "ive", "its", "im",
    "ai", "know", "make", "way", "time", "every", "thing", "things", "well", "back",
    "see", "want", "now", "new", "out", "all", "some", "been", "after", "into", "over",
    "only", "other", "such", "because", "while", "however", "although", "many", "most",
]

# Opinion words by polarity. An own list; scores are not those of any library.
POLARITY_WORDS = {
    1.0: ["amazing", "awesome", "best", "brilliant", "excellent", "fantastic",
          "flawless", "incredible", "outstanding", "perfect", "superb", "wonderful"],
    0.8: ["beautiful", "great", "impressive", "loved", "loving", "marvelous",
          "phenomenal", "terrific"],
    0.7: ["good", "happy", "impressed", "intuitive", "powerful", "satisfied"],
    0.6: ["enjoy", "enjoyable", "glad", "love", "loves", "nice", "recommend"],
    0.5: ["accurate", "clean", "convenient", "easy", "efficient", "enjoyed", "fast",
          "friendly", "fun", "helpful", "helps", "reliable", "smart", "smooth"],
    0.4: ["better", "clear", "cool", "correct", "interesting", "quick", "thanks",
          "useful", "worth"],
    0.3: ["fine", "improved", "interested", "like", "likes", "simple", "works"],
    0.2: ["decent", "fair", "free", "okay", "safe"],
    -0.2: ["average", "basic", "limited", "missing", "slow", "strange", "weird"],
    -0.3: ["boring", "confusing", "difficult", "expensive", "hard", "lacking",
           "mediocre", "outdated", "unclear"],
    -0.4: ["annoyed", "broken", "buggy", "crashes", "crashing", "disappointed",
           "error", "errors", "failed", "fails", "incorrect", "misleading", "problem"],
    -0.5: ["angry", "annoying", "disappointing", "false", "frustrated", "frustrating",
           "inaccurate", "poor", "sad", "unreliable", "wrong"],
    -0.7: ["bad", "fake", "hate", "hated", "nasty", "scam", "stupid", "ugly",
           "unusable", "useless", "waste"],
    -0.8: ["disgusting", "garbage", "pathetic", "rubbish", "trash"],
    -1.0: ["atrocious", "awful", "disgrace", "dreadful", "horrible", "terrible", "worst"],
}
# Factors taken from the word just before an opinion word.
INTENSIFIERS = {
    1.5: ["absolutely", "extremely", "incredibly", "insanely", "totally"],
    1.3: ["really", "so", "super", "too", "truly", "very"],
    0.7: ["fairly", "quite", "rather", "somewhat"],
    0.5: ["barely", "hardly", "slightly"],
}
# "t" is what the tokeniser leaves of "n't".
NEGATIONS = ["no", "not", "never", "without", "t"]
NEGATION_FACTOR = -0.5

PRODUCTS = {
    "ChatGPT": "com.openai.chatgpt",
    "Claude": "com.anthropic.claude",
    "Google_Gemini": "com.google.android.apps.bard",
    "Microsoft_Copilot": "com.microsoft.copilot",
    "Perplexity": "ai.perplexity.app.android",
}
PRODUCT_COLOURS = {
    "ChatGPT": "#10a37f",
    "Claude": "#d97757",
    "Google_Gemini": "#4285f4",
    "Microsoft_Copilot": "#0078d4",
    "Perplexity": "#22d3ee",
}
DEFAULT_COLOUR = "#666"

KEYWORDS_PER_SIDE = 30
MERGED_CLOUD_SIZE = 40
SAMPLES_PER_SIDE = 5
SAMPLE_TEXT_CHARS = 200
MOST_NEGATIVE = 50
VIRAL_MIN = 1000
VIRAL_HEAD = 10
WINSOR_QUANTILE = 0.99
ZOOM_MAX = 100
POSITIVE_MIN_STAR = 4
NEGATIVE_MAX_STAR = 2
SENTIMENT_BAND = 0.4
TFIDF_FEATURES = 5000
FOREST_TREES = 100
# the deepest tree Spark grows
FOREST_DEPTH = 30
LOGREG_ITERATIONS = 1000
TEST_SHARE_DIVISOR = 5
SEED = 42

# Spark's English stop words, which the classifiers leave out.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these",
    "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll",
    "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's",
    "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought",
    "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]
