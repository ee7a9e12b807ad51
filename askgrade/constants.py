"""Marker tokens, word lists, thresholds and column names.

Everything in this file has to equal published values exactly, because results
depend on them; nothing here is logic.
"""

# --- fixed values: marker tokens (the surrounding spaces are part of the token)
CODEBLOCK = " has_codeblock "
LINKS = " has_links "
HEXADECIMAL = " has_hexadecimal "
NUMERIC = " has_numeric "
ATTACHED_TAG = " has_attached_tag "
EXTERNAL_TAG = " has_external_tag "
HOMEWORK = " has_homework "
ASSIGNMENT = " has_assignment "
VERSION_NUMBER = " has_version_number "

# --- fixed values: words that hint at homework, in published order
HOMEWORK_WORDS = [
    "homework",
    "education",
    "lecture",
    "teach",
    "teacher",
    "supervisor",
    "professor",
    "schoolteacher",
    "school",
    "exercise",
    "schoolwork",
    "textbook",
    "exam",
    "college",
]
ASSIGNMENT_WORDS = ["assignment"]

# --- fixed values: class thresholds on Score (both strict) and class labels
BAD_BELOW = -5
GOOD_ABOVE = 50
BAD = -1
GOOD = 1

# --- fixed values: the classifier's document-frequency bounds and CV set-up
MIN_DF = 0.01
MAX_DF = 0.95
N_FOLDS = 5
TEST_SIZE = 0.2

# --- fixed values: search grids
SVC_C = [1, 10, 100, 1000]
SVC_GAMMA = [0.001, 0.0001]
GRID_MIN_DF = [0.01, 0.025, 0.05, 0.075, 0.1]
GRID_MAX_DF = [0.25, 0.5, 0.75, 0.95, 1.0]
COMPARISON_MAX_DF = [0.25, 0.5, 0.75, 1.0]
GRID_USE_IDF = [True, False]
GRID_NORM = ["l1", "l2"]
SGD_ALPHA = [0.00001, 0.000001]
SGD_PENALTY = ["l1", "l2", "elasticnet"]
SGD_N_ITER = [10, 50, 75, 100]
SGD_LOSS = ["hinge", "log", "modified_huber", "squared_hinge", "perceptron"]
LINEAR_SVC_LOSS = ["hinge", "squared_hinge"]
LINEAR_SVC_MAX_ITER = [100, 250, 500, 750, 1000, 1500, 2000]

# --- fixed values: the twelve projected question columns
QUESTION_COLUMNS = [
    "Id",
    "Score",
    "ViewCount",
    "Body",
    "Title",
    "AnswerCount",
    "CommentCount",
    "AcceptedAnswerId",
    "OwnerUserId",
    "CreationDate",
    "Tags",
    "ClosedDate",
]

# Character classes that equal Python's \w and str.isspace() without a Unicode flag.
WORD_CHARS = r"\p{L}\p{N}_"
WHITESPACE_CHARS = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"

# The English stop words that ship with Spark ML, in their order.
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
    hers herself it its itself they them their theirs themselves what which who whom this that these
    those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where
    why how all any both each few more most other some such no nor not only own same so than too very s
    t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
    weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
    couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
    would
""".split()
