"""Fixed values shared by the operators.

Everything in this module is a value that must stay equal to the original
toolkit's for results to line up (vocabularies, weights, limits, markers).
They are stated plainly, in their natural order, and not derived.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original toolkit)
# ---------------------------------------------------------------------------

# The 21 first-level tag names, in the toolkit's order.
FIRST_LEVEL_TAGS = [
    "Natural Sciences", "Humanities and Social Sciences", "Industrial Manufacturing",
    "Medical and Health", "Agriculture and Forestry", "Energy and Mining",
    "Finance and Real Estate", "Education", "Transportation", "Technology and Internet",
    "Law", "Military", "Travel and Tourism", "Entertainment", "Arts and Culture",
    "Emotional Psychology", "Fashion and Beauty", "Sports", "Home and Lifestyle",
    "Public Administration", "Social Events",
]

# The eight rating criteria (annotation order).
RATING_TASKS = [
    "fact&trivia", "expertise", "educational_value", "scarcity",
    "reasoning_level", "structural_format", "story-like", "subjectivity",
]

# Score columns of a rated record (sampling order); `obscurity` is accepted as
# an input alias of `scarcity`.
SCORE_FIELDS = [
    "educational_value", "expertise", "fact&trivia", "scarcity",
    "reasoning_level", "story-like", "structural_format", "subjectivity",
]
SCORE_ALIASES = {"obscurity": "scarcity"}

# Rating sample weights per criterion (sum 1).
RATING_WEIGHTS = {
    "educational_value": 0.2,
    "expertise": 0.2,
    "fact&trivia": 0.2,
    "scarcity": 0.05,
    "reasoning_level": 0.2,
    "story-like": 0.05,
    "structural_format": 0.05,
    "subjectivity": 0.05,
}

# Valid score range (closed bounds).
SCORE_MIN = 0.0
SCORE_MAX = 100.0

# Tag probability exponents (alpha, beta, gamma) and boost factors
# (first, second, third level).
TAG_EXPONENTS = (0.5, 0.5, 0.5)
BOOST_FACTORS = (2.0, 3.0, 4.0)

# Failed-call sentinel returned by an annotator.
FAILED = "<<FAILED>>"

# Pairwise reply patterns.
CHOICE_PATTERN = r"Choice: ([12])"
WHY_PATTERN = r"Why: ([^\n]*)"

# Code fence that may wrap a JSON reply.
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"

# Markdown sample block marker (a line starting with this opens a block).
MD_SAMPLE_MARKER = "# --------------------------- sample"

# Prompt size classes (token counts): < 3800 small, < 16000 large, else fail.
SMALL_PROMPT_TOKENS = 3800
MAX_PROMPT_TOKENS = 16000

# Bradley-Terry defaults: learning rate, uniform score range.
BT_LEARNING_RATE = 0.05
UNIFORM_TOP = 99.0
UNIFORM_BOTTOM = 1.0

# Pair sampler defaults of the published pipeline.
PAIR_SEED = 20241109
PAIR_COMPARE = 6
