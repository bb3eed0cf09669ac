"""Fixed values. Every constant here must equal the published one for results to agree."""

# Job states, the final ones, and the legal moves between states.
STATES = ("queued", "planning", "running", "review", "done", "failed", "cancelled")
TERMINAL = ("done", "failed", "cancelled")
TRANSITIONS = {
    "queued": ("planning", "cancelled", "failed"),
    "planning": ("running", "cancelled", "failed"),
    "running": ("review", "cancelled", "failed"),
    "review": ("running", "done", "cancelled", "failed"),
    "done": (),
    "failed": (),
    "cancelled": (),
}

# Operations, where a region came from, and which operations need a remote model.
OPS = ("remove", "add", "replace", "restyle", "background", "retouch", "upscale")
MASK_SOURCES = ("text", "brush", "point", "auto", "whole")
GENERATIVE_OPS = ("add", "replace", "restyle", "background")
REMOTE_OPS = ("add", "replace")
IMPLEMENTED_OPS = ("remove", "add", "replace", "background", "upscale")

# Reference checks.
DIGEST_PATTERN = "^[0-9a-f]{64}$"
COLOUR_PATTERN = "^#[0-9a-fA-F]{6}$"
MAX_SIDE = 100_000

# Upload limits.
ALLOWED_FORMATS = ("JPEG", "PNG", "WEBP", "AVIF")
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_MEGAPIXELS = 40.0

# Names whose values are hidden, what replaces them, and the error text limit.
SUSPICIOUS_NAMES = ("token", "secret", "password", "key", "authorization", "credential", "cookie")
REDACTED = "[redacted]"
DETAIL_LIMIT = 500

# Characters trimmed from both ends as blank space, and as closing punctuation.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CLOSING_CHARS = ".!?"

# Named colours.
COLOURS = {
    "white": "#ffffff",
    "black": "#000000",
    "red": "#ff0000",
    "green": "#2ea043",
    "blue": "#3366ff",
    "yellow": "#ffd700",
    "orange": "#ff8c00",
    "purple": "#8a2be2",
    "pink": "#ff69b4",
    "grey": "#808080",
    "gray": "#808080",
    "brown": "#8b4513",
    "cyan": "#00ffff",
    "magenta": "#ff00ff",
    "teal": "#008080",
    "navy": "#000080",
    "beige": "#f5f5dc",
}

# Instruction patterns: leading and trailing politeness, subjects too vague to act on, the
# trailing "from the photo", and one pattern per phrasing.
POLITE_START = r"^(?:please|can you|could you|would you|i want you to|i'd like you to)\s+"
POLITE_END = r"[,\s]+(?:please|thanks|thank you|for me)$"
VAGUE = r"^(?:whatever|something|anything|stuff|it|that thing|the thing)\b"
FROM_PICTURE = r"\s+(?:from|in|out of)\s+(?:the\s+)?(?:image|photo|picture)$"
ARTICLE = r"(?:the |a |an |my |this )?"
PUT_WHERE = rf"^(?:put|place|add)\s+(.+?)\s+where\s+{ARTICLE}(.+?)(?:\s+(?:is|was|used to be))?$"
REPLACE_WITH = (
    rf"^(?:replace|swap(?:\s+out)?|change|turn)\s+{ARTICLE}(.+?)\s+(?:with|for|into)\s+(.+)$"
)
BACKGROUND_TO = rf"^(?:change|make|set|turn)\s+{ARTICLE}background\s+(?:to|into)?\s*(.+)$"
REMOVE_IT = rf"^(?:remove|erase|delete|get rid of|take out|clean up)\s+{ARTICLE}(.+)$"
ADD_IT = rf"^(?:add|put|place|insert|give (?:him|her|them|it))\s+{ARTICLE}(.+)$"
UPSCALE = r"^(?:upscale|enlarge|upsample|2x|double the resolution|increase the resolution)\b"
MAKE_BIGGER = (
    r"^make (?:it|this|the image|the photo) (?:bigger|larger|sharper|higher resolution)$"
)
UNCLEAR = (
    "I could not tell which edit that asks for. Try naming the operation and the "
    'subject — for example "remove the car on the left".'
)
UNSUPPORTED = (
    "{op} is not implemented yet. This build can remove, add, replace, change the "
    "background and upscale."
)

# Why an instruction took its route.
NO_RULE = "no rule matched and no model was available"
NOT_HERE = "{op} has no implementation here"
RULE_MATCHED = "matched a rule"

# What a run says against its baseline, and what a user reads of a review.
MISSING_CASE = "in the baseline but not in this run"
NEW_CASE = "not in the baseline; record it if intended"
IMAGE_CHANGED = "the result changed (distance {moved})"
WIDENED = "checked, widened the selection {retries}x, and accepted the result"
STOPPED = "checked; out of budget, returning the best attempt"
CHECKED = "checked the result"

# Leading words ignored when two subjects are compared, dropped once each in this order.
SUBJECT_ARTICLES = ("the ", "a ", "an ", "my ", "this ", "that ")

# Documents: links, credential shapes, required header fields, and size limits.
LINK = r"\[[^\]]*\]\(([^)#][^)]*)\)"
SECRET = (
    r"(AIza[0-9A-Za-z_-]{20,}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
REQUIRED_HEADERS = ("**Read when:**", "**Solves:**", "**Authority:**")
HEADER_CHARS = 600
PATH_MENTION = r"`([A-Za-z0-9_./-]+/[A-Za-z0-9_./-]+\.(?:md|py|ts|tsx|json|yml|toml))`"
COMMAND_MENTION = r"`make ([a-z][a-z0-9-]*)"
OPEN_ITEM = "Status: open"
TRIGGER = "**Trigger:**"
STALE_DAYS = 30

# Scoring.
HIT_IOU = 0.5
EDGE_WEIGHT = 12.0
GROWTH_PENALTY = 25.0
CHANGED_LEVELS = 8
MIN_CHANGED = 0.05
ESCALATE_COST = 25.0
MIN_BOX_SCORE = 0.25
MIN_REGION_IOU = 0.85
OVERLAP = 0.30
AMBIGUITY_MARGIN = 0.15
CANDIDATES = 5
MARGIN_CUTS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
BLANK_MEAN = 16.0
BLANK_SPREAD = 8.0
MIN_PATCHES = 4
PROBE_SPACING = 8
UNCHANGED = "the edit changed almost nothing"
IMPLAUSIBLE = "the fill does not agree with what surrounds it"
STILL_THERE = "what you asked to remove is still in the picture"

# Baseline comparison tolerances.
COST_TOLERANCE = 0.05
IOU_TOLERANCE = 0.05
SIGNATURE_TOLERANCE = 0.02

# Fitting: held-out share of 100, refusal sizes, and what a gain must exceed to be adopted.
HOLDOUT_PERCENT = 50
MIN_OBSERVATIONS = 40
MIN_LABELLED = 20
OUTCOME_GAIN = 0.005
ACCURACY_GAIN = 0.05
DEADLINE_SECONDS = 10.0
MAX_WAIT_SECONDS = 180.0

# Request quota and provider back-off.
RATE_WINDOW_SECONDS = 60
BREAKER_THRESHOLD = 3
BREAKER_COOLDOWN_SECONDS = 60.0
EVENT_TTL_SECONDS = 3600

# Resource report.
SLOT_MB = 1200
