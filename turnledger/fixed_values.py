"""Values that published results depend on.

Every constant here is part of the data contract (labels, markers, word lists,
limits): changing one changes ids, groups or rows. They are kept together and
in plain text so they can be checked at a glance.
"""

# --- fixed values: records -------------------------------------------------
RECORD_VERSION = 1
DEFAULT_AGENT = "claude-code"
DEFAULT_PROVIDER = "anthropic"
INGESTED_TYPES = ["assistant", "user"]
SYNTHETIC_MODEL = "<synthetic>"
ID_HEX_CHARS = 32

# Keys of a tool input that may name its target, in order of preference.
TARGET_KEYS = ["file_path", "notebook_path", "path", "pattern", "url", "file"]

# --- fixed values: reports -------------------------------------------------
NO_PROJECT = "(no project)"
NO_MODEL = "(no model)"
UNKNOWN_MODEL = "(unknown model)"
DIMENSIONS = ["project", "model", "agent", "provider", "day", "session", "role"]
DEFAULT_DIMENSIONS = ["project"]
SESSIONS_SHOWN = 20
FILES_SHOWN = 25
HOURS_SHOWN = 5
SPLIT_METHOD = "even-split"
RATE_WINDOW_MS = 3_600_000
TOKENS_PER_PRICE_UNIT = 1e6

# --- fixed values: repeated prompts ---------------------------------------
MIN_OCCURRENCES = 2
GROUP_ID_CHARS = 8
SLASH_COMMAND_MAX_CHARS = 60
PROJECTS_SHOWN = 3
SLUG_WORDS = 4
DEFAULT_SKILL = "repeated-prompt"
FURNITURE_PREFIXES = [
    "<local-command-",
    "<command-name>",
    "<command-message>",
    "<command-args>",
    "<bash-input>",
    "<bash-stdout>",
    "[Request interrupted",
]
STOPWORDS = ["a", "an", "and", "any", "for", "in", "of", "on", "the", "then", "to", "with"]

# --- fixed values: measures a source may or may not record -----------------
KPIS = [
    "tokens",
    "cache",
    "cost",
    "prompts",
    "tools",
    "stop_reason",
    "duration_ms",
    "sidechain",
]

# Code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
