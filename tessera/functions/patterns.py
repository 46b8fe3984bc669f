"""Fixed values of the sentence rules: patterns, word lists, character sets and thresholds.

All patterns are valid for Java's engine; none relies on its Unicode mode. BLANK is the engine's white
space, the same in every operator.
"""

BLANK = r"[ \t\n\r\f]"
BLANKS = " \t\n\r\f"

# Reason codes of the strict rule, in their order.
STRICT_REASONS = (
    "template_markup", "code_markup", "table_markup", "url", "command_path_dominated",
    "heading_fragment", "list_fragment", "very_short_fragment", "low_alphabetic_content",
)

# First words that mark a shell command.
COMMAND_STARTERS = (
    "ansible", "ansible-playbook", "cd", "cp", "curl", "docker", "export", "git", "kubectl", "make", "mkdir",
    "mv", "npm", "pip", "pip3", "python", "python3", "rm", "set", "sudo", "wget", "yarn",
)

# Patterns of the strict rule.
TEMPLATE_MARKS = ("{%", "%}", "{{", "}}")
CODE_TAG = r"(?i)</?(?:code|pre|kbd)(?:\s[^>]*)?>"
WIKI_LINK = r"\[\[[^\]]+\]\]"
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
URL = r"(?i)(?:\b(?:https?|ftp)://|\bwww\.|\bmailto:)[^\s]+"
HEADING = r"^\s{0,3}#{1,6}\s+\S"
LIST_ITEM = r"^\s*(?:[-*+]\s+|\d{1,3}[.)]\s+)"
SHELL_STRIP = "\"'`()[]{}.,:!"
SHELL_LITERALS = ("$", ">", ">>>", "PS>", "&&", "||", "|", ";")
LONG_FLAG_VALUE = r"^--[A-Za-z0-9][A-Za-z0-9_-]*(?:=\S+)?$"
SHORT_FLAG = r"^-[A-Za-z](?:\S*)?$"
ASSIGNMENT_WORD = r"^[A-Za-z_][A-Za-z0-9_]*=\S+$"
WINDOWS_PATH = r"^(?:[A-Za-z]:[\\/]|\\\\)"

# Token pattern and token classes of the features.
TOKEN = r"[A-Za-z]:\\[^\s]+|\.{0,2}/[^\s]+|/[^\s]+|--?[A-Za-z0-9][A-Za-z0-9_-]*(?:=[^\s]+)?|[A-Za-z_][A-Za-z0-9_.-]*[:=][^\s]*|[A-Za-z0-9_./:-]+|[^\p{L}\p{N}_\s]"
TECH_STRIP = "`'\"()[]{}<>,;:"
CORE_STRIP = "`'\"()[]{}<>,;."
FLAG = r"^--[a-zA-Z0-9][a-zA-Z0-9_-]*$"
PATH = r"^(?:[A-Za-z]:\\|\.\.?/|/|[^\s]*[/\\][^\s]*)"
VERSION = r"^v?\d+\.\d+(?:\.\d+)*(?:[a-zA-Z0-9-]+)?$"
SNAKE = r"^[a-z]+(?:_[a-z0-9]+)+$"
CAMEL = r"^(?:[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)$"
DOTTED = r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$"
ACRONYM = r"^[A-Z][A-Z0-9_]{1,}$"
COMMAND = r"(?i)^(?:ansible-playbook|bash|cargo|conda|curl|docker|git|helm|java|kubectl|make|mvn|npm|pip|pip3|python|python3|pytest|ssh|sudo|terraform|uv|wget|yarn|[A-Za-z0-9_-]+\.exe)$"
NUMERIC = r"^(?:\d+|\d+(?:[._:/-]\d+)+[A-Za-z0-9._:/%-]*|\d+[A-Za-z%]+)$"
ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_.-]*=.+$"
YAML_KEY = r"^[A-Za-z_][A-Za-z0-9_.-]*:$"
YAML_SPAN = r"(?<!\S)[A-Za-z_][A-Za-z0-9_.-]*\s*:\s*\S"
FLAG_SPAN = r"(?<!\S)-{1,2}[A-Za-z0-9][A-Za-z0-9_-]*(?:=|\s+)\S"

# White space of the edit gates, beyond ASCII too; and what stands next to a word character or does not.
NONBLANK = r"[^\s\x1C-\x1F\x85\p{Z}]"
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Concrete markers of edited sentences.
MARKER_URL = rf"(?i)https?://{NONBLANK}+"
MARKER_PATH = rf"{_NO_WORD_BEFORE}(?:[A-Za-z]:\\[^\s\x1C-\x1F\x85\p{{Z}},;]+|/[^\s\x1C-\x1F\x85\p{{Z}},;]+)"
MARKER_FLAG = rf"{_NO_WORD_BEFORE}--?[A-Za-z][A-Za-z0-9-]*"
MARKER_NUMBER = rf"{_NO_WORD_BEFORE}\p{{Nd}}+(?:\.\p{{Nd}}+)*{_NO_WORD_AFTER}"
MARKER_SNAKE = rf"{_NO_WORD_BEFORE}[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+{_NO_WORD_AFTER}"
MARKER_CAMEL = rf"{_NO_WORD_BEFORE}(?:[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*){_NO_WORD_AFTER}"
MARKER_CODE = r"`+([^`]+?)`+"
MARKER_TAIL = ".,;:)\"]'"
# A sentence's end inside a candidate: before a capital, or at the end.
SENTENCE_END = r"[.!?][\"')\]]*(?=[\s\p{Z}]+[A-Z]|[\s\p{Z}]*\z)"

# Gate thresholds by edit direction (least and most token ratio, least content recall).
GATE_LIMITS = {"add_specific": (0.65, 2.0, 0.55), "de_specify": (0.4, 1.1, 0.35), "irrelevant_rewrite": (0.75, 1.35, 0.6)}
EDIT_TYPES = ("add_specific", "de_specify", "irrelevant_rewrite")
POLARITY = (
    "no", "not", "never", "none", "neither", "nor", "without", "cannot", "can't", "won't", "don't", "doesn't", "isn't", "aren't",
    "wasn't", "weren't",
)
MODALS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would")
STOP_WORDS = tuple(
    "a an and are as at be been being but by for from had has have he her hers him his i if in into is it its me my no nor not of on or "
    "our ours she so than that the their theirs them they this those to too us was we were what when where which who why will with you your yours".split()
)
META_PREFIXES = ("edited sentence:", "rewrite:", "here is", "sure,")
WORD = r"[\p{L}\p{N}_]+(?:[-./:][\p{L}\p{N}_]+)*"
