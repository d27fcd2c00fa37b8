"""Fixed values that results depend on."""

# The note palette in order, and the German names of its colours.
PALETTE = (
    ("f7dc68", "yellow", "Gelb"),
    ("f2a3b4", "pink", "Rosa"),
    ("a9d9ee", "blue", "Blau"),
    ("b9dfa5", "green", "Grün"),
    ("cdb8ee", "purple", "Lila"),
    ("f2b46d", "orange", "Orange"),
    ("f6f0df", "cream", "Creme/Weiß"),
    ("d6d8db", "gray", "Grau"),
)
# Words that are known in any language.
PROTECTED_TERMS = (
    "ai", "api", "app", "backend", "brainstorming", "chatgpt", "codex", "figma", "frontend",
    "html", "kanban", "kpi", "miro", "mockup", "ocr", "pdf", "postit", "postits", "ppt",
    "seo", "slack", "ui", "url", "ux",
)
# Words of two or three letters that are no fragments.
SHORT_LABELS = ("ai", "api", "hr", "it", "qa", "ui", "ux")
# Cost of reading one character for another, in either direction.
CONFUSION_COSTS = {
    "0o": 0.16, "qo": 0.22, "1i": 0.18, "1l": 0.18, "il": 0.22, "5s": 0.24,
    "8b": 0.26, "db": 0.34, "uv": 0.42, "eo": 0.52, "al": 0.54,
}
# Cost of reading two characters as one, in either direction.
MERGE_COSTS = {("rn", "m"): 0.34, ("cl", "d"): 0.38, ("vv", "w"): 0.40}
# Letters that a digit may stand for.
DIGIT_LETTERS = {"0": "o", "1": "il", "5": "s", "8": "b"}
# Readers in order of preference.
READERS = ("paddle", "dehtr", "tesseract")
