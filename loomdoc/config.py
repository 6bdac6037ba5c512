"""Thresholds and patterns that define behaviour. Results depend on each of them."""

from __future__ import annotations

# tables and figures
FILLED_RATIO = 0.3
MIN_CELLS = 6
MIN_LONG_CELLS = 2
LONG_CELL = 5
FIGURE_MERGE_GAP = 60.0
CLUSTER_GAP = 35.0
CLUSTER_MIN = 8
LABEL_REACH = 45.0
LABEL_NUMERIC = 0.7
LABEL_CHARS = 25

# blocks
EDGE_RATIO = 0.08
HEADING_RATIO = 1.2
HEADING_CHARS = 80
SAME_LINE = 0.5
SCRIPT_SIZE = 0.8
SCRIPT_SHIFT = 1.0

# multiples of the page's body size or width
PARAGRAPH_GAP = 0.6
SCRIPT_GAP = 0.18
FIGURE_MARGIN = 3.2
TABLE_HEIGHT = 3.5
TABLE_WIDTH = 0.26
DEFAULT_SIZE = 10.0

# formulas
FORMULA_SHORT = 0.6
FORMULA_TOKENS = 4
FORMULA_DIGITS = 0.4
FORMULA_WORDS = 0.2
FORMULA_EQUATION_WORDS = 0.3

RENDER_SCALE = 2.0
THUMBNAIL_SCALE = 0.25
MAX_UPLOAD_MB = 100
ETA_SECONDS = 15
CONCURRENCY = 6
#: Part of stored results' keys, whose form is fixed; it does not name the prompt in operators/translate.py.
PROMPT_VERSION = "v6"
MODEL_TEXT = "gpt-5.6-luna"
MODEL_IMAGE = "gpt-5.6-terra"
MODEL_SCANNED = "gpt-5.6-terra"

# routing
MIN_PAGE_CHARS = 80
SHORT_BLOCK = 15
MIN_SCORE = 0.5
BUDGET = (4, 3000, 32000)
SCANNED_BUDGET = 16000

# verification
TRUNCATED_RATIO = 0.35
TRUNCATED_FROM = 40
SPEC_PATTERN = r"(?<![A-Za-z0-9])(?:IEC|ASTM|EN|KS|ISO|DIN|VDE|IEEE)\s?[A-Z]{0,2}\s?\d{3,6}(?:[-/]\d+)*(?![A-Za-z0-9])"
PART_PATTERN = r"(?i)(?<![A-Za-z0-9])(?:P/N|Dwg\.?\s?No\.?|Teil-?Nr\.?)\s?[:.]?\s?[A-Z0-9][A-Z0-9-]{3,}(?![A-Za-z0-9])"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
UNITS = r"mm²|mm2|sq\.?\s?mm|mm|cm|m|kV|kA|mA|A|V|W|kW|°C|℃|degC|kg|g|N|Pa|kPa|MPa|Hz"
ENGLISH_NUMBER = r"^-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?$"
FRACTIONS = {
    "½": "0.5", "⅓": "0.333", "⅔": "0.667", "¼": "0.25", "¾": "0.75", "⅕": "0.2", "⅖": "0.4", "⅗": "0.6", "⅘": "0.8",
    "⅙": "0.167", "⅚": "0.833", "⅛": "0.125", "⅜": "0.375", "⅝": "0.625", "⅞": "0.875",
}
HYPHENS = "–—−‐‑‒―"
#: Scripts that a Korean translation cannot hold, as code point ranges.
FOREIGN = ((0x0400, 0x04FF), (0x0530, 0x058F), (0x10A0, 0x10FF), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0E00, 0x0E7F), (0x0900, 0x097F))

# messages
NOTE_FOREIGN = "번역에 예상 밖 문자 포함: "
NOTE_TRUNCATED = "번역이 원문보다 지나치게 짧음 (중간에 잘렸을 가능성)"
NOTE_LINES = "줄바꿈 구조 불일치"
NOTE_NUMBERS = "unsupported number format (non-English decimal/thousand notation)"
NOTE_NO_TABLE = "table not translated"
NOTE_NO_BLOCK = "block missing from LLM response"
NOTE_SCANNED = "scanned page - whole-page markdown, block-level verify not applicable"

# symbol fonts
#: Private-use characters and what their glyphs show.
SYMBOLS = {
    "\uf021": "!", "\uf028": "(", "\uf029": ")", "\uf02a": "*", "\uf02b": "+", "\uf02c": ",", "\uf02d": "−", "\uf02e": ".",
    "\uf02f": "/", "\uf030": "0", "\uf031": "1", "\uf032": "2", "\uf033": "3", "\uf034": "4", "\uf035": "5", "\uf036": "6",
    "\uf037": "7", "\uf038": "8", "\uf039": "9", "\uf03a": ":", "\uf03b": ";", "\uf03c": "<", "\uf03d": "=", "\uf03e": ">",
    "\uf03f": "?", "\uf041": "Α", "\uf042": "Β", "\uf043": "Χ", "\uf044": "Δ", "\uf045": "Ε", "\uf046": "Φ", "\uf047": "Γ",
    "\uf048": "Η", "\uf049": "Ι", "\uf04a": "ϑ", "\uf04b": "Κ", "\uf04c": "Λ", "\uf04d": "Μ", "\uf04e": "Ν", "\uf04f": "Ο",
    "\uf050": "Π", "\uf051": "Θ", "\uf052": "Ρ", "\uf053": "Σ", "\uf054": "Τ", "\uf055": "Υ", "\uf057": "Ω", "\uf058": "Ξ",
    "\uf059": "Ψ", "\uf05a": "Ζ", "\uf05b": "[", "\uf05d": "]", "\uf061": "α", "\uf062": "β", "\uf063": "χ", "\uf064": "δ",
    "\uf065": "ε", "\uf066": "φ", "\uf067": "γ", "\uf068": "η", "\uf069": "ι", "\uf06a": "φ", "\uf06b": "κ", "\uf06c": "λ",
    "\uf06d": "μ", "\uf06e": "ν", "\uf06f": "ο", "\uf070": "π", "\uf071": "θ", "\uf072": "ρ", "\uf073": "σ", "\uf074": "τ",
    "\uf075": "υ", "\uf077": "ω", "\uf078": "ξ", "\uf079": "ψ", "\uf07a": "ζ", "\uf07b": "{", "\uf07d": "}", "\uf0a3": "≤",
    "\uf0a5": "∞", "\uf0ae": "→", "\uf0b0": "°", "\uf0b1": "±", "\uf0b3": "≥", "\uf0b6": "∂", "\uf0b7": "•", "\uf0b9": "≠",
    "\uf0bb": "≈", "\uf0d1": "∇", "\uf0d6": "√", "\uf0d7": "×", "\uf0e5": "∑", "\uf0f2": "∫",
}
