"""Lists, patterns and weights that results depend on, kept as they must be."""

from __future__ import annotations

import re

# --- fixed values: retrieval -----------------------------------------------------------------
TOP_K_SEMANTIC, TOP_K_FINAL, TOP_K_ENUMERATE = 60, 8, 20
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.55, 0.45
PER_DOC_CAP, SUPERSEDED_PENALTY, AMENDMENT_MIN_OVERLAP = 3, 0.85, 0.5
CONTEXT_CHUNK_CHARS = 2500

# --- fixed values: chunking ------------------------------------------------------------------
TARGET_LOW, TARGET_HIGH, HARD_MAX, OVERLAP_CHARS = 900, 1200, 1600, 150
TABLE_MAX, MIN_SECTION_CHARS, MAX_HEADER_CHARS, LEAST_PIECE = 2500, 250, 600, 40

# --- fixed values: question intents ------------------------------------------------------------
ENUMERATION = (
    r"(?i)\blist\s+(?:all|the|out|down)\b|\ball\s+(?:the\s+)?activit|\bwhat\s+activit"
    r"|\bwhich\s+activit|\bwhat\s+items\b|\bwhich\s+items\b|\bwhat\s+all\b"
    r"|\bcomplete\s+list\b|\bfull\s+list\b|\benumerate\b|\bactivities\s+covered\b"
    r"|\bactivities\s+(?:to\s+be\s+)?(?:covered|performed|carried)\b"
    r"|\bmust\s+change\s+items\b|\bkya\s+kya\b|\bsaari\b|\bsabhi\b"
)
COUNTING = (
    r"(?i)\bhow\s+many\b|\bhow\s+much\b|\bnumber\s+of\b|\btotal\s+(?:number|count)\b"
    r"|\bcount\s+of\b|\bkitne\b|\bkitni\b|\blist\s+(?:all|the)\b|\bwhich\s+all\b"
)
GENERIC_DOCUMENT = r"(?i)\bdocuments?\b|\breferences?\b|\bpdfs?\b|\binstructions?\b"
DOC_TYPE_PATTERNS = {
    "coach_alteration_instruction": r"(?i)\bcai'?s?\b|\bcoach\s+alteration\b",
    "special_maintenance_instruction": r"(?i)\bsmi'?s?\b|\bspecial\s+maintenance\s+instruction",
    "instruction_letter": r"(?i)\binstruction\s+letters?\b|\brdso\s+letters?\b",
    "circular": r"(?i)\bcirculars?\b",
    "maintenance_manual": r"(?i)\bmanuals?\b",
    "report": r"(?i)\breports?\b",
    "oem_manual": r"(?i)\boem\s+manuals?\b",
}
DOC_TYPE_LABELS = {
    "instruction_letter": "Instruction Letter",
    "coach_alteration_instruction": "Coach Alteration Instruction",
    "special_maintenance_instruction": "Special Maintenance Instruction",
    "maintenance_instruction": "Maintenance Instruction",
    "circular": "Circular",
    "maintenance_manual": "Maintenance Manual",
    "oem_manual": "OEM Manual",
    "oem_presentation": "OEM Presentation",
    "report": "Report",
    "correction_slip": "Correction Slip",
}
QUERY_OEMS = {
    "FAIVELEY": r"\bfaiveley\b|\bwabtec\b|\baef\b|\bswkp\b|\bdv12\b|\bwbi\b",
    "KNORR BREMSE": r"\bknorr\b|\bbremse\b|\bmgs2\b|\besra\b|\bmb04\b|\bpb03\b|\beb01\b",
    "ESCORTS KUBOTA": r"\bescorts?\b|\bkubota\b|\bekl\b|\bjop\b|\bjfp\b|\bjio\b|\bgui\b",
}
QUERY_COACHES = {
    "LHB": r"\blhb\b",
    "ICF": r"\bicf\b",
    "Vande Bharat": r"\bvande\s*bharat\b|\bt-?18\b",
    "Amrit Bharat": r"\bamrit\s*bharat\b",
}
FIRE_SIGNALS = (
    r"\bfsds\b|\bfdss\b|\bfdas\b|\bfire\b|\bsmoke\b|\baerosol\b|\bsuppression\b|\bextinguish|\bdetector"
    r"|\bdetection\b|\bflame\b|\blhd\b|\blinear\s+heat\b|\bhooter\b"
)
SLIDE_SIGNALS = (
    r"\bwsp\b|\bwheel\s+slide\b|\bwheel\s+slip\b|\banti[- ]?skid\b|\bslide\s+protection\b|\bdump\s+valve\b|\bskid\b"
    r"|\bspeed\s+sensor\b|\bphonic\b|\bfaiveley\b|\bwabtec\b|\bknorr\b|\bbremse\b|\bescorts?\b|\bkubota\b"
)
PROCEDURAL_SIGNALS = (
    "how to", "procedure", "steps", "test", "testing", "check",
    "troubleshoot", "troubleshooting", "fix", "repair", "replace",
    "diagnose", "fault", "error", "schedule", "maintenance",
    "install", "installation", "activate", "activation", "reset",
    "clean", "cleaning", "download", "service", "inspect",
    "post fire", "recommission", "ventilate",
    "kaise", "karna", "tarika",
    "overhaul", "self test", "self-test", "manual test", "system test",
    "air gap", "gap setting", "shim", "choke setting",
    "dump valve", "speed sensor", "phonic wheel",
    "error code", "fault code", "defect code", "display code",
    "wsp test", "brake test", "s1 button", "s2 button", "s3 button",
    "checking procedure", "spare parts",
    "cycle check", "en-route", "enroute",
)
SHORT_ANSWER_WORDS = 4
CLARIFY_MARKER = "please tell me the"

# --- fixed values: words that a transcript's confidence looks at ----------------------------------
FILLER_WORDS = (
    "the", "a", "an", "is", "was", "that", "this", "of", "it", "in", "to", "and", "for", "with", "on", "at", "but", "or", "not", "do", "did", "will", "can",
    "best", "part", "good", "bad", "know", "think", "say", "said", "don't", "i'm", "what", "how",
)
TRANSCRIPT_MARKERS = (
    "kaise", "kare", "kya", "hai", "nahi", "batao", "tarika", "raha", "rahi", "karna", "hota", "karo", "mein", "ka", "ki", "ke", "chahiye", "kab", "kahan",
)

# --- fixed values: languages of a question -------------------------------------------------------
STRONG_MARKERS = ("kaise", "kya", "hota", "karna", "batao", "tarika", "kaam", "karta", "samjhao", "bataye")
WEAK_MARKERS = (
    "kaise", "kare", "kya", "hai", "nahi", "batao", "tarika", "raha", "rahi", "karna", "hota", "karo", "ka", "ki", "ke",
    "kab", "kahan", "kitna", "wala", "wali", "lagao", "dekho", "kaam", "kam", "karta", "karti", "karte", "hain", "tha",
    "thi", "ho", "bhi", "par", "se", "mein", "aur", "yeh", "woh", "isko", "uska", "hamara", "bataye", "samjhao",
    "theek", "band", "chalu", "check", "kholo", "lagana",
)

# --- fixed values: corpus quality --------------------------------------------------------------
QUALITY_STOP_WORDS = (
    "the of to and a in is for be shall with on as by or that this are at from will not it its an been being which each "
    "any all per all such system fire coach railway detection supply power supplier railways board office letter dated "
    "ref sub no design maintenance"
).split()
STOP_WORD_MIN, MIN_TOKENS, TABLE_BAR_SHARE = 0.08, 12, 0.03
RUNNING_SHARE, RUNNING_LEAST, RUNNING_KEY_CHARS = 0.6, 3, (3, 120)
SHRINK_TOTAL, SHRINK_DOCUMENT, SHRINK_LEAST_CHUNKS = 0.10, 0.50, 4
LABEL_MAX, SHATTER_MAX, SHATTER_MIN_HITS, SHATTER_MIN_BOUNDARIES = 40, 0.12, 3, 4

# --- fixed values: guards ----------------------------------------------------------------------
VALUE_PLACEHOLDER = "[value not confirmed in source — refer to manual/supervisor]"
CLAIM_PLACEHOLDER = "[completeness not verified against the full document — refer to the manual/supervisor]"
UNITS = (
    "vdc", "vac", "kv", "mv", "va", "v", "ma", "ka", "a", "kw", "w", "mpa", "kpa", "psi", "bar", "knm", "nm", "n",
    "khz", "mhz", "hz", "kohm", "mohm", "ohm", "Ω", "mm²", "sqmm", "µm", "um", "mm", "cm", "km", "m", "kg", "g", "t",
    "°c", "℃", "degc", "ms", "µs", "sec", "s", "min", "hr", "h", "rpm", "%", "lpm",
)
_NUMBER = r"\d+(?:[.,]\d+)?"
VALUE = (
    rf"(?P<val>(?:±\s*)?{_NUMBER}(?:\s*(?:±|\+/-|to|–|—|~|-)\s*{_NUMBER})?\s*"
    rf"(?:{'|'.join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))}))(?![A-Za-z0-9µ])"
)
VALUE_RANGE = r"([\d.]+)-([\d.]+)([a-zµ°℃%²Ω]+)"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
FAULT_CODE = r"(?:fault|error|failure|trip|alarm|display)\s*code[s]?\s*(?:no\.?|number|[:#\-])?\s*(?P<code>[A-Za-z]?\d{1,4}(?:\.\d+)?)"
PART_NUMBER = r"\b(?=[A-Za-z0-9][A-Za-z0-9/\-]{3,})(?=[A-Za-z0-9/\-]*[A-Za-z])(?=[A-Za-z0-9/\-]*\d)[A-Za-z0-9]+(?:[/\-][A-Za-z0-9]+)*\b"
SCHEDULE_NAME = r"^(?:ss[-\s]?(?:1|2|3|i{1,3})|poh|ioh|aoh|toh|d[-\s]?[123](?:[-\s]?d?[123])?|\d{1,2}[-\s]?m(?:onthly)?|ss\d?/\d+m?)$"
REFERENCE_TAIL = r"\*\*\s*reference\s*:?\s*\*\*|(?:^|\n)\s*reference\s*:"
COUNT_NOUNS = {
    "coach_alteration_instruction": r"cai'?s?|coach\s+alteration\s+instructions?",
    "special_maintenance_instruction": r"smi'?s?|special\s+maintenance\s+instructions?",
    "instruction_letter": r"instruction\s+letters?|rdso\s+letters?",
    "circular": r"circulars?",
    "maintenance_manual": r"manuals?",
    "report": r"reports?",
    "oem_manual": r"oem\s+manuals?",
    None: r"documents?|references?",
}
SCOPED_CLAIM = (
    r"\b(?:in|from|within)\s+(?:the\s+)?(?:provided\s+|retrieved\s+|given\s+|above\s+)?"
    r"(?:context|extract|excerpt|passage|sources?|documents?\s+provided|knowledge\s+base)\b"
    r"|\bnot\s+in\s+context\b|\bmay\s+exist\b|\bmay\s+be\s+(?:present|available)\b"
    r"|\bavailable\s+here\b|\bthis\s+knowledge\s+base\b|\bfull\s+document\b"
    r"|\bcomplete\s+matrix\b|\bcovered\s*:"
)
ABSOLUTE_CLAIM = (
    r"\bthere\s+(?:is|are)\s+no\b"
    r"|\bno\s+\w+(?:\s+\w+){0,3}\s+(?:exists?|is\s+specified|is\s+mentioned|is\s+defined|is\s+required|is\s+prescribed)\b"
    r"|\b(?:is|are)\s+not\s+specified\s+anywhere\b"
    r"|\bthese\s+are\s+all\s+(?:the|of)\b"
    r"|\bthat\s+is\s+the\s+(?:complete|full|entire)\s+list\b"
    r"|\bthe\s+(?:complete|full|entire)\s+list\s+(?:is|are)\b"
    r"|\bno\s+such\s+(?:procedure|requirement|instruction|value|activity)\b"
)

# --- fixed values: provider cooldowns, seconds ---------------------------------------------------
COOLDOWN_DAILY, COOLDOWN_MINUTE, COOLDOWN_BROKEN = 3600, 90, 3600
DAILY_MARKERS = ("perday", "tpd", "rpd", "daily")

# --- fixed values: inline mathematics ----------------------------------------------------------------
GREEK = {
    "mu": "µ", "Omega": "Ω", "omega": "ω", "deg": "°", "circ": "°", "times": "×", "cdot": "·", "pm": "±",
    "approx": "≈", "leq": "≤", "geq": "≥", "le": "≤", "ge": "≥",
}
MATH_INLINE = r"\$\$?(?P<inner>[^$\n]{1,120}?)\$\$?"
MATH_MARK = r"\\(?:text|mathrm|mathit|mathbf|mathsf)\s*\{(?=[^}]*\})|\\(?P<name>[a-zA-Z]+)|\\[,;:!> ]|[\^_{}]"
MATH_SIGNS = "µΩ°×·±"

# --- fixed values: page numbers as they are printed ------------------------------------------------------
PAGE_FOOTER = r"(?i)^\s*(page\s+)?\d+\s*(of|/)\s*\d+\s*$"
PRINTED_PAGE = r"(?i)^\s*page\s+(\d+)(?:\s+of\s+\d+)?\s*$"


# --- fixed values: words that name no area; letter numbers, dates and types of registered documents -------
AREA_STOP_WORDS = ("and", "the", "of", "for", "amp", "protection", "general", "information")
LETTERHEAD_CHARS = 1200
LETTERHEAD_DATE = r"(?i)\bDate[d]?\s*[:\-]\s*(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})"
LETTER_NUMBERS = (
    r"(?i)\b(MC[/\-][A-Za-z0-9/\-\.]{2,30})",
    r"(?i)\b(VB\s*/\s*SMI\s*/\s*[A-Z]\s*/\s*\d+)",
    r"(?i)\b(IRCAMTECH/[A-Za-z0-9/\-\.&]{3,40})",
    r"(?i)\bNo\.?\s*[:\-]?\s*(I\s*C\s*F/[A-Za-z0-9/\-\.'\s]{4,40})",
    r"\bNo\.?\s*[:\-]?\s*([A-Z][A-Za-z0-9]*(?:[/\-][A-Za-z0-9\.]+){2,})",
)
FILENAME_SMI, FILENAME_CAI = r"(?i)VB[_\s]*SMI[_\s]*([A-Z])[_\s]*(\d{1,2})", r"(?i)\bCAI\s*([AB])[\s\-]*(\d{4})[\-/](\d{1,2})"
DOC_TYPES = (
    ("coach_alteration_instruction", r"\bCAI\b"),
    ("special_maintenance_instruction", r"\bSMI\b|VB[_/]SMI"),
    ("report", r"\breport\b|guidelines?"),
)

# --- fixed values: dates in file names (pattern, groups of year, month and day) ---------------------------------
FILENAME_DATES = (
    (r"(20\d{2})[_\-](\d{2})[_\-](\d{2})", 1, 2, 3),
    (r"\b(\d{2})[_\-](\d{2})[_\-](20\d{2})", 3, 2, 1),
    (r"(\d{2})\.(\d{2})\.(20\d{2})", 3, 2, 1),
    (r"\b(\d{2})(\d{2})(20\d{2})\b", 3, 2, 1),
)
FILENAME_YEAR = r"\b(20\d{2})\b"

# --- fixed values: parts of an answer and marks that a voice leaves out, in this order -------------------------
DIRECT_ANSWER, STEPS = "**Direct Answer:**", "**Step-by-step Action:**"
DIRECT_PART = r"(?s)\*\*Direct Answer:\*\*\s*(.*?)(?:\*\*Step|$)"
STEPS_PART = r"(?s)\*\*Step-by-step Action:\*\*\s*(.*?)(?:\*\*Safety|\*\*Reference|---|\n📚|$)"
SPOKEN_PASSES = (
    (r"\*\*([^*]+)\*\*", "$1"), (r"#{1,3}\s*", ""), (r"\[Source.*?\]", ""), (r"(?s)---.*$", ""), (r"(?s)📚.*$", ""),
    (r"\n\s*\d+\.\s*", ". "), (r"\n\s*[-→✔]\s*", ". "), (r"[*_`~]", ""),
)
