"""Tagging rules, makers, drawing and letter patterns, lexicon entries."""

from __future__ import annotations

# --- fixed values: tags in order, with what they need in the text or in the section title ---------
TAG_RULES: tuple[tuple[str, str | None, str | None], ...] = (
    ("procedure", r"(?im)\bstep\s*[-–]?\s*\d|\bprocedure\b|\bfollow(ing)?\s+steps\b|^\s*\d+[.)]\s", r"(?i)procedure|method|how to|steps"),
    ("testing", r"(?i)\btest(ing|ed)?\b|\bcheck(ing)?\b|\bverify\b|\bmeasure\b", r"(?i)test|check"),
    ("troubleshooting", r"(?i)\btroubleshoot|\bfault\b|\bfailure\b|\bdefect|\bremedy\b|\berror\b|not working", r"(?i)troubleshoot|fault|failure"),
    ("fault code", r"(?i)\b(fault|failure|error)\s*codes?\b|\bK\d{2}\b|\bcode\s*\d+\.\d\b", None),
    ("maintenance", r"(?i)\bmaintenance\b|\boverhaul\b|\bservicing\b", r"(?i)maintenance"),
    ("maintenance schedule", r"(?i)\bschedule\b.{0,40}\b(maintenance|examination)|\b(daily|monthly|quarterly|yearly|trip)\s+(schedule|examination|maintenance)\b", None),
    ("installation", r"(?i)\binstall(ation|ed|ing)?\b|\bmounting\b|\bfitment\b", None),
    ("inspection", r"(?i)\binspect(ion|ed)?\b|\bvisual(ly)? check", None),
    ("safety", r"(?i)\bwarning\b|\bcaution\b|\bdanger\b|\bsafety\b|power\s+off|remove\s+fuse", None),
    ("overview", None, r"(?i)introduction|overview|scope|about|preface|foreword"),
    ("general information", None, r"(?i)general"),
    ("technical specs", r"(?i)\bspecificat|\brating\b|\btolerance\b|\bdimensions?\b|\b\d+\s*(V|Vdc|VDC|mA|bar|mm|kg|Hz|ohm)\b", r"(?i)specification|technical data"),
    ("wiring", r"(?i)\bwiring\b|\bcable\b|\bconnector\b|\bterminal\b|\bpin\s*(out|no)\b", None),
    ("power supply", r"(?i)\bpower\s+supply\b|\b110\s*V\b|\bbattery\s+voltage\b|\bMCB\b", None),
    ("spare parts", r"(?i)\bspares?\b|\bpart\s*(no|number)s?\b|\bbill of material|\bBOM\b", None),
    ("alarm levels", r"(?i)\balarm\s+(level|stage|threshold)|\balert\b.{0,60}\baction\b|\bobs/m\b", None),
    ("fire alarm", r"(?i)\bfire\s+alarm\b|\bsmoke\s+detect", None),
    ("fire suppression", r"(?i)\bsuppression\b|\bextinguish|\bnitrogen\b|\bwater\s+mist\b|\baerosol\b", None),
    ("aerosol generator", r"(?i)\baerosol\s+generator", None),
    ("water mist", r"(?i)\bwater\s+mist\b", None),
    ("dump valve", r"(?i)\bdump\s+valve\b|\banti[- ]?skid\s+valve\b", None),
    ("speed sensor", r"(?i)\bspeed\s+sensor\b|\btacho|\bTG\d\b", None),
    ("phonic wheel", r"(?i)\bphonic\s+wheel\b|\bpole\s+wheel\b|\btoothed\s+wheel\b", None),
    ("MMI display", r"(?i)\bMMI\b|\bdisplay\s+(unit|panel|reading)|\bseven\s+segment\b", None),
    ("brake cylinder", r"(?i)\bbrake\s+cylinder\b", None),
    ("brake valve", r"(?i)\bbrake\s+valve\b", None),
    ("CPU", r"(?i)\bCPU\b|\bprocessor\s+card\b", None),
    ("battery", r"(?i)\bbattery\b", None),
    ("air gap", r"(?i)\bair\s*gap\b", None),
    ("diagnostic software", r"(?i)\bdiagnostic\b|\bGUI\b|\bdata\s+download\b|\blaptop\b|\bsoftware\b", None),
    ("data download", r"(?i)\bdata\s+(download|record|log)|\bdownload\s+(the\s+)?data\b", None),
    ("electrical fault", r"(?i)\bshort\s+circuit\b|\bearth\s+fault\b|\belectrical\s+fault\b", None),
    ("relay", r"(?i)\brelay\b", None),
    ("components", r"(?i)\bcomponents?\b.{0,40}\b(list|description)|\bmajor\s+components\b", None),
    ("Vande Bharat", r"(?i)\bvande\s*bharat\b|\bamrit\s*bharat\b", None),
    ("LHB coaches", r"(?i)\bLHB\b", None),
    ("CTRB", r"(?i)\bCTRB\b|cartridge\s+tapered\s+roller", None),
    ("bearing", r"(?i)\bbearing[s]?\b|\baxle\s*box\b", None),
    ("wheel profile", r"(?i)re-?profil|\bwheel\s+(diameter|turning|profile)\b|\btyre\s+defect", None),
    ("shop schedule", r"(?i)\bSS-?[12]\b|\bIOH\b|\bPOH\b|shop\s+schedule|\btrip\s+schedule\b", None),
    ("trainset", r"(?i)\btrainset\b|\brake\b\s+(of|no)|\bDTC\b|\bMC\s*car\b", None),
    ("RMPU", r"(?i)\bRMPU\b|\bCPA\b|roof\s+mounted", None),
    ("VCB", r"(?i)\bVCB\b|vacuum\s+circuit\s+breaker", None),
)
MAX_RULE_TAGS, MAX_TAGS = 10, 12
SYSTEM_TAGS = {"VB": ("VB", "Vande Bharat"), "WSP": ("WSP",)}
MAKERS = {
    "WSP": {"FAIVELEY": r"(?i)\bfaiveley\b|\bwabtec\b|\bAEF\b|\bSWKP\b|\bDV12\b|\bWBI\b", "KNORR BREMSE": r"(?i)\bknorr\b|\bbremse\b|\bMGS2\b|\bESRA\b|\bMB04\b|\bPB03\b|\bEB01\b", "ESCORTS KUBOTA": r"(?i)\bescorts?\b|\bkubota\b|\bEKL\b"},
    "VB": {"SKF": r"(?i)\bSKF\b", "TIMKEN": r"(?i)\btimken\b", "NEI": r"(?i)\bNEI\b|\bnational\s+engineering\b", "KLW": r"(?i)\bKLW\b", "MEDHA": r"(?i)\bmedha\b"},
    "": {
        "HOCHIKI": r"(?i)\bhochiki\b", "XTRAILIS": r"(?i)\bxtralis\b|\bxtrailis\b|\bvesda\b", "WAGNER": r"(?i)\bwagner\b|\btitanus\b", "FOGTECH": r"(?i)\bfogtech\b", "QUARTAS": r"(?i)\bquartas\b",
        "FIREPRO": r"(?i)\bfirepro\b", "PYROGEN": r"(?i)\bpyrogen\b", "STAT-X": r"(?i)\bstat[- ]?x\b", "SANROK": r"(?i)\bsanrok\b",
    },
}

# --- fixed values: letters and drawings ------------------------------------------------------------
LETTER_TYPES, LETTER_MAX_PAGES = ("circular", "instruction_letter", "special_maintenance_instruction", "coach_alteration_instruction"), 12
SUBJECT = r"(?im)^[\s*#>|-]*(?:\*\*)?\s*(?:sub|subject|विषय)\s*(?:\*\*)?\s*[:\-]\s*(?:\*\*)?\s*(.+)"
INDEX_GROUP, INDEX_ITEM = r"(6\.\d+)\.\s+([A-Z][A-Za-z ,&/\-–]+?)(?=\s+\d+\.\s)", r"(\d+)\.\s+(.+?)(?=\s+\d+\.\s|$)"
EQUIPMENT_COLUMN = r"(?i)equipment|sub-?\s*assy|sub-?assembly"

# --- fixed values: words that say nothing about a row ---------------------------------------------
SNIPPET_STOP_WORDS = "the and for with kya hai hona chahiye kitna kitne kaise mein kar ka ke ki me per are what how much should vande bharat".split()
TABLE_LEAD, TABLE_RULE, LINE_END = r"^Table —.*:$", r"^\|?[\s|:-]*$", r"\r\n|[\n\r\x0B\f]"
NUMBER_WITH_UNIT = r"[0-9]+(?:\.[0-9]+)?\s*[A-Za-z%°/]"

# --- fixed values: names of an answer's parts ---------------------------------------------------------
ANSWER_HEADER = r"(?m)^[ \t]*(?:#{1,4}[ \t]*)?\*\*[ \t]*([A-Za-z][A-Za-z \-]{2,30}?)[ \t]*:?[ \t]*\*\*[ \t]*:?"
