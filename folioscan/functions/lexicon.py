"""Short forms and code-mixed phrases of questions. Longer lexicons are parameters."""

from __future__ import annotations

# --- fixed values: short forms and what they are expanded with ------------------------------------
ABBREVIATIONS = {
    "k05": "timer relay off delay brake module panel",
    "fsds": "fire smoke detection system aspiration",
    "fdss": "fire detection suppression system aerosol water mist",
    "fds": "fire detection system",
    "mcb": "miniature circuit breaker 2A",
    "lhb": "linke hofmann busch coach",
    "icf": "integral coach factory coach",
    "vesda": "very early smoke detection apparatus xtrailis",
    "lhd": "linear heat detection cable",
    "oem": "original equipment manufacturer vendor",
    "asd": "aspiration smoke detector",
    "sbc": "switch board cabinet",
    "poh": "periodic overhaul",
    "ioh": "intermediate overhaul",
    "ss1": "shop schedule 1 maintenance",
    "ss2": "shop schedule 2 maintenance",
    "ss3": "shop schedule 3 maintenance",
    "bta": "bulb thermal actuator activation device firepro",
    "hasp": "heat activated sampling point pantry",
    "tcms": "train control management system display driver",
    "mcp": "master control panel driver desk",
    "ecc": "electrical control cabinet panel",
    "rmpu": "roof mounted AC package unit air conditioning HVAC",
    "crw": "cab rear wall panel",
    "dtc": "driving trailer coach",
    "ndtc": "non driving trailer coach",
    "tc": "trailer coach",
    "mc": "motor coach",
    "acu": "auxiliary converter unit",
    "ltc": "line transformer cubicle",
    "rtc": "real time clock battery",
    "firelink": "hochiki firelink 25 aspiration detection unit",
    "led": "light emitting diode indication panel",
    "pcb": "printed circuit board fire panel",
    "d1": "depot schedule 1 maintenance amrit bharat",
    "d2": "depot schedule 2 maintenance amrit bharat",
    "d3": "depot schedule 3 maintenance amrit bharat",
    "wsp": "wheel slide protection anti-skid braking",
    "wspcu": "wheel slide protection control unit electronic box",
    "mgs2": "knorr bremse MGS2 WSP system control unit",
    "swkp": "faiveley SWKP AS 20 R WSP system",
    "aef": "faiveley AEF G2 WSP electronic unit",
    "dv12": "dump valve DV12 anti-skid solenoid valve",
    "wbi": "wheel brake interface board WBI_1 WBI_2",
    "mmi": "man machine interface display push button WSP",
    "wspmon": "WSP monitoring diagnostic software RS232",
    "kb": "knorr bremse OEM manufacturer",
    "ekl": "escorts kubota limited WSP OEM",
    "ir": "indian railways",
    "rdso": "research designs standards organisation",
    "camtech": "centre advanced maintenance technology IRCAMTECH",
    "esra": "electronic system railway applications KNORR BREMSE",
    "uic": "union internationale chemins fer international railways",
    "jop": "escorts kubota JOP card dump valve output board",
    "jfp": "escorts kubota JFP card speed sensor input board",
    "jio": "escorts kubota JIO card relay output board",
    "gui": "graphical user interface WSP diagnostic application",
    "vcb": "vacuum circuit breaker roof propulsion",
    "vcd": "vigilance control device foot operated switch driver desk",
    "cai": "coach alteration instruction ICF modification",
    "smi": "special maintenance instruction",
    "frp": "fibre reinforced plastic panel",
    "asdis": "air spring deflation indication system",
}

# --- fixed values: code-mixed phrases, rewritten in this order ------------------------------------------
MIXED_PHRASES = (
    (r"\baa\s+raha\s+hai\b", "showing displaying"),
    (r"\bkaam\s+nahi\s+kar\s+raha\b", "not working failure"),
    (r"\bpower\s+nahi\s+aa\s+raha\b", "no power supply failure"),
    (r"\bkya\s+karna\s+chahiye\b", "what to do procedure"),
    (r"\bkya\s+kare\b", "what to do procedure"),
    (r"\bkaise\s+kare\b", "how to procedure steps"),
    (r"\bkaise\s+check\s+kare\b", "how to check test procedure"),
    (r"\bkaise\s+test\s+kare\b", "how to test procedure"),
    (r"\bkaise\s+badle\b", "how to replace procedure"),
)
