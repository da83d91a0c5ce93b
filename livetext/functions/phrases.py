"""Fixed values of the spoken intent cascade: patterns on normalised text, in the order in which they are tried.

What tells commentary, stories and other instruments from intents is longer and is a parameter (``lexicon``).
"""

#: A small first entry.
SEEDS = [
    r"\b(?:putting|put|got|have|in)\s+(?:a\s+)?(?:little|small)?\s*(?:piece|peace)\s+on\b",
    r"\b(?:putting|put|got|get|have)\s+something\s+on(?:\s+(?:here|there|now))?(?:\s+(?:just\s+)?in\s+case)?\b",
    r"\ba\s+(?:little|small)\s+(?:piece|peace)\s+on\b",
    r"\b(?:piece|peace)\s+on here\b",
    r"\bfeeler on\b",
]
#: A long entry in the first person.
DIRECT_LONG = [
    r"\bi m long\b(?!\s+bias(?:ed)?)",
    r"\bi am long\b(?!\s+bias(?:ed)?)",
    r"\bi m in long\b",
    r"\bi am in long\b",
    r"\bi m in this long\b",
    r"\bi am in this long\b",
    r"\bin long now\b",
    r"\blong now through\b",
    r"\blong here\b",
    r"\bbuying here\b",
    r"\bgetting long\b",
    r"\blonging this\b",
    r"\bi m long again\b",
    r"\bi will get long again\b",
]
#: A short entry in the first person.
DIRECT_SHORT = [
    r"\bi m short\b(?!\s+(?:bias(?:ed)?|because\b))",
    r"\bi am short\b(?!\s+(?:bias(?:ed)?|because\b))",
    r"\bi m in short\b",
    r"\bi am in short\b",
    r"\bi m in this short\b",
    r"\bi am in this short\b",
    r"\bin short there\b",
    r"\bshort on this\b",
    r"\bshort here\b",
    r"\bselling here\b",
    r"\bgetting short\b",
]
#: Fixed values: ``in this long`` that is nobody's entry.
NOT_MY_POSITION = [
    r"\bif you(?: re| are)? in this (?:long|short)\b",
    r"\byou(?: re| are)? in this (?:long|short)\b",
    r"\bstill in this (?:long|short)\b",
    r"\bmight still be in this (?:long|short)\b",
    r"\b(?:some\s+)?of you might still be in this (?:long|short)\b",
    r"\bnot in this (?:long|short)\b",
    r"\bwish i was in this (?:long|short)\b",
    r"\bbeen in this (?:long|short)\b",
    r"\bmight be in this (?:long|short)\b",
    r"\bcould be in this (?:long|short)\b",
]
#: The whole position is closed.
EXITS = [
    r"\bi m out\b(?!\s+(?:here\b|of here\b|there\b))",
    r"\bi am out\b(?!\s+(?:here\b|of here\b|there\b))",
    r"\bout of this now\b",
    r"\bcut that\b",
    r"\btaking that off\b",
    r"\bstopped out\b",
    r"\ball out\b",
    r"\bflatten(?:ing)?(?: this)?\b",
    r"\bgetting flat\b",
    r"\bi m flat\b",
    r"\bi am flat\b",
]
#: An exit under a condition.
CONDITIONAL_EXITS = [
    r"\bif\b[^.]{0,160}\bi m out\b",
    r"\bif\b[^.]{0,160}\bi am out\b",
    r"\bor i m out\b",
    r"\bor i am out\b",
    r"\b(?:doesn t|does not|don t|do not)\b[^.]{0,160}\bi m out\b",
    r"\b(?:doesn t|does not|don t|do not)\b[^.]{0,160}\bi am out\b",
]
#: A part is closed.
TRIMS = [
    r"\bpaying myself\b",
    r"\bpaid myself\b",
    r"\bpay myself\b",
    r"\btrimming\b",
    r"\bpeeling\b",
    r"\btaking (?:some|a little) off\b",
]
#: The same as a command.
TRIM_COMMANDS = [
    r"\bpay yourself(?: some)?\b",
    r"\btake (?:some )?profit\b",
    r"\btake (?:some|a little) off\b",
    r"\btake (?:a )?little profit\b",
]
#: Advice that looks like one.
NOT_TRIM_COMMANDS = [
    r"\byou can (?:pay yourself|take (?:some )?profit|take (?:some|a little) off|take (?:a )?little profit)\b",
]
#: The same as advice.
ADVISED_TRIMS = [
    r"\byou can (?:pay yourself|take (?:some )?profit|take (?:a )?little (?:off|profit))\b",
    r"\btake (?:some )?profit\b",
    r"\bpay yourself\b",
]
#: A long entry as advice.
ADVISED_LONG = [
    r"\byou can (?:go|get) long\b",
    r"\byou can buy here\b",
    r"\byou can (?:get|be) long\b",
]
#: A short entry as advice.
ADVISED_SHORT = [
    r"\byou can (?:go|get) short\b",
    r"\byou can sell here\b",
    r"\byou can (?:get|be) short\b",
]
#: All but a rest is closed.
RUNNERS = [
    r"\brunners on deck\b",
    r"\brunner on deck\b",
    r"\bleave (?:a )?runner\b",
]
#: The stop goes to the entry's price.
BREAKEVENS = [
    r"\bbreak ?even\b",
    r"\brunner break ?even\b",
    r"\bbreak ?even on (?:the )?runner\b",
    r"\bmove stop to be\b",
    r"\bstop to be\b",
    r"\bmoving my stop into the money\b",
    r"\bmove my stop into the money\b",
]
#: The stop moves.
STOP_MOVES = [
    r"\bmove stop\b",
    r"\bmove my stop\b",
    r"\bmoved my stop\b",
    r"\bstart moving my stop\b",
    r"\bmy stop(?: s| is)?\b",
    r"\bstops? moved to\b",
    r"\bstop (?:is|at|to|under|above|over|below)\b",
    r"\bstay heavy\b",
    r"\bif (?:we|they|this)\s+hold\b",
]
#: A price at which all is cut; the group is the price.
CUT_STOPS = [
    r"\b(?:i ll|ill|i will)\s+cut (?:the )?whole position (?:above|below|under|over|at)\s+([\w\.\s]+)",
]
#: More is added now.
ADDS = [
    r"\bgot my add on\b",
    r"\bgot my ad on\b",
    r"\bpopped one back on\b",
    r"\badding here\b",
    r"\badd on there\b",
    r"\badd here\b",
]
#: More may be added.
TENTATIVE_ADDS = [
    r"\bconsider starting to add\b",
    r"\blook for an add\b",
    r"\badd on pops\b",
]
#: A price that must hold.
RISK_PRICES = [
    r"\b(?:long|short)\s+versus\s+([\w\.\s]+)",
    r"\bversus\s+([\w\.\s]+)",
    r"\bstay heavy(?: now)?(?: at| versus)?\s+([\w\.\s]+)",
    r"\bno reclaim(?: of)?\s+([\w\.\s]+)",
    r"\b(?:do not|don t|dont)\s+(?:want to see )?(?:a )?reclaim(?: of)?\s+([\w\.\s]+)",
    r"\bi ll be out on a reclaim(?: of)?\s+([\w\.\s]+)",
    r"\bif (?:we|they)\s+hold\s+([\w\.\s]+)\s+here\b.*\bi m out\b",
    r"\bhold\s+([\w\.\s]+)\s+here\b.*\bi m out\b",
]
#: A stop's price.
STOP_PRICES = [
    r"\bstop (?:is |at |to |under |above |over |below )([\w\.\s]+)",
    r"\bmy stop(?: s| is)?(?: gone in)?(?: basically| around| at| to)?\s+([\w\.\s]+)",
    r"\bstops? moved to\s+([\w\.\s]+)",
    r"\bmove(?:d|ing)? my stop(?: up| down| tighter| nice and tight)?(?: to| at)?\s+([\w\.\s]+)",
    r"\brisking ([\w\.\s]+)",
]
#: A target's price.
TARGET_PRICES = [
    r"\btarget (?:is |at )([\w\.\s]+)",
    r"\btrim at ([\w\.\s]+)",
    r"\bup to ([\w\.\s]+)",
    r"\bdown to ([\w\.\s]+)",
    r"\blooking for (\d{2,5}(?:\.\d{1,2})?s?)\b",
]
#: An entry's price.
ENTRY_PRICES = [
    r"\bat ([\w\.\s]+)",
    r"\bfrom ([\w\.\s]+)",
    r"\bthrough ([\w\.\s]+)",
]
#: A long entry is looked for.
SETUP_LONG = [
    r"\blooking for (?:the |a )?long\b",
    r"\bif we pull back.*long\b",
]
#: A short entry is looked for.
SETUP_SHORT = [
    r"\blooking for (?:the |a )?short\b",
    r"\bif we pop.*short\b",
]
#: A trade may begin.
CANDIDATE_SEEDS = [
    r"\b(?:small|smaller)\s+size\b",
    r"\b(?:piece|peace)\s+on\b",
    r"\b(?:putting|put|got|get)\s+(?:something|a\s+(?:small|little)\s+(?:piece|peace))\s+on\b",
    r"\bget something on\b",
    r"\b(?:one|two|three)\s+lots?\b(?:\s+(?:filled|on|at|here|there|versus))",
    r"\b(?:one|two|three)\s+lot\b(?:\s+(?:filled|on|at|here|there|versus))",
    r"\bversus\b",
    r"\bstay heavy\b",
    r"\b(?:pay(?:ing|ed)?\s+(?:myself|ourselves)|breakeven|flatten)\b",
]
#: A thought on a trade goes on.
CANDIDATE_CONTINUES = [
    r"^(?:and|but|so|then|now|because)\b",
    r"^(?:versus|under|over|through|at|from|into)\b",
    r"^(?:short|long)\s+versus\b",
    r"^(?:risk|stop|stops?)\b",
]
#: Words before a bare side, and words that go with it.
LEAD_IN = r"^(?:(?:all\s+right|alright|okay|ok|right|so|yes|yeah|yep|yup|now|well|again|then|mate|folks|guys|let\s+s\s+see(?:\s+then)?)\s+)*"
BARE_CONTEXT = r"\b(?:versus|at|from|through|under|over|stop|reclaim|risk|risking|break)\b"
#: An entry said again, and words of a new one.
FOLLOW_UPS = [
    r"\bjust a feeler on\b",
    r"\bwe just got piece on\b",
    r"\bwe just got peace on\b",
    r"\bput(?:ting)? (?:something|a little|a small)?\s*(?:piece|peace)\s+on\b",
]
NO_FOLLOW_UPS = ["versus", "stop", "reclaim", "breakeven", "target"]
