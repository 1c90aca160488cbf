"""Directness levels of utterances by fixed wording rules, versions auto-v1 and auto-v2.

A version is a table of rules in order; the first that fires decides. All patterns run in the JVM; only slot mentions, which
decide between a detail and none, come from ``mentions.extract``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import mentions

LEVELS = ("L0", "L1", "L2", "L3", "INF", "NR")

#: The wording rules. Texts are in lower case with straight apostrophes and single spaces.
OPENER = r"(?:(?:yes|yeah|yea|yep|sure|ok|okay|great|perfect|thanks|thank you|no|nope|well|so|and|also|then|actually|alright|awesome|excellent|good|fine|cool|oh|hi|hello|hmm|um|umm|now|first|next|lastly|finally)[\s,.!]+)*"
CLAUSE = r"(?:^|[.!?;:]\s*|,\s*)" + OPENER
SENTENCE = r"(?:^|[.!?;:]\s*)" + OPENER
VERBS = "book|find|give|tell|send|get|show|reserve|make|help|check|search|look|provide|recommend|suggest|list|pick|choose|let|call|arrange|confirm|email|text|schedule|locate|please"
WH = r"(?:what|whats|where|when|which|who|whom|whose|how(?!\s+about))"
YES_NO = r"(?:(?:is|are|was|were|does|do|did|has|have|had)\s+(?:there|it|that|this|they|the|any|its|their|these|those)|(?:do|does|did)\s+(?:you|they)\s+(?:have|know|offer|serve|happen|provide))"
NUMBER = r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
WANT = r"\b(?:i|we)(?:'ll|'d)?\s+(?:(?:will|would|do|really|also|just|still|definitely|actually|only|now|absolutely)\s+)*(?:need|want|require)s?\b"
LIKE = r"\b(?:(?:i|we)(?:'d|\s+would)|id)\s+(?:also\s+|really\s+|just\s+)?(?:like|love|prefer)\b"
LOOKING = r"\b(?:i|we)\s*(?:'m|am|are|'re)\s+(?:also\s+|now\s+|just\s+)?(?:looking|searching)\s+(?:for|to)\b"
COMMAND = CLAUSE + rf"(?:{VERBS})\b"
WH_QUESTION = SENTENCE + WH + r"\b(?!\s+(?:i|we)\b)"
YES_NO_QUESTION = SENTENCE + YES_NO + r"\b[^.!]*\?"
L1 = (
    ("you_formula", r"\b(?:can|could|would|will|wo?n't|cant|couldn't|wouldn't)\s+(?:you|u|ya)\b"),
    ("i_formula", r"\b(?:can|could|may|might)\s+(?:i|we)\b"),
    ("would_you_mind", r"\b(?:would|do)\s+you\s+mind\b"),
    ("possible", r"\b(?:is\s+it|would\s+it\s+be|will\s+it\s+be|it\s+is|it's)\s+possible\b"),
    ("able", r"\b(?:are|would|will)\s+you\s+(?:be\s+)?able\b"),
    ("if_you_could", r"\b(?:if|whether)\s+(?:you|it)\s+(?:could|can|would|might)\b"),
    ("how_about", r"\b(?:how|what)\s+about\b"),
)
DECLINE = r"\b(?:don't|dont|do\s+not)\s+(?:really\s+|actually\s+)?need\b|\bno\s+need\b|^(?:no|nope)[\s,.!]+(?:thanks?|thank\s+you)\b|\bnot\s+(?:right\s+)?(?:now|today|yet)\b"
NO_PREFERENCE = r"\b(?:no|any)\s+(?:particular\s+)?preference\b|\bdo(?:n't|nt|\s+not)\s+(?:really\s+)?(?:care|mind)\b|\b(?:does|doesn't|doesnt|does\s+not)\s+(?:really\s+)?matter\b|\beither\s+(?:one\s+)?(?:is|would\s+be)\s+fine\b|\b(?:whatever|anything|any|either)\s+(?:is|will\s+do|works)\b|\bnot\s+picky\b"
BARE_ANSWER = r"^(?:(?:yes|yeah|yea|yep|sure|ok|okay|no|nope|that\s+works|sounds\s+good|that's\s+fine|fine|great|perfect)[\s,.!]*)+$"
VERB = r"\b(?:is|are|am|was|were|be|been|being|'s|'re|'m|'ll|'d|'ve|have|has|had|do|does|did|will|would|can|could|should|shall|may|might|must|need|needs|want|wants|go|goes|leave|leaves|arrive|arrives|travel|stay|come|get|eat|take|book|find|like|prefer|think|know|see|work|works|sounds?|plan|hope|matter|care|\w+ing|\w+ed)\b|'(?:s|re|m|ll|d|ve)\b"
DETAILS = (
    ("party_or_stay", NUMBER + r"\s+(?:of\s+us|people|persons|person|guests|adults|tickets?|nights?|days?|rooms?|seats?)\b|\b(?:just\s+)?(?:me|myself)\s+and\b|\bby\s+myself\b|\bjust\s+(?:me|myself)\b"),
    ("clock_word", r"\b" + NUMBER + r"\s*(?:o'?clock|am|pm|a\.m\.|p\.m\.)|\b(?:noon|midnight|morning|afternoon|evening)\b"),
    ("service_word", r"\b(?:trains?|taxis?|cabs?|hotels?|guest\s*houses?|guesthouses?|b\s*&\s*b|restaurants?|tables?|rooms?|tickets?|reservations?|booking|phone|number|address|postcode|post\s+code|reference|ref|fee|entrance|attractions?|museums?|colleges?|parks?|theatres?|theaters?|cinemas?|pools?|churches|church|gallery|wifi|wi-fi|internet|parking|stars?|food|cuisine|dinner|lunch|breakfast|departure|destination|arrive|arrival|leave|leaving|depart|departing|travel\s+time|hospital|police|lodging|accommodations?|place\s+to\s+stay)\b"),
)
CLOSING = r"^(?:(?:yes|okay|ok|great|perfect|thanks|thank you)[,.! ]+)*(?:(?:that(?:'s| is| will be)|this is|it is)\s+(?:all|everything)(?:\s+(?:i|we)\s+(?:need(?:ed)?|want(?:ed)?))?(?:\s+for\s+(?:now|today))?|(?:i(?:'m| am)|we(?:'re| are))\s+all\s+set)[,.! ]*(?:(?:thanks|thank you|goodbye|bye|cheers)[,.! ]*)*$"
CONFIRMATION = r"^(?:yes[,! ]*)?(?:that|it|this)(?:'s| is)?\s+(?:works?(?:\s+for\s+(?:me|us))?|sounds?\s+(?:good|great|fine|perfect)(?:\s+to\s+(?:me|us))?)[.! ]*(?:(?:thanks|thank you)[.! ]*)?$"
MORE_DETAILS = r"\b(?:bistros?|eater(?:y|ies)|gastropubs?|pubs?|venues?|rides?|lifts?|transport|transportation|lodgings?|hostels?|motels?|supper|brunch|fare|cost|budget|expensive|inexpensive|affordable)\b|\b(?:around|after|before|by|at)\s+(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b"
PLACE_NAME = r"\b(?:to|from|near|at|in)\s+(?:the\s+)?[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)*\b"
#: In auto-v2 "what about" and "how about" ask nothing by themselves.
OTHER_WH_QUESTION = SENTENCE + r"(?!(?:what|how)\s+about\b)" + WH + r"\b(?!\s+(?:i|we)\b)"

_DIRECT = (("L0", "want_statement", WANT), ("L0", "would_like", LIKE), ("L0", "looking_for", LOOKING), ("L0", "command", COMMAND))
_FORMULAS = tuple(("L1", name, p) for name, p in L1)
_ANSWERS = (("NR", "decline", DECLINE), ("INF", "no_preference", NO_PREFERENCE), ("INF", "bare_answer", BARE_ANSWER))
VERSIONS = {
    "auto-v1": (*_DIRECT, ("L0", "wh_question", WH_QUESTION), ("L0", "yes_no_question", YES_NO_QUESTION), *_FORMULAS, *_ANSWERS),
    "auto-v2": (
        ("NR", "closing", CLOSING), *_DIRECT, ("L0", "yes_no_question", YES_NO_QUESTION), ("L0", "wh_question", OTHER_WH_QUESTION), *_FORMULAS,
        ("INF", "confirmation", CONFIRMATION), *_ANSWERS,
    ),
}


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "’‘`�", "''''"), r"\s+", " "))


def level(text: Column, social_only: Column, found: Column, version: str = "auto-v1") -> Column:
    """struct<level, rule> of an utterance; found are its mentions (``mentions.extract``), social_only says that its acts are all social. A null text has no level."""
    has = lambda x, pattern: x.rlike("(?U)" + pattern)  # noqa: E731  words may have any letters
    t, no = normalized(text), F.lit(None).cast("string")
    named = lambda level, rule: F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))
    out = F.when(text.isNull(), F.struct(no.alias("level"), no.alias("rule"))).when(social_only, named("NR", "social_acts"))
    for name, rule, pattern in VERSIONS[version]:
        out = out.when(has(t, pattern), named(name, rule))
    out = out.when(~has(t, VERB), named("INF", "fragment")).when(F.exists(F.map_values(found), lambda v: F.size(v) > 0), named("L2", "slot_value"))
    for rule, pattern in DETAILS:
        out = out.when(has(t, pattern), named("L2", rule))
    if version == "auto-v2":
        out = out.when(has(t, MORE_DETAILS) | has(text, PLACE_NAME), named("L2", "extra_wording_detail"))
    return out.otherwise(named("L3", "no_detail"))


def leveled(rows, text_col: str, social_col: str, places: list[str] = (), foods: list[str] = (), versions: tuple[str, ...] = ("auto-v1",)):
    """rows with a column per version (auto_v1, auto_v2): struct<level, rule>. Mentions are found once for all versions."""
    found = rows.withColumn("_found", mentions.extract(F.col(text_col), list(places), list(foods)))
    return found.withColumns({v.replace("-", "_"): level(F.col(text_col), F.col(social_col), F.col("_found"), v) for v in versions}).drop("_found")
