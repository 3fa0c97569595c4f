r"""Regular expressions, in Java syntax.

All carry the flags d (only \n ends a line for ^ and $) and U (Unicode classes).
"""

# The expressions below define results and are stated as they are.
IDENTIFIERS = (
    r"(?dU)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"(?dU)\b[A-Z]{2,6}-\d{3,}\b",
    r"(?dUi)\b(?:req|request|trace|span|correlation|txn|transaction|order|session)[_-]?id\s*[:=]\s*[\"']?[\w-]+",
    r"(?dUi)\b(?:customer|order|account|invoice|ticket|incident)\s+#?\d+\b",
)
FAILURE = (
    r"(?dUi)\b(?<!\bno )(?<!\bzero )(?<!\bwithout )(?<!\bnot )"
    r"(?:fail(?:s|ed|ing|ure|ures)?|errors?|exceptions?|crash(?:es|ed)?|timed out|timeouts?|outages?|incidents?|root cause|panic(?:ked)?|denied|refused|unavailable|aborted)\b"
)
TIMESTAMP = (
    r"(?dU)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d{2}:\d{2}:\d{2}"
    r"|\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b"
)
HEX_RUN = r"(?dU)\b[0-9a-fA-F][0-9a-fA-F-]{7,}\b"
NUMBER = r"(?dU)\d+(?:\.\d+)?"
CORRECTION = (
    r"(?dUim)\binstead\s+of\b|\buse\s++[^.,;!?\n]{1,60}?\s++instead\b|\bdo(?:n'?t|\s+not)\s+use\b"
    r"|\bactually,?\s+(?:use|it'?s|i\s+meant|make\s+it)\b|\bi\s+meant\b|\bcorrection:|\bchange\s+(?:it|that|this)\s+to\b|\bswitch\s+to\b"
    r"|(?:^|(?<=[.!?]\s))no,\s+(?:use|it'?s|that'?s|make|i\b)"
)
CONSTRAINT = r"(?dUi)\b(?:must(?:\s+not)?|never|always|required|mandatory|forbidden|prohibited|do\s+not|don'?t|only\s+use|make\s+sure|ensure)\b"
DECISION = r"(?dUi)\b(?:decision|decided|recommend(?:ed|ation)?|conclu(?:de|ded|sion)|approved|rejected|denied|agreed)\b"
CORRECTED_VALUE = (
    r"(?dUi)(?<!n't\s)(?<!not\s)\b(?:use|switch\s+to|change\s+(?:it|that|this)\s+to|i\s+meant|actually,?\s+(?:use|it'?s|make\s+it))\s++"
    r"(?<value>[^.,;!?\n]{1,60}?)(?=\s++instead\b|\s*+[.,;!?\n]|\s*+$)"
)
REPLACED_VALUE = r"(?dUi)\binstead\s+of\s++(?<value>[^.,;!?\n]{1,60}?)(?=\s*+[.,;!?\n]|\s*+$)"
ASSERTION = (
    r"(?dU)(?<![\w.:/@-])(?<key>[A-Za-z][A-Za-z0-9_]{1,30})\s*[:=]\s*(?<quote>[\"']?)(?<value>[A-Za-z0-9][\w.\-]{0,40})\k<quote>"
    r"(?![\w:/.-])(?!\s*[:=])"
)
VOLATILE_KEY = (
    r"(?dU)(?:^|_)(?:id|ids|uuid|guid|key|token|hash|sha|digest|ts|time|timestamp|date|at|ms|latency|duration|elapsed|took|count|total|size|bytes|line|port|pid|offset|"
    r"seq|version|attempt|retry|retries|page|limit|level|levelname|lvl|severity|msg|message|logger|caller)$"
)
LEVEL = r"(?<level>TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|ERR|SEVERE|CRIT(?:ICAL)?|FATAL|ALERT|EMERG(?:ENCY)?|PANIC)"
_ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?"
_SYSLOG = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d{2}:\d{2}:\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
TIMESTAMPED_LOG = rf"(?dU)^\s*[\[(]?(?:{_ISO}|{_SYSLOG}|{_CLOCK})[\])]?(?:[^\n]{{0,80}}?\b(?i:{LEVEL})\b)?"
LEVEL_LOG = rf"(?dU)^\s*[\[(<]?{LEVEL}[\])>]?(?::|\s|$)"
LOGFMT_LOG = r"(?dU)^(?=[^\n]*\blevel=\"?(?<level>[A-Za-z]+))(?=[^\n]*\b(?:msg|message)=)"
TRACEBACK = (
    r"(?dU)^(?:\s*Traceback \(most recent call last\):\s*$"
    r'|\s+File "[^"\n]+", line \d+(?:, in [^\n]+)?$'
    r"|\s+at \S[^\n]{0,500}(?:\)|:\d+:\d+)\s*$"
    r"|\s*(?:Caused by|Suppressed): [\w$.]+"
    r"|\s+\.\.\. \d+ (?:more|common frames omitted)\s*$"
    r"|(?:panic: |goroutine \d+ \[|fatal error: )"
    r'|(?:Exception in thread "[^"\n]*" )?(?:[a-z_$][\w$]*\.)+[A-Z][\w$]*(?:Exception|Error|Throwable)(?::[^\n]*)?$'
    r"|(?:[A-Za-z_]\w*\.)*[A-Z]\w*(?:Error|Exception|Exit|Interrupt)(?::[^\n]*)?$)"
)
TABLE_ROW = r"(?dU)^\s*\|[^\n]*\|\s*$"
JSON_START = (
    r"(?dU)^\s*(?:\{\s*(?:\"|\}|$)|\[\s*(?:[\[{\"]|\]|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\s*[,\]]|true\b|false\b|null\b|$))"
)
# End of the fixed expressions.

FENCE = r"(?d)^ {0,3}(?:```|~~~)"
#: What ends a line, as Python's splitlines sees it, and one whole line.
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE = rf"[^{BREAKS}]*(?:\r\n|[{BREAKS}])|[^{BREAKS}]+"
#: White space as Python's split and strip see it.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"

# Severities, their ranks and other names for them.
SEVERITY_RANKS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
SEVERITY_ALIASES = {
    "TRACE": "DEBUG",
    "NOTICE": "INFO",
    "WARN": "WARNING",
    "ERR": "ERROR",
    "SEVERE": "ERROR",
    "CRIT": "CRITICAL",
    "FATAL": "CRITICAL",
    "ALERT": "CRITICAL",
    "EMERG": "CRITICAL",
    "EMERGENCY": "CRITICAL",
    "PANIC": "CRITICAL",
}
