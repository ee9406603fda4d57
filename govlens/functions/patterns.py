"""Patterns, word lists, labels and constants that define the detectors' results.

Patterns are written in the dialect of Python's ``re`` (Unicode classes, ``.`` stops only at a line feed);
``java_regex`` rewrites the shorthand classes so that Spark's Java regexes match exactly the same texts.
"""

from __future__ import annotations

import re

# ---- fixed values: personal data (type, pattern, replacement), in redaction order ----
PII_PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[REDACTED_PHONE]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[REDACTED_CC]"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[REDACTED_IP]"),
]

# ---- fixed values: requests for sensitive data (type, patterns on lower-cased text) ----
SENSITIVE_PATTERNS = [
    (
        "ssn",
        [
            r"(provide|enter|give|share|what is|tell me).{0,30}(ssn|social security)",
            r"(ssn|social security).{0,20}(number|#)",
            r"your social security",
        ],
    ),
    (
        "credit_card",
        [
            r"(provide|enter|give|share).{0,30}(credit card|card number|cvv|expir)",
            r"(credit card|debit card).{0,20}(number|details|info)",
            r"your (credit|debit) card",
        ],
    ),
    (
        "bank_account",
        [
            r"(provide|enter|give|share).{0,30}(bank account|routing number|account number)",
            r"your bank.{0,20}(account|details|number)",
        ],
    ),
    (
        "password",
        [
            r"(provide|enter|give|share|what is).{0,20}(password|pin|passcode)",
            r"your (password|pin)",
        ],
    ),
]

# ---- fixed values: prompt injection (pattern on lower-cased text, type) ----
INJECTION_PATTERNS = [
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?", "instruction_override"),
    (r"you\s+are\s+now\s+", "role_manipulation"),
    (r"pretend\s+(to\s+be|you\s+are)", "role_manipulation"),
    (r"act\s+as\s+(if|though)?", "role_manipulation"),
    (r"developer\s+mode", "jailbreak"),
    (r"\bdan\b", "jailbreak"),
    (r"do\s+anything\s+now", "jailbreak"),
    (r"jailbreak", "jailbreak"),
    (r"bypass\s+(the\s+)?(filter|restriction|rule)", "jailbreak"),
    (r"reveal\s+(your\s+)?(system\s+)?prompt", "system_probe"),
    (r"what\s+are\s+your\s+instructions", "system_probe"),
]

# ---- fixed values: toxic keywords (substrings of lower-cased text) ----
TOXIC_KEYWORDS = [
    "hate", "kill", "die", "stupid", "idiot", "dumb",
    "racist", "sexist", "threat", "attack", "destroy",
]

# ---- fixed values: scores, thresholds, prices ----
PII_CONFIDENCE = 0.7
TOXIC_SCORE = 0.5
TOXIC_CATEGORY = "potential_toxicity"
INJECTION_SCORE_PER_TYPE = 0.3
BLOCK_THRESHOLD = 0.7
PROMPT_PRICE_PER_MILLION = 0.075
COMPLETION_PRICE_PER_MILLION = 0.30
CHARS_PER_TOKEN = 4

# ---- fixed values: explanation texts ----
RULE_MATCH = {
    "pii": "Regex-based detection (fallback mode)",
    "toxicity": "Basic keyword detection (fallback mode)",
    "injection": "Pattern-based detection (fallback mode)",
}
NO_MATCH = {
    "pii": "No PII detected",
    "toxicity": "No toxic content detected",
    "injection": "No injection attempts detected",
    "sensitive": "No sensitive data requests detected",
}
SENSITIVE_MATCH_PREFIX = "Detected request for: "

# Literals of which at least one occurs in every text a pattern matches. They let the detectors skip the regex on
# texts that cannot match. Of an injection pattern's literals all must occur.
SENSITIVE_LITERALS = {
    "ssn": ["ssn", "social security"],
    "credit_card": ["card", "cvv", "expir"],
    "bank_account": ["bank", "routing number", "account number"],
    "password": ["password", "pin", "passcode"],
}
INJECTION_LITERALS = [
    ["ignore"],
    ["you", "now"],
    ["pretend"],
    ["act", "as"],
    ["developer"],
    ["dan"],
    ["anything"],
    ["jailbreak"],
    ["bypass"],
    ["reveal"],
    ["what", "instructions"],
]

# Character classes of Python's ``re`` for str patterns, in Java notation.
_WORD = r"[\p{L}\p{N}_]"
_NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
_NO_WORD_AFTER = r"(?![\p{L}\p{N}_])"
_ANY_BOUNDARY = rf"(?:{_NO_WORD_BEFORE}(?={_WORD})|(?<={_WORD}){_NO_WORD_AFTER})"
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The same white space as plain characters, for trimming like str.strip().
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def java_regex(pattern: str) -> str:
    """Rewrite a pattern of Python's ``re`` for java.util.regex with the same matches.

    Covers what this module uses: ``\\b \\d \\s`` and ``.``. A boundary beside a digit or a letter needs only one
    look-around. At the front it is checked after the first character, so most positions fail on one comparison:
    ``\\b\\d{3}`` becomes digit, no word character before that digit, two more digits.
    ``(?d)`` makes ``.`` stop at a line feed alone.
    """
    out = pattern
    front = re.match(r"\\b(\\d|[a-z])(?:\{(\d+)(?:,(\d+))?\})?", pattern)
    if front:
        first, low, high = front.groups()
        rest = ""
        if low:
            bounds = str(int(low) - 1) + (f",{int(high) - 1}" if high else "")
            rest = f"{first}{{{bounds}}}"
        out = f"{first}(?<!{_WORD}{first}){rest}{pattern[front.end():]}"
        if out.endswith(r"\b"):
            out = out[:-2] + _NO_WORD_AFTER
    out = out.replace(r"\b", _ANY_BOUNDARY).replace(r"\d", r"\p{Nd}").replace(r"\s", _SPACE)
    return "(?d)" + out if "." in pattern else out


# The email pattern in linear time. As written above, every word boundary inside a long run of address characters
# (encoded data, for instance) starts a scan to the end of that run. All starts in one run share what follows it, so
# only its first boundary matters: this form enters a run at its front, or where the last match ended, keeps in
# group 1 what lies before the first boundary, and goes on from there.
EMAIL_JAVA = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))((?:[A-Za-z0-9_]++|[.%+-]++)??)"
    + _ANY_BOUNDARY
    + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
    + _ANY_BOUNDARY
)

# A digit run of three, or digits around a full stop: part of every phone, SSN, card or IP match.
DIGIT_GATE = r"\p{Nd}(?:\p{Nd}\p{Nd}|\.\p{Nd})"
