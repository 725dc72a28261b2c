"""Patterns, labels, tags, messages and templates.

Everything here must have exactly this content for results to be right, so it is kept as plain
text in one place. `(?U)` gives Java the Unicode meaning of \\w, \\b, \\d and \\s; `(?iU)` is the
same with case ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# --- characters that count as white space when text is stripped -----------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def ahead(first: str, pattern: str) -> str:
    """The pattern with its possible first characters tested first.

    A boundary test with Unicode rules is slow and is made at every character; looking at the
    character itself first leaves few places for it. The matches are the same.
    """
    flags, rest = re.match(r"(\(\?i?U\))(.*)", pattern, re.S).groups()
    return f"{flags}(?={first}){rest}"


def swallowing(mail: str) -> str:
    """An e-mail pattern that takes linear time on long runs of an address's characters.

    Where no address begins at a run's first word boundary, none begins at a later one: the same
    sign and domain would follow. So a run of 64 and more is then matched as a whole, with the sign
    behind it, and skipped; `rules.ADDRESS` tells such a match from an address.
    """
    return mail.removesuffix(r"\b").replace(r"\b", r"\b(?:", 1) + r"\b|[A-Za-z0-9._%+-]{64}[A-Za-z0-9._%+-]*+@?)"


# An address has something behind its sign; a skipped run has not.
ADDRESS = "@."


class Detector(NamedTuple):
    """One kind of finding.

    `hint` is a cheap test that must hit before `pattern` can; `first` is the class of a match's
    first character, where few characters are in it, or a look ahead that stands before the flags.
    """

    entity: str
    pattern: str
    hint: str
    first: str = ""
    luhn: bool = False
    mail: bool = False

    @property
    def search(self) -> str:
        """The pattern to search a text with; `mail` ones also find runs that are no address."""
        if self.mail:
            return swallowing(self.pattern)
        if self.first.startswith("(?="):
            return self.first + self.pattern
        return ahead(self.first, self.pattern) if self.first else self.pattern


# --- span detectors, in rank order (ties between equal spans go to the earlier one) ----------
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b"
AADHAAR = r"(?U)\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
SSN = r"(?U)\b\d{3}-?\d{2}-?\d{4}\b"
IP_URL = (
    r"(?iU)(?:rtsp://|http://|https://|ftp://)?"
    r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    r"(?::\d+|:RTSP|:rtsp)?"
    r"(?:/\d{1,2})?"
)
CARD = r"(?U)\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
DATE = r"(?U)\b\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b"

SPAN_DETECTORS = (
    Detector("EMAIL", EMAIL, "@", "", mail=True),
    Detector("PHONE", PHONE, r"(?U)\d{4}", r"[+(\d]"),
    Detector("AADHAAR", AADHAAR, r"(?U)\d{4}", r"\d"),
    Detector("SSN", SSN, r"(?U)\d{4}", r"\d"),
)
VALUE_DETECTORS = (
    Detector("IP_ADDRESS", IP_URL, r"[0-9]\.[0-9]", "(?=[0-9]|[RrHhFf][Tt])"),
    Detector("EMAIL_ADDRESS", EMAIL, "@", "", mail=True),
    Detector("PHONE_NUMBER", PHONE, r"(?U)\d{4}", r"[+(\d]"),
    Detector("CREDIT_CARD", CARD, r"(?U)\d{4}", r"\d", luhn=True),
    Detector("DATE_TIME", DATE, r"(?U)\d[/-]\d", r"\d"),
)

TAGS = {
    "PERSON": "[REDACTED_NAME]",
    "EMAIL": "[REDACTED_EMAIL]",
    "PHONE": "[REDACTED_PHONE]",
    "AADHAAR": "[REDACTED_ID]",
    "SSN": "[REDACTED_ID]",
}

# --- labels that are form structure, and words that are never a person ------------------------
STRUCTURAL_LABELS = (
    "NAME", "DATE", "TIME", "SIGN", "INITIAL", "INITIALS", "REASON", "VISIT", "PURPOSE", "VISITOR",
    "LOG", "BOOK", "MONTH", "YEAR", "DAY", "IN", "OUT", "TYPE", "METHOD", "QUANTITY", "DESTRUCTION",
    "CERTIFICATE", "SECURITY", "OFFICER", "REASON FOR VISIT", "TIME IN", "TIME OUT",
    "SIGN / INITIALS", "FULL NAME", "EMAIL", "REVIEWED DATE", "CHANGES MADE", "REVISION",
    "CHANGES MADE (IF ANY)",
)
MONTHS = (
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER",
    "OCTOBER", "NOVEMBER", "DECEMBER",
)
NOT_PERSONS = ("INC", "LLC", "LTD", "CORP", "CO", "AND", "THE", "OF", "CADENCE")

# --- file types -------------------------------------------------------------------------------
UPLOAD_TYPES = ("pdf", "png", "jpg", "jpeg", "pptx", "xlsx", "txt", "docx")
REPORT_TYPES = ("pdf", "png", "jpg", "jpeg", "pptx", "xlsx", "txt")
DIRECTORY_TYPES = (
    "png", "jpg", "jpeg", "bmp", "tiff", "pdf", "xlsx", "xls", "pptx", "txt", "csv",
)
IMAGE_TYPES = ("png", "jpg", "jpeg")
# The start of the name of a file that holds a model's analysis (a fixed value).
MODEL_ANALYSIS_PREFIX = "gemini_analysis_"
SIZE_LIMIT = 16 * 1024 * 1024

# --- ordered cleanse chain --------------------------------------------------------------------
CLEANSE_EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CLEANSE_PHONE = r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
CLEANSE_SSN = SSN
CLEANSE_CARD = CARD
CLEANSE_IP = r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
CLEANSE_DATE = DATE
CLEANSE_MAC = r"(?U)\b([0-9A-F]{2}[:-]){5}([0-9A-F]{2})\b"
CLEANSE_LICENSE = r"(?U)\b[A-Z]{2}\d{7,9}\b"
CLEANSE_PASSPORT = r"(?U)\b[A-Z]\d{8,9}\b"
CLIENT_TERMS = (
    "client", "customer", "company", "organization", "corporation", "incorporated", "limited",
    "llc", "inc", "ltd", "solutions", "systems", "technologies", "tech", "global", "acme",
)
# Case is ignored for the OCR word test.
OCR_WORD_PATTERNS = (
    ("EMAIL", CLEANSE_EMAIL),
    ("PHONE", CLEANSE_PHONE),
    ("SSN", CLEANSE_SSN),
    ("IP", CLEANSE_IP),
)

# --- security facts: category, heading, patterns in order (case ignored) ----------------------
SECURITY = (
    ("firewall_rules", "FIREWALL RULES:", (
        r"(allow|permit|deny|block)\s+(from|to)\s+[\d\.\*]+",
        r"(inbound|outbound)\s+(allow|deny)",
        r"port\s+\d+",
        r"(tcp|udp)\s+(allow|deny)",
    )),
    ("iam_policies", "IAM POLICIES:", (
        r"(role|policy|permission)\s+[\w\-]+",
        r"(admin|user|guest)\s+(access|rights)",
        r"(read|write|execute)\s+(access|permission)",
    )),
    ("access_controls", "ACCESS CONTROLS:", (
        r"(authentication|authorization)\s+\w+",
        r"(login|signin)\s+(required|enabled)",
        r"(multi-factor|mfa|2fa)\s+(enabled|required)",
    )),
    ("password_policies", "PASSWORD POLICIES:", (
        r"(password|passwd)\s+(policy|requirements)",
        r"(min|max)\s+(length|age)",
        r"(complexity|strength)\s+(required|enforced)",
    )),
    ("encryption_info", "ENCRYPTION INFORMATION:", (
        r"(encryption|encrypted)\s+\w+",
        r"(aes|rsa|ssl|tls)\s*\d*",
        r"(certificate|cert)\s+\w+",
    )),
    ("vulnerabilities", "VULNERABILITIES:", (
        r"(vulnerability|exploit)\s+\w+",
        r"(cve|cvss)\s*[-\d]+",
        r"(risk|threat)\s+(level|rating)",
    )),
)
# Per category and pattern: words of which a match must hold one, tested before the pattern.
SECURITY_HINTS = {
    "firewall_rules": (("allow", "permit", "deny", "block"), ("bound",), ("port",), ("tcp", "udp")),
    "iam_policies": (
        ("role", "policy", "permission"), ("admin", "user", "guest"), ("access", "permission"),
    ),
    "access_controls": (
        ("authentication", "authorization"), ("login", "signin"), ("multi-factor", "mfa", "2fa"),
    ),
    "password_policies": (("passw",), ("min", "max"), ("complexity", "strength")),
    "encryption_info": (("encrypt",), ("aes", "rsa", "ssl", "tls"), ("cert",)),
    "vulnerabilities": (("vulnerability", "exploit"), ("cve", "cvss"), ("risk", "threat")),
}
# Letters beyond ASCII that match an ASCII letter when case is ignored, and stay so in lower case.
CASE_TWINS = ("\u0130", "\u0131", "\u017f")
SECURITY_NONE = "No specific security information found."

# --- findings: any keyword inside the lower-cased text ----------------------------------------
FINDINGS = (
    (("biometric", "fingerprint", "face recognition"), "Uses biometric authentication controls."),
    (("manual", "paper", "spreadsheet"), "Manual processes may introduce operational errors."),
    (("timestamp", "audit log", "access log"), "Tracks access events with time-based logging."),
    (("encryption", "aes", "tls", "ssl"), "Applies encryption mechanisms for data protection."),
    (("mfa", "multi-factor", "2fa"),
     "Enforces multi-factor authentication for account security."),
    (("firewall", "allow", "deny", "port"),
     "Defines explicit network access and firewall controls."),
    (("policy", "compliance", "governance"),
     "References compliance or governance policy controls."),
    (("backup", "recovery", "disaster"),
     "Mentions resilience through backup or recovery planning."),
)
FINDING_NONE = "No significant themes were detected from extracted content."
FINDING_PAD = "Additional review recommended to derive more domain-specific insights."
DESCRIPTION_NONE = "No readable text found after extraction."

# --- report text ------------------------------------------------------------------------------
RULER = "=" * 50
CONTENT_HEADING = "CLEANSED CONTENT:"
SECURITY_HEADING = "SECURITY ANALYSIS:"
MODEL_HEADING = "GEMINI AI ANALYSIS:"
NOT_EXTRACTABLE = "File type not supported for text extraction."
NO_ANALYSIS = "No analysis available"

# --- prompt templates; {kind} and {content} are filled per document ----------------------------
ANALYSIS_PROMPT = """
        Please analyze the following {kind} document content and provide a comprehensive analysis:

        CONTENT TO ANALYZE:
        {content}

        Please provide your analysis in the following structured format:

        ## DOCUMENT OVERVIEW
        - Document type and purpose
        - Key topics or themes
        - Overall tone and style

        ## MAIN CONTENT SUMMARY
        - Brief summary of the main points
        - Key sections or chapters (if applicable)

        ## KEY INSIGHTS
        - Important findings or data points
        - Notable patterns or trends
        - Significant observations

        ## POTENTIAL USE CASES
        - How this document might be used
        - Target audience
        - Business or research applications

        ## RECOMMENDATIONS
        - Suggestions for further action
        - Areas for additional research
        - Potential improvements or considerations

        Please ensure your analysis is professional, thorough, and actionable.
        """
SECURITY_PROMPT = """
            As a cybersecurity expert, please analyze the following document content for security implications:

            CONTENT:
            {content}

            Please provide your security analysis in the following format:

            ## SECURITY ASSESSMENT
            - Overall security posture
            - Identified risks or vulnerabilities
            - Compliance considerations

            ## DATA SENSITIVITY ANALYSIS
            - Types of data present
            - Sensitivity level assessment
            - Privacy implications

            ## RECOMMENDATIONS
            - Security best practices
            - Risk mitigation strategies
            - Policy recommendations

            Focus specifically on security and data protection aspects.
            """

NO_SECURITY_ANALYSIS = "No security analysis available"
