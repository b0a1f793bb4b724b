"""Rule sets in the part of regular expressions on which Java and RE2 agree: no look-around, no word boundary."""

from .model import RegexRule

#: The patterns of the oracle-checked queries.
SAFE = (
    RegexRule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95),
    RegexRule("IP_ADDRESS", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0.9),
    RegexRule("PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.95),
    RegexRule("CREDIT_CARD", r"[0-9]{16}", 0.9),
)
#: A second provider whose spans meet the first one's in every way.
OVERLAPPING = (
    RegexRule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.7),
    RegexRule("URL", r"@[a-z0-9]+\.example\.com.{0,2}", 0.6),
    RegexRule("PHONE_NUMBER", r"\) [0-9]{3}-[0-9]{4}.{0,3}", 0.5),
    RegexRule("NATIONAL_ID", r"[0-9]{12}", 0.4),
    RegexRule("EMPLOYEE", r"[0-9]{1,3}\.[0-9]{1,3}", 0.8),
)
#: A rule for tables without personal data, so that queries over them have hits.
NAMES = (RegexRule("PERSON", r"Ther[a-z]+", 0.8), RegexRule("LOCATION", r"[A-Z]nt[a-z]+", 0.8))
CARDS = (RegexRule("CREDIT_CARD", r"[0-9]{16}", 0.9, validator_id="luhn"),)
NUMBERS = (RegexRule("NATIONAL_ID", r"6[0-9]", 0.9),)
