"""The detection patterns in scan order, the types, and the word lists that results depend on.

Classes are ASCII on purpose, so that every engine reads them alike; white space is any of the six ASCII characters,
as personal data may run over a line's end.
"""

_S = r"[ \t\n\x0b\f\r]"

#: A match begins where a run of its first class does, or where the last match ended: no run is tried from its middle, nor
#: given back once it is read, as its class has no @.
EMAIL = r"(?<![A-Za-z0-9._%+-](?!\G))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: One class is looked for before the forms that begin with it: most places hold none of it.
PHONE = rf"[+(0](?:(?<=\+)44{_S}?7[0-9]{{3}}|(?<=\()07[0-9]{{3}}\)?|(?<=0)7[0-9]{{3}}\)?){_S}?[0-9]{{3}}{_S}?[0-9]{{3}}"
NI_NUMBER = r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}[0-9]{6}[A-D]\b"
_GAP = r"[- \t\n\x0b\f\r]?"
#: A first digit is looked for before the word's edge at it is: most places hold none.
CREDIT_CARD = rf"[3-6](?<=\b[3-6])(?:(?<=4)[0-9]{{3}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}|(?<=5)[1-5][0-9]{{2}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}|(?<=3)[47][0-9]{{2}}{_GAP}[0-9]{{6}}{_GAP}[0-9]{{5}}|(?<=6)(?:011|5[0-9]{{2}}){_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}}{_GAP}[0-9]{{4}})\b"
IBAN = r"(?i)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}[A-Z0-9]{0,16}\b"
DOB = r"[0-9](?<=\b[0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]/[0-9]{2}/[0-9]{4}|[0-9]-[0-9]{2}-[0-9]{4})\b"
POSTCODE = rf"(?i)\b[A-Z]{{1,2}}[0-9][A-Z0-9]?{_S}?[0-9][A-Z]{{2}}\b"
#: Number, one or two words, comma, words, postcode. A match begins with the first digit of its number.
STREET = rf"(?i)[0-9](?<![0-9][0-9])[0-9]*{_S}+[A-Z]{{2,}}(?:{_S}+[A-Z]{{2,}})?,{_S}*[A-Z]{{2,}}(?:{_S}+[A-Z]{{2,}})*{_S}*,?{_S}*[A-Z]{{1,2}}[0-9][A-Z0-9]?{_S}?[0-9][A-Z]{{2}}\b"

#: (type, pattern) in scan order.
SCAN = [("EMAIL", EMAIL), ("PHONE", PHONE), ("NI_NUMBER", NI_NUMBER), ("CREDIT_CARD", CREDIT_CARD), ("IBAN", IBAN), ("DOB", DOB), ("ADDRESS", POSTCODE), ("ADDRESS", STREET)]

TYPES = ["PERSON", "EMAIL", "PHONE", "ADDRESS", "SSN", "NI_NUMBER", "CREDIT_CARD", "IBAN", "DOB", "ORG", "MEDICAL", "OTHER"]
#: Types whose separators do not count when surfaces are compared.
UNSEPARATED = ["PHONE", "NI_NUMBER", "CREDIT_CARD", "IBAN", "SSN"]
ORG_SUFFIXES = ["corp", "corporation", "inc", "incorporated", "ltd", "limited", "llc", "co", "company", "plc", "group", "holdings", "gmbh", "sa", "ag"]
#: Pseudonym tags that differ from the type's name.
TAGS = {"NI_NUMBER": "NI", "CREDIT_CARD": "CARD", "OTHER": "REDACTED"}
