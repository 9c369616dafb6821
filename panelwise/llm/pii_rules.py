"""Rules for personal data: the base spans, and what a span that a model proposes must look like."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
PROPOSED_EMAIL = re.compile(r"[^\s@<>,;:\"'()]+@[A-Za-z0-9À-￿][^\s@<>,;:\"'()]*[A-Za-z0-9À-￿]\Z")
PROPOSED_IP = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}\Z")
PROPOSED_CARD = re.compile(r"[0-9]{4}([\x20-]?[0-9]){8,15}\Z")
PROPOSED_PHONE = re.compile(r"(\+[\x20(]*|\(|00[\x20.-])?[0-9]+([\x20().-]+[0-9]+){2,5}\Z")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check; start, end, kind, in order of start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def plausible(text: str, span: Span) -> bool:
    """Whether a proposed span can be what it is called: its form, and no digit or letter going on beside it."""
    a, b, kind = span
    s, before, after = text[a:b], text[a - 1:a], text[b:b + 1]
    if before.isalnum() or after.isalnum() or kind != "email" and (before in ("+", ".", "-") and a or after == "-" or after == "." and text[b + 1:b + 2].isdigit()):
        return False
    digits = NOT_DIGIT.sub("", s)
    if kind == "email":
        return bool(PROPOSED_EMAIL.match(s)) and len(s) <= 254
    if kind == "ip":
        return bool(PROPOSED_IP.match(s)) and octets(s)
    if kind == "card":
        return bool(PROPOSED_CARD.match(s)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(PROPOSED_PHONE.match(s)) and 10 <= len(digits) <= 15 and not PROPOSED_IP.match(s)
