"""Regular expressions over whole texts: matches as ``(kind, start, end)`` in code points, end exclusive.

Each finder is linear in the text: runs are matched possessively or from their first
character on, so that a very long run without a match is passed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    "("
    + "|".join(
        "".join(f"[{c.upper()}{c}]" for c in word) for word in ("password", "passwd", "secret", "token")
    )
    + r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    + r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check of an international bank account number."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Around each ``@``: the run of local characters before it, the longest domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[Span]:
    for match in IP.finditer(text):
        parts = [part.lstrip("0") for part in match[0].split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            yield "ip", match.start(), match.end()


def cards(text: str) -> Iterator[Span]:
    for match in CARD.finditer(text):
        digits = DIGITS.sub("", match[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", match.start(), match.end()


def phones(text: str) -> Iterator[Span]:
    for match in PHONE.finditer(text):
        if 9 <= len(DIGITS.sub("", match[0])) <= 15:
            yield "phone", match.start(), match.end()


def assigned(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Assignments with the assigned value."""
    lowered = text.lower()
    if not any(word in lowered for word in KEYWORDS):
        return
    for match in ASSIGN.finditer(text):
        if len(match[2]) >= 12:
            yield "assign", match.start(), match.end(), match[2]


def access_keys(text: str) -> Iterator[Span]:
    for match in ACCESS.finditer(text):
        if match.end() - match.start() >= 18:
            yield "access", match.start(), match.end()


def hex_runs(text: str) -> Iterator[Span]:
    for match in HEX.finditer(text):
        yield "hex", match.start(), match.end()
