"""Names in ``source`` strings: the author of a work, the author a text continues, or an assistant.

A string is read by its form. Each form gives a kind, a given name (or initial), a surname, and the title if it has one:

    Given Surname, Title (1871), 2nd ed.      SURNAME, Given: Title (1871)      Surname (Given) / Title [1871]
    G. Surname, Title, 1871                   Title, by Given Surname           given surname - title
    after Given Surname, Title                continuation of G. Surname: Title in the manner of Surname, Given
    G. Surname: Title                         Given Surname                 Surname, Given
    Name, typical register    NAME / typical register    name-2 (typical)    output of Name 2 [typical]

Two forms have several readings: ``A / B`` may have its author on either side, and two words may be an author or an
assistant. Which one is meant is decided by what other strings name without doubt.
"""

from __future__ import annotations

import re
import unicodedata

from .canon import single_map, INVISIBLE

# --- fixed values: forms of source strings, tried in this order on the folded string ----------------
NOBODY = ("", "unknown", "anonymous", "anon", "n/a", "none", "null")
ASSISTANT_FORMS = (
    r"output of (?P<name>.+?) ?\[[^\]]*\]",
    r"(?P<name>.+?), \w+ register",
    r"(?P<name>.+?) ?/ ?\w+ register",
    r"(?P<name>[^,:/]+?) ?\((?:plain|typical|\w+ register)\)",
)
AUTHOR_FORMS = (
    r"continuation of (?P<given>.+?) (?P<sur>[^ :]+) ?: ?(?P<title>.+)",
    r"in the manner of (?P<sur>[^,]+), ?(?P<given>.+)",
    r"after (?P<given>[^,]+?) (?P<sur>[^ ,]+), ?(?P<title>.+)",
    r"(?P<title>.+), by (?P<given>[^,]+) (?P<sur>[^ ,]+)",
    r"(?P<sur>[^(,:/]+?) ?\((?P<given>[^)]+)\) ?/ ?(?P<title>.+)",
    r"(?P<sur>[^,:]+), ?(?P<given>[^:,]+): ?(?P<title>.+)",
    r"(?P<sur>[^,:/]+), ?(?P<given>[^\W\d]+(?: [^\W\d]\.?)+)",
    r"(?P<given>[^,]+?) (?P<sur>[^ ,]+), ?(?P<title>.+)",
    r"(?P<given>[^-]+?) (?P<sur>\S+) [-–—] (?P<title>.+)",
    r"(?P<given>[^,:/]+) (?P<sur>[^ ,:/]+): ?(?P<title>.+)",
    r"(?P<sur>[^ ,:/]+), ?(?P<given>[^,:/]+)",
)
BOTH_SIDES = r"(?P<left>[^/]+?) ?/ ?(?P<right>[^/]+)"
BARE = r"(?P<given>[^,:/()\[\]]+) (?P<sur>[^ ,:/()\[\]]+)"
# -----------------------------------------------------------------------------------------------------
_ASSISTANT = [re.compile(f) for f in ASSISTANT_FORMS]
_AUTHOR = [re.compile(f) for f in AUTHOR_FORMS]
_FOLD = {ord(k): v for k, v in single_map().items()} | {ord(c): None for c in INVISIBLE}


def folded(source: str) -> str:
    """Lower case, single blanks, look-alike characters mapped, accents dropped."""
    text = unicodedata.normalize("NFKD", source.translate(_FOLD))
    text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(text.lower().split())


def _words(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text))


def _titled(text: str) -> str:
    """A title without edition and year."""
    return _words(re.sub(r"[ ,]*[(\[]?\b\d{4}[)\]]?$", "", re.sub(r",? ?\d+(?:st|nd|rd|th) ed\.?$", "", text)))


def _author(given: str, sur: str, title: str = "") -> tuple[str, str, str, str]:
    """The surname is one word; what comes before it belongs to the given names. Initials after the first name are
    dropped, and an initial in front stands alone."""
    *before, last = _words(sur).split() or [""]
    first, *rest = _words(given).split() + before or [""]
    return "author", last, first if len(first) == 1 else " ".join([first, *(w for w in rest if len(w) > 1)]), _titled(title)


def read_source(source: str | None) -> list[tuple[str, str, str, str]]:
    """The readings (kind, surname or assistant, given name, title), the likeliest first; none if the string names
    nobody. A given name of one letter is an initial. A string of no known form is an author by its whole text."""
    text = folded(source or "")
    if text.strip(" .?-") in NOBODY:
        return []
    for form in _ASSISTANT:
        if m := form.fullmatch(text):
            return [("assistant", _words(m["name"]), "", "")]
    for form in _AUTHOR:
        if m := form.fullmatch(text):
            d = m.groupdict()
            return [_author(d["given"], d["sur"], d.get("title") or "")]
    if m := re.fullmatch(BOTH_SIDES, text):
        sides = (m["right"], m["left"]), (m["left"], m["right"])
        return [_author(n["given"], n["sur"], title) for name, title in sides if (n := re.fullmatch(BARE, name))] or [("author", _words(text), "", "")]
    if m := re.fullmatch(BARE, text):
        return [_author(m["given"], m["sur"]), ("assistant", _words(text), "", "")]
    return [("author", _words(text), "", ""), ("assistant", _words(text), "", "")]
