"""Reading LaTeX markup away from running text."""

from __future__ import annotations

import re
import unicodedata

# Accent commands and the combining marks they stand for; letters with a command of their own.
MARKS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "c": "̧", "v": "̌", "H": "̋", "u": "̆", "k": "̨", "d": "̣", "b": "̱", "r": "̊"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "dj": "đ", "DJ": "Đ", "ng": "ŋ"}

ACCENT = re.compile(
    r"""\\(["'`^~=.])\s*(?:\{\s*(\\?[^\W\d_])\s*\}|(\\[ij])(?![A-Za-z])[ \t]*|([^\W\d_]))"""
    r"""|\\([cvHukdbr])(?:\s*\{\s*([^\W\d_])\s*\}|\s+([^\W\d_]))"""
    r"""|\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j|dh|DH|th|TH|dj|DJ|ng)(?![A-Za-z])(?:\{\}|[ \t]+)?"""
)
MAYBE_ACCENT = re.compile(r"""\\(?:["'`^~=.]|[cvHukdbr][\s{]|(?:ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j|dh|DH|th|TH|dj|DJ|ng)(?![A-Za-z]))""")
#: Commands whose arguments are keys, files or sizes, not text; and every other command's name.
AWAY = re.compile(
    r"\\(?:(?:cite[a-z]*|(?:auto|eq|page|name|c|C)?ref|label|input|include|includegraphics|begin|end|bibitem|bibliography(?:style)?|usepackage|documentclass|[hv]space|url)\*?"
    r"(?![A-Za-z])\s*(?:\[[^\]]*\])*\s*(?:\{[^{}]*\})?|[A-Za-z]+\*?)"
)
DEFINED = re.compile(r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?\s*\{([^{}#\\]*)\}|\\def\s*\\([A-Za-z]+)\s*\{([^{}#\\]*)\}")
NO_BRACES = str.maketrans("", "", "{}")


def _letter(m: re.Match) -> str:
    mark, braced, dotless, plain, word_mark, braced2, plain2, letter = m.groups()
    if letter:
        return LETTERS[letter]
    base = (braced or dotless or plain or braced2 or plain2).lstrip("\\")
    return unicodedata.normalize("NFC", base + MARKS[mark or word_mark])


def accents(text: str) -> str:
    """Accents written as commands become their letters."""
    return ACCENT.sub(_letter, text) if MAYBE_ACCENT.search(text) else text


def plain(text: str) -> str:
    """Text without markup: own macros without arguments are written out, commands go, what they print stays. Comments stay, too."""
    if "\\" in text:
        text = accents(text)
        own = {a or c: (b if a else d) for a, b, c, d in DEFINED.findall(text)}
        if own:
            text = re.sub(r"\\(" + "|".join(sorted(own, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}|[ \t]+)?", lambda m: own[m[1]], text)
        text = AWAY.sub(" ", text.replace("\\-", "").replace("\\/", ""))
    text = text.translate(NO_BRACES).casefold()
    return text if text.isascii() else unicodedata.normalize("NFC", text)
