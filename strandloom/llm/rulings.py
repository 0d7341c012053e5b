"""The court-written text of a ruling: without headers, headnotes, citations, quoted speech and page furniture."""

from __future__ import annotations

import html
import re
import unicodedata

# Section headings in English, German and French.
BODY = ("facts", "reasons", "sachverhalt", "erwägungen", "faits", "considérants")
CLOSE = ("order", "dispositiv", "dispositif")

_WORDS = "|".join(w[0].upper() + w[1:] + "|" + w.upper() for w in (*BODY, *CLOSE))
_MARK = r"(?:[\[(¶§]\s*)?\d"
_HEADING = re.compile(rf"(?<!\w)({_WORDS})(?!\w)[\s:.]*(?={_MARK}|(?:{_WORDS})(?!\w)|\Z)")
_LOOSE = re.compile(rf"(?:^|\n|\s\s)\s*([^\W\d_]{{5,13}})[\s:.]*(?={_MARK}|\n)")
_TAG = re.compile(r"</?[A-Za-z][^<>]*+>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(\w)-\s*\n\s*([^\W\d_A-ZÀ-Þ])")
# Citations and speech end at their own marks, or at an empty line where those are lost.
_TEXT = r"[^{}\n]|\n(?!\s*\n)"
_CITED = re.compile(rf"\((?:s[ec][ec]|vgl|cf|v[gq]l)\b(?:{_TEXT.format('()')}|\((?:{_TEXT.format('()')})*+\))*+\)", re.I)
_SPEECH = re.compile(rf"[“„«](?:{_TEXT.format('“”„«»')})*+[”»“]|\"(?:{_TEXT.format(chr(34))})*+\"")
_PAGE_MARK = re.compile(r"(?:\b(?:page|seite) \d+(?: (?:of|von|sur) \d+[^\n.!?;]*)?|[–—-] ?\d+ ?[–—-]|\t\d+)[ \t]*(?=\n)", re.I)
_SENTENCE = re.compile(r"(?<!\b[A-Z])[.!?;]\s")


def _repaired(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte code page, where the whole text allows it line by line."""
    out = []
    for line in text.split("\n"):
        if "Ã" in line or "â€" in line or "Â" in line:
            try:
                line = line.encode("cp1252").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        out.append(line)
    return "\n".join(out)


def _near(word: str) -> str | None:
    """The heading that a misread word stands for: one letter different in short ones, two in long ones, or one letter more or less."""
    word = word.lower()
    for h in (*BODY, *CLOSE):
        if len(h) == 5 == len(word) and h[0] == word[0] and sum(a == b for a, b in zip(h, word)) == 4:
            return h
        if len(h) > 5 and abs(len(h) - len(word)) <= 1:
            same = sum(a == b for a, b in zip(h, word)), sum(a == b for a, b in zip(h[::-1], word[::-1]))
            if max(same) >= len(h) - 2 or (same[0] and sum(same) >= len(h) - 1):
                return h
    return None


def plain(text: str) -> str:
    """Without tags, entities, hidden characters and broken words; composed accents; \\n line ends."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    if "Ã" in text or "â€" in text or "Â" in text:
        text = _repaired(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _HIDDEN.sub("", text)).replace("\xa0", " ").replace(" ", " ")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _BROKEN.sub(r"\1\2", text) if "-" in text else text


def _without_pages(text: str) -> str:
    """Without page headers and footers: lines that end in a page number and hold no end of a sentence."""
    out, at = [], 0
    for m in _PAGE_MARK.finditer(text):
        line = text.rfind("\n", at, m.start())
        if line >= 0 and not _SENTENCE.search(text, line, m.start()):
            out.append(text[at:line])
            at = m.end()
    return "\n".join([*out, text[at:]])


def court_written(text: str | None) -> str:
    """What the court wrote between the first section heading and the order; nothing if there is no such text."""
    if not text:
        return ""
    text = plain(text)
    found = [(m.start(), m.end(), m[1].lower()) for m in _HEADING.finditer(text)]
    if len({w for _, _, w in found if w in BODY}) < 2:
        found += [(m.start(1), m.end(1), w) for m in _LOOSE.finditer(text) if (w := _near(m[1]))]
        found.sort()
    found = list(dict.fromkeys(found))
    last = max((i for i, (_, _, w) in enumerate(found) if w in BODY), default=None)
    if last is None:
        return ""
    first = next(i for i, (_, _, w) in enumerate(found) if w in BODY)
    starts = [s for s, _, _ in found[1:]] + [len(text)]
    text = "\n".join(text[found[i][1] : starts[i]] for i in range(first, last + 1))
    text = _without_pages(text)
    text = _CITED.sub(" ", text)
    return _SPEECH.sub(" ", text)
