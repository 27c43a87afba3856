"""Reading subtitle files: the spoken text with every character still at its place.

``spoken`` blanks out whatever is not speech (numbers and times of cues, headers, markup, sound
descriptions, adverts, lines shown again by the next cue) with as many blanks, so positions in the result
are positions in the text. ``CUE`` stands where a cue begins, ``TURN`` where a dash or a speaker's name
says that somebody begins to speak.
"""

from __future__ import annotations

import re
from bisect import bisect_right

CUE, TURN = "\x1e", "\x02"

# ---------------------------------------------------------------- encodings

_CP1252 = {}
for _b in range(0x80, 0x100):
    try:
        _CP1252[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        pass
    _CP1252.setdefault(chr(_b), _b)
_RUN = re.compile("[" + "".join(re.escape(c) for c in _CP1252) + "]{2,}")
_LEAD = re.compile("[\u00c2-\u00f4][" + "".join(re.escape(c) for c, b in _CP1252.items() if b < 0xC0) + "]")
_HIGH = re.compile("[\u00c0-\u00ff\u00a8\u00b8]")
_LETTER = re.compile(r"[^\W\d_]")
_TO_1251 = {}
for _c, _b in _CP1252.items():
    try:
        _TO_1251[ord(_c)] = bytes([_b]).decode("cp1251")
    except UnicodeDecodeError:
        pass


class Positions:
    """Maps positions of repaired text to the last stored character they came from."""

    def __init__(self, cuts: list[tuple[int, int, list[int]]]):
        self.at = [c[0] for c in cuts]
        self.cuts = cuts

    def last(self, i: int) -> int:
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i
        start, stored_end, ends = self.cuts[k]
        j = i - start
        return ends[j] if j < len(ends) else stored_end + (j - len(ends))


class Chain:
    """Positions after several repairs, the last one first."""

    def __init__(self, maps: list[Positions]):
        self.maps = maps

    def last(self, i: int) -> int:
        for m in reversed(self.maps):
            i = m.last(i)
        return i


def _as_utf8(text: str, otherwise_1251: bool) -> tuple[str, Positions | None]:
    """Decode runs of letters that are UTF-8 read as Windows-1252; other runs are left, or read as
    Windows-1251."""
    out, cuts, at, n = [], [], 0, 0
    for m in _RUN.finditer(text):
        try:
            if not _LEAD.search(m[0]):
                continue
            fixed = bytes([_CP1252[c] for c in m[0]]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        before = text[at : m.start()]
        out.append(before.translate(_TO_1251) if otherwise_1251 else before)
        n += m.start() - at
        ends, p = [], m.start()
        for c in fixed:
            p += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            ends.append(p - 1)
        cuts.append((n, m.end(), ends))
        out.append(fixed)
        n += len(fixed)
        at = m.end()
    rest = text[at:]
    out.append(rest.translate(_TO_1251) if otherwise_1251 else rest)
    return "".join(out), Positions(cuts) if cuts else None


def repair(text: str) -> tuple[str, Positions | Chain | None]:
    """Undo wrong decodings, also repeated ones: UTF-8 read as Windows-1252 (positions change) and
    Windows-1251 read as Windows-1252 (they don't). What doesn't decode cleanly is left as it is."""
    maps = []
    for _ in range(3):
        if text.isascii() or not (high := len(_HIGH.findall(text))):
            break
        lead = len(_LEAD.findall(text))
        cyrillic = high > 20 and 2 * lead < high and high > 0.5 * len(_LETTER.findall(text))
        if not lead and not cyrillic:
            break
        text, where = _as_utf8(text, cyrillic) if lead else (text.translate(_TO_1251), None)
        if where is not None:
            maps.append(where)
        elif not cyrillic:
            break
    return text, None if not maps else maps[0] if len(maps) == 1 else Chain(maps)


# ---------------------------------------------------------------- what is not speech

_TIMES = re.compile(r"^(?:\ufeff?[ \t]*-?\d+[ \t]*\r?\n)?\ufeff?[ \t]*\d{1,3}:\d\d:\d\d[.,]\d+[ \t]*-{1,2}>[^\n]*|^\ufeff?WEBVTT[^\n]*", re.M)
# Noise ends within its cue or line, however long it is.
_NOISE = re.compile(
    r"\{[^{}\n\x1e]*\}|<[^<>\x1e]*>|\[[^\[\]\x1e]*\]|\([^()\x1e]*\)|（[^（）\x1e]*）|【[^【】\x1e]*】|\*\*[^\n\x1e]*?\*\*|\*[^*\n\x1e]*\*|♪[^♪\n\x1e]*♪|♪|��|� [^�\n\x1e.!?…]+ �|﻿"
)
# Adverts and credits are told by their line as a whole: an address makes up most of it; an address, a
# coupon or the like stands with words of promotion; or it has the form of a credit, a word of credit with a
# colon or "by" and a name. No single word is a sign.
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]*@[\w-]{2,}(?:\.\w+)*|(?<![\w.])(?:[\w-]+\.)+(?:example|com|net|org|info|tv|io|me|co|cc|to|xyz|online|club|ru|de|fr|es|in|cn|jp)\b(?:/\S*)?|\b\w+ (?:d o t|dot) \w{2,}|\bcode ?: ?\w+|\b\w+-(?:subs|crew)\b", re.I)
# Words of credit, words that join a name to them, words of promotion.
_CREDIT_WORD = (
    r"sub(?:title|bing|titled)?s?|caption(?:s|ed|ing)?|translat(?:ed|ion)|sync(?:ed|hronized)?|correct(?:ed|ions?)|encoded|ripped|transcri(?:bed|ption)|timing|untertitel|übersetzung|subtítulos|traducción|sous-titres|traduction|субтитры|перевод|उपशीर्षक|अनुवाद|"
    r"ترجمة|แปล|คำบรรยาย|字幕组?|字幕組"
)
_CREDIT = re.compile(rf"[\W_]*(?:{_CREDIT_WORD})(?: ?(?:&|and|y|et|und|и) (?:{_CREDIT_WORD}))?(?P<by> ?[:：]|(?: sponsored| provided)? (?:by|von|por|par|pour|от)\b|โดย|(?<=组)|(?<=組))(?P<name>.*)", re.I)
_PROMOTION = re.compile(
    r"\bvisit\b|for more|\bcasino\b|\bdownload|\bfree\b|\bvip\b|\brate this\b|support us|advertise|corrections|\bsync\b|re-?upload|sponsored|\bencoded\b|\bripped\b|release group|subscribe|follow us|síguenos|abonnez|подпис|扫码|加入|出品|関注|チャンネル登録|ติดตาม|اشترك|सब्सक्राइब", re.I
)
# Lines without one of these are no adverts, so they need no closer look.
_SIGNS = ("@", "www.", "http", "d o t", " dot ", "-subs", "-crew", "code", "subti", "subbi", "subs", "capti", "transl", "sync", "correct", "encod", "ripp", "transcri", "timing", "untert", "überset", "subtít", "traduc", "sous-t", "субт", "перевод", "उपशीर्षक", "अनुवाद", "ترجمة", "แปล", "คำบรรยาย", "字幕")
_DOTTED = re.compile(r"(?<=\w)\.(?=[a-z]{2})")
_QUOTE = "\"“”„«»‘’‚‹›「」『』"
_NAME = re.compile(r"(?:^|[\s\x1e])((?:>> ?)?[^\s:：.!?…,;，。！？、؟।\"“”„«»‘‚‹›「」『』\x1e\x02]{2,40}[\u00a0\u202f ]?)\Z")
_DASH = re.compile(r"[\n\x1e] *(?:(?:-|–|—|>>) ?)+")
_COLON = re.compile(r"[:：]")
_SPEECH = re.compile(r"\s*[" + _QUOTE + r"]|(?<!>)\s*�")


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def _cue(m: re.Match) -> str:
    return CUE + " " * (len(m[0]) - 1)


def _turn(m: re.Match) -> str:
    return m[0][0] + TURN + " " * (len(m[0]) - 2)


def _without_names(s: str) -> str:
    """Speakers' names, each with its colon, become turns. A colon that introduces quoted speech stays."""
    out, at = [], 0
    for m in _COLON.finditer(s):
        p = m.start()
        n = _NAME.search(s, max(at, p - 45), p)
        if n is None:
            continue
        marked = n[1].startswith(">>")
        if not marked and n[1][0].islower():
            continue
        if not marked and (_SPEECH.match(s, p + 1) or not (s[p + 1 : p + 2].isspace() or s[p - 1] >= "\u0e00" or TURN in s[max(0, n.start() - 3) : n.start() + 1])):
            continue
        out += (s[at : n.start(1)], TURN, " " * (p - n.start(1)))
        at = p + 1
    return "".join(out) + s[at:] if at else s


def _is_advert(line: str) -> bool:
    found = [m[0] for m in _ADDRESS.finditer(line)]
    if found and 5 * len("".join(found)) > 3 * len(line):
        return True
    if found and _PROMOTION.search(line):
        return True
    m = _CREDIT.match(line)
    if m is None:
        return False
    # what is credited is a name, at once after "by", somewhere after a colon; in scripts without case any words
    words = m["name"].split()
    named = any(not w[:1].islower() for w in words) if m["by"].strip() in (":", "：") else words and not words[0][:1].islower()
    return bool(named) and len(words) <= 8


def _without_adverts(s: str) -> str:
    low = s.lower()
    if len(low) != len(s):
        low = s
    spans = set()
    for sign in _SIGNS:
        p = low.find(sign)
        while p >= 0:
            a, b = max(s.rfind("\n", 0, p), s.rfind(CUE, 0, p)) + 1, s.find("\n", p)
            spans.add((a, len(s) if b < 0 else b))
            p = low.find(sign, len(s) if b < 0 else b)
    if "." in low:
        spans |= {(max(s.rfind("\n", 0, m.start()), s.rfind(CUE, 0, m.start())) + 1, b if (b := s.find("\n", m.end())) >= 0 else len(s)) for m in _DOTTED.finditer(low)}
    for a, b in spans:
        if _is_advert(s[a:b].strip()):
            s = s[:a] + " " * (b - a) + s[b:]
    return s


def spoken(text: str) -> str:
    s = _TIMES.sub(_cue, text.replace("\r", " "))
    s = _NOISE.sub(_blank, s)
    s = _without_adverts(s)
    s = _DASH.sub(_turn, s)
    s = _shown_again(s)
    return _without_names(s)


def _shown_again(s: str) -> str:
    """Blank the lines at the start of a cue that repeat the last lines of the cue before."""
    before: list[str] = []
    out, at = [], 0
    begin = s.find(CUE)
    while begin >= 0:
        end = s.find(CUE, begin + 1)
        lines = s[begin + 1 : end if end >= 0 else len(s)].split("\n")
        now = [x.strip(" \x02") for x in lines]
        now = [x for x in now if x]
        k = 0
        if before and now:
            for n in range(min(len(before), len(now)), 0, -1):
                if now[:n] == before[-n:]:
                    k = n
                    break
        if k:
            p, left = begin + 1, k
            for x in lines:
                if left and x.strip(" \x02"):
                    out += (s[at:p], " " * len(x))
                    at = p + len(x)
                    left -= 1
                p += len(x) + 1
            now = now[k:] or now
        if now:
            before = now
        begin = end
    return "".join(out) + s[at:] if at else s
