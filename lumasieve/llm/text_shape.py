"""The quality statistics of one text, and what the characters of its lines look like.

Each line's characters go to one class: enumerated items, rows of fields or named values, matter no one would read, or
sentences. Lines that don't tell by themselves are judged together with their neighbours. All of a text is looked at.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

# What marks lines, items and sentences.
MARK = re.compile(r"\s*(?:[-*+•◦▪‣·–—]|\[[ xX✓]?\]|[☐☑✓]|\(?(?:\d{1,4}|[A-Za-z]|[ivxlc]{1,6})[.)]|[①-⑳])\s+(?=\S)")
CLOSERS = "\"'”’»」』)]"
ENDS = frozenset(".!?…。！？")
SENTENCE = re.compile(r"""[.!?…]["'”’»)\]]*(?=\s|$)|[。！？]""")
CJK = re.compile("[\u2e80-\u2fff\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
NOT_CJK = re.compile("[^\u2e80-\u2fff\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
MARKS = re.compile("[\u0300-\u036f]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|\d+")
NOT_ALNUM = re.compile(r"[\W_]+")
BLANKS = (" ", "\n", "\r", "\t", "\xa0", "\u3000")
TO_LETTERS = "".join(chr(c) if chr(c) in "abcdefghijklmnopqrstuvwxyz'" else " " for c in range(128))
TO_DIGITS = "".join(chr(c) if chr(c).isdigit() else " " for c in range(128))
NOT_ALNUM_ASCII = {c: None for c in range(128) if not chr(c).isalnum()}
#: What damaged text is full of: characters between ASCII and the accented letters, replacement, private and drawing characters.
ODD = re.compile("[^\x80-\xbf\ufffd\ue000-\uf8ff\u2190-\u2bff]+")
HEX_ROW = re.compile(r"\s*(?:[0-9a-fA-F]{4,8}:?\s+)?(?:[0-9a-fA-F]{2}\s+){6,}")
CODED = re.compile(r"[A-Za-z0-9+/=_%-]{24,}")
TAG = re.compile(r"<[^<>]+>|&#?\w{2,8};")
GAP = re.compile(r" {2,}|\t+")
TIGHT = re.compile(r"[,;](?=\S)")
LOOSE = re.compile(r"[,;、；，](?=\s)|、|；|\s[/|·•]\s|\s*[•·]\s+")
RULE = frozenset("-=_*~#+|:.")
NUMERIC = frozenset("0123456789.,:/%")
FILE_CHARS = re.compile(r"[\w.-]+")


def plain(text: str) -> str:
    """Lower case without accents, as case and accents of the texts vary."""
    text = text.lower()
    if text.isascii():
        return text
    return MARKS.sub("", unicodedata.normalize("NFD", text.replace("’", "'").replace("ß", "ss")))


def han_of(text: str) -> str:
    """The characters of scripts without spaces."""
    return "" if text.isascii() else NOT_CJK.sub("", text)


def words_of(text: str, han: str) -> list[str]:
    """The words of a text that ``plain`` made: runs of letters, with apostrophes inside, and of digits; in no order."""
    if text.isascii():
        letters = f" {text.translate(TO_LETTERS)} ".replace(" '", " ").replace("' ", " ")
        if "''" not in letters and " '" not in letters and "' " not in letters:
            return letters.split() + text.translate(TO_DIGITS).split()
    return WORD.findall(CJK.sub(" ", text) if han else text)


def n_words(s: str) -> float:
    """Words of a line; two characters of a script without spaces count as one."""
    han = han_of(s)
    return len(WORD.findall(CJK.sub(" ", s))) + len(han) / 2 if han else len(s.split())


def ends_sentence(s: str) -> bool:
    return s.rstrip().rstrip(CLOSERS)[-1:] in ENDS


def _is_name(s: str) -> bool:
    """Whether a field is a number, a dash for none, or a file name with a number in it."""
    if s in ("-", "—"):
        return True
    bare = s[1:] if s[:1] in ("-", "+") else s
    if NUMERIC.issuperset(bare):
        return any(map(str.isdigit, bare))
    stem, _, ending = s.rpartition(".")
    return 3 <= len(ending) <= 4 and ending.isascii() and ending.isalpha() and any(map(str.isdigit, stem)) and FILE_CHARS.fullmatch(stem) is not None


def _named(body: str) -> tuple[str, str] | None:
    """Name and value of a line 'name: value' or 'name = value'."""
    at = min((i for i in map(body.find, ":=：") if i >= 0), default=0)
    name, value = body[:at], body[at + 1 :]
    if not name or not value[:1].isspace():
        return None
    inside = value.strip()
    if not inside or (body[at] == "=" and not name[-1].isspace() and "\t" not in value[: value.index(inside[0])]):
        return None
    return name.strip(), inside


def _sentence(s: str) -> bool:
    """Whether an item is a sentence rather than a name."""
    words = n_words(s)
    return words >= 14 or (words >= 6 and ends_sentence(s))


def _cells(parts: list[str], most: int = 9, usual: float = 5) -> bool:
    """Whether parts look like fields: short, all of them."""
    sizes = [n_words(p) for p in parts if p and not p.isspace()]
    return bool(sizes) and max(sizes) <= most and sum(sizes) <= usual * len(sizes)


def _line(s: str) -> tuple[str, int, bool]:
    """Class of a line by itself, the number of its characters that aren't blank, and whether it is bare: of few words, and without the end of a sentence.

    The class is list, table, junk, gaps, tight, named or loose (fields or items in one line), mark (an item that is a sentence), or ''.
    """
    body = s.strip()
    tokens = body.split()
    solid = "".join(tokens)
    words = len(tokens) if body.isascii() else n_words(body)
    return _class(s, body, tokens, solid, len(solid)), len(solid), words <= 9 and not (words >= 6 and ends_sentence(body))


def _class(s: str, body: str, tokens: list[str], solid: str, n: int) -> str:
    plain_ascii = body.isascii()
    letters = len(solid.translate(NOT_ALNUM_ASCII) if plain_ascii else NOT_ALNUM.sub("", solid))
    if not letters and n >= 3 and RULE.issuperset(solid):
        return "rule" if not body.startswith(("+-", "|")) and "|" not in body else "table"
    if len(tokens) >= 6 and len(tokens[-1]) == 2 and HEX_ROW.match(s) and sum(len(t) == 2 for t in tokens) >= 6:
        return "junk"
    if body.startswith(("|", "+-")) or body.count("|") >= 2 or body.count("│") >= 2:
        return "table"
    if n >= 12:
        if letters < 0.4 * n:
            return "junk"
        if ("<" in body or "&" in body) and sum(map(len, TAG.findall(body))) > 0.4 * n:
            return "junk"
        if n >= 12 * len(tokens) and sum(map(len, CODED.findall(body))) > 0.5 * n and not _is_name(body):
            return "junk"
        if not plain_ascii and len(ODD.sub("", solid)) > 0.12 * n:
            return "junk"
    if "\t" in body and _cells(body.split("\t")):
        return "table"
    if (":" in body or "=" in body or "：" in body) and (m := _named(body)):
        if n_words(m[0]) <= 6 and n_words(m[1]) <= 6 and not _sentence(body):
            return "named"
    if len(tokens) >= 8 and tokens[0][0].isdigit() and sum(t.strip(",;").replace(".", "").isdigit() for t in tokens) >= 0.8 * len(tokens) and not GAP.search(body):
        return "junk"
    commas = body.count(",") + body.count(";")
    if commas >= 2:
        tight = commas - body.count(", ") - body.count("; ")
        if tight >= 2 and tight >= 0.8 * commas and len(cells := TIGHT.split(body)) > max(2, 0.8 * commas) and _cells(cells):
            return "tight"
    if m := MARK.match(s):
        return "mark" if _sentence(s[m.end() :]) else "list"
    if "  " in body:
        cells = GAP.split(body)
        if len(cells) >= 2 and _cells(cells) and ("   " in body or any(" " in c or _is_name(c) for c in cells)) and not ends_sentence(body):
            return "gaps"
    if commas >= 5 or " / " in body or " | " in body or (not plain_ascii and any(c in body for c in "、；，•·")):
        sentences = len(SENTENCE.findall(body))
        if sentences <= 0.15 * (commas + 1) or commas < 5:
            items = LOOSE.split(" ".join(tokens))
            if len(items) >= 6 and sentences <= 0.15 * len(items) and _cells(items, 12, 6.5):
                return "loose"
    return ""


def _itemised(run: list[str]) -> bool:
    """Whether bare lines are items of their own, rather than sentences broken at some width."""
    inner = sum(bool(SENTENCE.search(x.rstrip()[:-2])) for x in run)
    return sum(map(n_words, run)) <= 5.5 * len(run) and inner <= 0.1 * len(run)


#: Characters whose recurrence tells a period, and the number of periods tried.
GRAM, PERIODS = 8, 3
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(GRAM)], np.uint64)


def repeated(low: str, words: list[str], han: str) -> float:
    """Share of a text's characters that are the same one period before, for the best period of at most a third of the text; 0 without any.

    The periods tried are the commonest distances at which runs of GRAM characters recur, so a piece that comes with small changes is found too.
    """
    if not han and 20 * len(set(words)) > 9 * len(words):  # three copies of anything have at most a third of their words once
        return 0.0
    a = np.frombuffer(" ".join(low.split()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(a)
    if n < 60:
        return 0.0
    code = sum(a[k : n - GRAM + 1 + k] * _POWERS[k] for k in range(GRAM))
    order = np.argsort(code, kind="stable")
    gaps = np.diff(order)[code[order[1:]] == code[order[:-1]]]
    found = np.bincount(gaps[3 * gaps <= n])
    best = 0.0
    for p in np.argsort(found)[: -PERIODS - 1 : -1].tolist() if len(found) else []:
        if found[p]:
            best = max(best, float((a[p:] == a[:-p]).mean()))
    return best


@dataclass
class Vocabulary:
    """Common words by language, as ``plain`` gives them; for Chinese they are looked for among the characters."""

    words: dict[str, frozenset[str]]

    def __post_init__(self):
        self.spaced = sorted(k for k in self.words if k != "zh")
        self.any = frozenset().union(*(self.words[k] for k in self.spaced))

    def shares(self, words: list[str]) -> dict[str, float]:
        """The share of words that are common ones, by language."""
        common = [w for w in words if w in self.any]
        return {k: sum(map(self.words[k].__contains__, common)) / max(1, len(words)) for k in self.spaced}

    def share(self, words: list[str], han: str, lang: str) -> float:
        known = self.words[lang]
        if lang == "zh":
            return min(1.0, sum(han.count(w) * len(w) for w in known) / len(han)) if han else 0.0
        return sum(map(known.__contains__, words)) / len(words) if words else 0.0


def language(tag: str | None, words: list[str], han: str, common: Vocabulary) -> str:
    """The tag's language if it is a known one and the text doesn't speak for another, else the language of most common words."""
    if han and len(han) > sum(map(len, words)):
        return "zh" if "zh" in common.words else "other"
    shares = common.shares(words)
    tagged = (tag or "").strip().lower()[:2]
    best = max(shares, key=shares.get, default="other")
    if tagged in shares and shares[tagged] >= shares[best] - 0.1:
        return tagged
    return best


LETTERS = 27
EDGES = ".,;:!?()[]\"'/…"
_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, LETTERS)


def letter_runs(text: str) -> np.ndarray:
    """Numbers of the runs of three letters of a text that ``plain`` made; a word's edge counts as a letter, the middle one is none.

    Only words all of letters count, so that names of files and codes are no language.
    """
    words = " ".join([w for w in text.split() if w.isalpha() or w.strip(EDGES).isalpha()])
    code = _CODE[np.frombuffer(f" {words} ".encode("ascii", "replace"), np.uint8)]
    run = (code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:]
    return run[code[1:-1] > 0]


#: What a text's distance from prose is taken over; the last two of them, and no other, need a language.
STATISTICS = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "sentence_length", "short_lines", "repeated", "common_share", "letter_fit",
)
#: Shares of a text's characters by what their lines look like; inline_share, that of lines with many items each, is a part of list_share. They name
#: the shape of an outlier and don't make a text one.
EVIDENCE = ("list_share", "table_share", "junk_share", "inline_share")


#: letter_fit of a text without letters, and the number of runs that a text's own count against.
NO_LETTERS, PRIOR_RUNS = 0.0, 30


@dataclass
class Letters:
    """How often each run of three letters occurs in a language's different texts, and the average log probability of a run's last letter."""

    runs: np.ndarray

    def __post_init__(self):
        self.pairs = self.runs.reshape(-1, LETTERS).sum(1)
        at = np.flatnonzero(self.runs)
        logs = np.log((self.runs[at] + 0.5) / (self.pairs[at // LETTERS] + 0.5 * LETTERS))
        self.usual = float((logs * self.runs[at]).sum() / max(1, self.runs.sum()))

    def fit(self, run: np.ndarray, n: np.ndarray) -> float:
        """How much likelier than the average run a text's runs are, in log units a run, as the other texts tell: its own are taken out (copies were counted once).

        run, n: the different runs of the text and how often each occurs.
        """
        if not len(run):
            return NO_LETTERS
        own = np.bincount(run // LETTERS, weights=n, minlength=LETTERS**2)[run // LETTERS]
        others, pairs = np.maximum(self.runs[run] - n, 0), np.maximum(self.pairs[run // LETTERS] - own, 0)
        logs = np.log((others + 0.5) / (np.maximum(pairs, others) + 0.5 * LETTERS))
        return float(((logs - self.usual) * n).sum() / (n.sum() + PRIOR_RUNS))


def _shares(lines: list[str], blocks: list[int]) -> tuple[float, ...]:
    """EVIDENCE of a text's lines, and the share of its characters in bare lines. blocks: numbers of the lines that follow a blank one."""
    classes = [_line(x) for x in lines]
    kinds, weights, short = ([c[i] for c in classes] for i in range(3))
    # Lines between rows of aligned columns are rows too, with empty columns.
    for a, b in zip(blocks, [*blocks[1:], len(lines)]):
        rows = kinds[a:b].count("gaps")
        if rows >= 3 and rows >= 0.3 * (b - a):
            kinds[a:b] = ["table" if k in ("", "gaps", "list", "loose", "named", "rule") and n_words(x) <= 30 else k for k, x in zip(kinds[a:b], lines[a:b])]
    # Runs of bare lines are items, one to a line; so are fields and gaps that neighbours confirm.
    bare = [b and k in ("", "loose", "list", "rule") for k, b in zip(kinds, short)]
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and bare[j]:
            j += 1
        if j - i >= 4 and _itemised(lines[i:j]):
            for q in range(i, j):
                kinds[q] = kinds[q] if kinds[q] == "rule" else "list"
        i = max(j, i + 1)
    gaps, tight, named = (kinds.count(k) for k in ("gaps", "tight", "named"))
    stands_for = {
        "list": "list", "table": "table", "junk": "junk", "loose": "list", "gaps": "table" if gaps >= 3 else "prose", "tight": "table" if tight >= 2 else "list", "named": "table" if named >= 2 else "prose",
    }
    share = dict.fromkeys(("list", "table", "junk", "prose"), 0)
    for k, w in zip(kinds, weights):
        share[stands_for.get(k, "prose")] += w
    solid = max(1, sum(weights))
    inline, brief = (sum(w for w, x in zip(weights, is_) if x) for is_ in ([k == "loose" for k in kinds], short))
    return share["list"] / solid, share["table"] / solid, share["junk"] / solid, inline / solid, brief / solid


@dataclass
class Measured:
    """What one look at a text gives: STATISTICS but the last two, EVIDENCE, and what those two need."""

    n_words: int
    stats: list[float]
    evidence: list[float]
    words: list[str]
    han: str
    runs: np.ndarray


def measure(text: str) -> Measured:
    """The measures of a text that isn't blank, all of it, whatever its language."""
    low = plain(text)
    han = han_of(text)
    words = words_of(low, han)
    lines, blocks, blank_before = [], [], True
    for x in text.splitlines():
        blank = not x or x.isspace()
        if not blank:
            if blank_before:
                blocks.append(len(lines))
            lines.append(x)
        blank_before = blank
    *evidence, short = _shares(lines, blocks)
    n = len(words) + len(han)
    lengths = sum(map(len, words)) + len(han)
    solid = max(1, len(low) - sum(map(low.count, BLANKS)))
    stats = [
        float(np.log1p(n)), lengths / max(1, n), max(0, solid - lengths) / solid, sum(map(low.count, "0123456789")) / solid, sum(map(ends_sentence, lines)) / max(1, len(lines)),
        float(np.log1p(n / (1 + len(SENTENCE.findall(text))))), short, repeated(low, words, han),
    ]
    return Measured(n, stats, evidence, words, han, letter_runs(low))
