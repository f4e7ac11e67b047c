"""Problem 4: the noise of scanning and printing in the lines of scanned pages.

One averaged-perceptron editor decides everything: for each character of a word or a number to
keep, delete, replace it or to insert one after it, for two halves at a line's end to join or
not, and for a line at the edge of a page whether it is furniture. It is trained here, on
the commonest words of the scanned lines spoilt by a table of confusions, on numbers of sample pages
spoilt in the same way, and on edge lines of sample pages whose nature is beyond doubt.
Untrained, it keeps everything.

What it chooses among: a word's candidates are the known words of its class, that is, those that
become equal when everything that recognition confuses is written out in the same few
strokes (``level``); so a candidate may be any number of edits away. How much commoner the candidate is
than the word is one feature among those of the characters around each edit. Characters that no word has
are judged without a candidate too. Numbers see the tokens beside them. Edge lines see their
place, support in the report, confidence, shape, and their neighbours.

A letter that is lost without a trace has no candidate: an insertion is proposed where two letters
were read as one.

Scale. Pages go through Python one by one and come out as events; word types are
counted and meet by class, never on the driver. A class is gathered with its members, distinct
spellings of a few words. The driver trains on TRAIN_WORDS words and TRAIN_PAGES pages,
documented bounds; the model has that size too.

Edge cases. Copies of a line count once. Null or blank text has no defect. A page's last
line has no next line. Lines without line_order are dropped. Null confidence is a value of its own.
"""

from __future__ import annotations

import heapq
import math
import random
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import p1_boilerplate as p1
from pagewright.llm.perceptron import AveragedPerceptron
from pagewright.session import cut

TRAIN_WORDS = 2_000
TRAIN_PAGES = 600
EPOCHS = 3
SEED = 11
SURE_SHARE, SURE_PAGES = 30, 5  # percent and number of pages on which a line is furniture beyond doubt
LEAST_PAGES, LEAST_SHARE = 2, 8  # what support a line needs to be counted at all

# What was printed, and what recognition makes of it.
CONFUSIONS = (
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"), ("l", "!"), ("i", "|"), ("l", "|"), ("s", "5"), ("s", "$"), ("g", "9"),
    ("a", "@"), ("b", "6"), ("b", "8"), ("i", "l"), ("l", "i"), ("e", "c"), ("h", "b"), ("t", "f"), ("n", "ri"), ("u", "ii"),
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("li", "h"), ("g", "q"),
)
DIGIT_LIKE = "OolIiSsbBgZz|!DQ"
MARKS = "-‐‑¬­"
SURE_MARKS = "¬­"

_NUMBERISH = re.compile(r"(?<![a-z])[\dolisb|!]*\d[\dolisb|!.,]*(?![a-z])")
# Characters as strokes, such that the two sides of every confusion are written alike.
_STROKES = {"0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "5": "s", "$": "s", "9": "g", "q": "g", "@": "a", "e": "c", "f": "t", "6": "ll", "8": "ll", "b": "ll", "h": "ll", "u": "ll", "n": "rl", "m": "rrl", "d": "cl", "w": "vv"}
_LEVEL = str.maketrans({**_STROKES, " ": None, "\t": None, "\xa0": None, "\r": None})
_PAGE_NUMBER = re.compile(r"\W*(?:page|seite|p.gina|pag\.?|p\.|s\.)?\s*(\d{1,5})(?:\s*(?:of|von|de|sur|/)\s*\d+)?\W*", re.I)
_PERIODS = re.compile(r"(?:january|february|march|april|may|june|july|august|september|october|november|december)?\s*\d{4}(?:\s+\d{4})+", re.I)
_YEAR_LEFT = re.compile(r"[\dOolI]+[.,;]")  # the last word of a sentence
_ENDS = re.compile(r"[.,;:!?]\s*$")
_BREAK = re.compile(rf"([^\W\d_][\w!@$'’-]*)[{MARKS}]\s*$")
_HEAD = re.compile(r"\s*([\w!@$'’]+(?:-[\w!@$'’]+)*)")
_STRIP = ".,;:()[]{}\"“”'’‘«»—–?*•†‡¹²³™©®/"
_LETTERS = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SPOILT = re.compile(r"[\w!@$|'’]+")
_NUMBER = re.compile(rf"[\d{DIGIT_LIKE}]+(?:[.,][\d{DIGIT_LIKE}]+)*")
_LIKE = re.compile(rf"[{DIGIT_LIKE}]+")
_CODES = re.compile(r"(?:FY|CY|Q|H)\d+|[A-Z]{1,4}\d{1,3}|\d{1,3}[A-Z]|\d+(?:st|nd|rd|th)|\d+[xX]|[A-Z]{1,2}", re.U)
_PREFIXED = re.compile(r"(?:FY|CY|Q|H)(.+)|[A-Z]-(.+)")
_FIGURE = re.compile(r"\(?[$€£]?\d[\d.,]*%?\)?|—")
_BARE_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_SYMBOL = re.compile(r"[^\W\d_].*[0-9!@$|]|[0-9!@$|].*[^\W\d_]")


def level(text: str) -> str:
    """``text`` (lower-case) in strokes: equal for any two texts that recognition may confuse."""
    return text.translate(_LEVEL)


def skeleton(line: str) -> str:
    """``line`` in strokes, numbers masked."""
    return level(_NUMBERISH.sub("#", line.lower()))


def _skeleton_lines(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [skeleton(x) for x in t.split("\n")], na_action="ignore")


def skeleton_keys(text):
    """One key per line of ``text``, null for lines without content."""
    lines = F.pandas_udf(_skeleton_lines, "array<string>")(text)
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))


# Lines at the edges of a page. -----------------------------------------------------------------
class Page:
    """A page's filled lines, outermost features at hand.

    lines: (text, confidence) in order; support: percent of the report's pages and number of
    pages on which the line stands, or None; heading: whether it is a section heading.
    """

    def __init__(self, texts, confidence, support, heading, page_index):
        self.at = [i for i, t in enumerate(texts) if t.strip()]
        self.texts = [texts[i].strip() for i in self.at]
        self.support = [support[i] for i in self.at]
        self.heading = [heading[i] for i in self.at]
        self.confidence = [confidence[i] for i in self.at]
        self.numbered = [self._numbered(t, page_index) for t in self.texts]

    @staticmethod
    def _numbered(text, page_index) -> str:
        m = _PAGE_NUMBER.fullmatch(text)
        return "no" if m is None else "here" if int(m[1]) in (page_index, page_index + 1) else "other"

    def sure(self, i: int) -> bool:
        """Furniture beyond doubt."""
        if self.heading[i] or _PERIODS.fullmatch(self.texts[i]) or _YEAR_LEFT.fullmatch(self.texts[i]):
            return False
        s = self.support[i]
        return self.numbered[i] == "here" or (s is not None and s[0] >= SURE_SHARE and s[1] >= SURE_PAGES)

    def _strength(self, i: int) -> str:
        if not 0 <= i < len(self.texts):
            return "end"
        s = self.support[i]
        if self.numbered[i] == "here":
            return "number"
        if s is None:
            return "none"
        return f"{'few' if s[1] < 4 else 'some'}{'<15' if s[0] < 15 else '<30' if s[0] < 30 else '<60' if s[0] < 60 else '60'}"

    def features(self, i: int, step: int, before: str, depth: int) -> list[str]:
        """Of line ``i`` in a run that goes inwards by ``step``; ``before``: the label of the line further out."""
        t, own, inner, second = self.texts[i], self._strength(i), self._strength(i + step), self._strength(i + 2 * step)
        c = self.confidence[i]
        ends = "." if _ENDS.search(t) else "p" if _PERIODS.fullmatch(t) else "y" if _YEAR_LEFT.fullmatch(t) else "-"
        trust = "?" if c is None or c != c else "low" if c < 0.8 else "mid" if c < 0.93 else "high"
        kind = f"{'h' if self.heading[i] else ''}{ends}{self.numbered[i]}"
        d = f"{'top' if step > 0 else 'foot'}{min(depth, 4)}"
        return [
            f"f1{own}", f"f2{own}{kind}", f"f3{kind}", f"f4{own}{d}", f"f5{own}{before}", f"f6{own}{inner}", f"f7{own}{inner}{ends}{min(depth, 3)}",
            f"f8{trust}", f"f9{own}{trust}", f"fa{own}{min(len(t) // 20, 5)}", f"fb{own}{inner}{second}", f"fc{d}{before}", f"fd{own}{kind}{inner}", f"fe{ends}", f"ff{ends}{before}", "f",
        ]


FURNITURE = ["content", "furniture"]


def furniture(page: Page, total: int, model) -> list[bool]:
    """Which of a page's ``total`` lines the model labels furniture, going inwards from both ends until it says content."""
    out, n = [False] * total, len(page.texts)
    for step in (1, -1):
        before = "edge"
        for depth in range(n):
            i = depth if step > 0 else n - 1 - depth
            if model.best(page.features(i, step, before, depth), FURNITURE) != "furniture":
                break
            out[page.at[i]], before = True, "furniture"
    return out


def edge_examples(page: Page, rng) -> list[tuple]:
    """Labelled lines of a sample page: those beyond doubt, some of them as if they were rarer or spoilt."""
    out, n = [], len(page.texts)
    for step in (1, -1):
        before = "edge"
        for depth in range(n):
            i = depth if step > 0 else n - 1 - depth
            inner = i + step
            s, plain = page.support[i], not page.heading[i] and not _PERIODS.fullmatch(page.texts[i]) and not _YEAR_LEFT.fullmatch(page.texts[i])
            if page.sure(i):
                label = "furniture"
            elif page.heading[i] or not plain or s is None:
                spoilt = plain and not page.heading[i] and depth < 3 and 0 <= inner < n and page.sure(inner) and not _ENDS.search(page.texts[i]) and n > 2 * depth + 3
                label = "furniture" if spoilt else "content"
            elif s[0] >= 15 and s[1] >= 4:
                label = "furniture"
            elif s[0] < 15:
                label = "content"
            else:
                break
            # Years over columns and last words of sentences are rare on a sample, and never furniture.
            out += [(page.features(i, step, before, depth), FURNITURE, label)] * (1 if plain or page.heading[i] else 4)
            if not plain:  # however often it stands there
                for page.support[i] in ((20, 3), (40, 4), (70, 3), (70, 9)):
                    out += [(page.features(i, step, before, depth), FURNITURE, "content")]
                page.support[i] = s
            if label == "furniture" and s is not None and page.numbered[i] != "here" and rng.random() < 0.5:
                page.support[i] = (rng.choice([16, 25, 40]), rng.choice([4, 9]))
                out.append((page.features(i, step, before, depth), FURNITURE, label))
                page.support[i] = s
            if label == "content":
                break
            before = "furniture"
    return out


# Numbers. -------------------------------------------------------------------------------------
# Letters and signs that recognition takes digits for, and the digits.
LIKE_DIGIT = {"O": "0", "o": "0", "D": "0", "Q": "0", "l": "1", "I": "1", "i": "1", "!": "1", "|": "1", "S": "5", "s": "5", "b": "6", "B": "8", "g": "9", "Z": "2", "z": "2"}
# Tokens with letters or signs that are right as they stand, with the words before and after.
RIGHT = (
    ("1B", "Item", "Risk"), ("1A", "Item", "Risk"), ("9B.", "Item", "Other"), ("1B.", "ITEM", ""), ("2B", "Note", "to"), ("3D", "Note", ""), ("4S", "Section", "of"), ("8S", "Form", ""), ("10D", "Form", "for"), ("404th", "the", "time"), ("1st", "the", "day"), ("21st", "on", "of"),
    ("F-28", "", ""), ("S-1", "Form", "of"), ("B-2", "page", ""), ("FY18", "in", "was"), ("FY2018", "for", ""), ("Q3", "in", "of"), ("H1", "in", ""), ("CY19", "", ""), ("3x", "to", "the"), ("12x", "", ""), ("is", "4", "5"), ("is", "2010", "2011"), ("so", "5", "6"), ("is", "the", "of"), ("so", "and", "the"), ("is", "5", "the"),
    ("(b)", "", "Risk"), ("(b)", "", "plan"), ("(b)", "and", "the"), ("(i)", "", "the"), ("(s)", "", "of"), ("(l)", "", "the"), ("b", "", "Risk"), ("b.", "", "Risk"), ("(o)", "", "the"), ("(g)", "", "the"), ("i.", "", "the"), ("(B)", "", "the"), ("(D)", "", "the"), ("(ii)", "", "the"), ("ii.", "", "the"),
    ("I", "and", "am"), ("I", "Part", "of"), ("II", "Part", "Item"), ("I", "", "think"), ("|", "4", "5"), ("|", "", "5"), ("|", "Sales", "5"), ("I", "Class", "shares"), ("B", "Class", "shares"), ("B", "series", ""), ("S", "U", "A"), ("D", "series", ""), ("i", "(ii)", ""), ("o", "4", "5"), ("i", "4", "5"), ("Is", "5", "6"), ("ol", "5", "6"), ("os", "5", "6"), ("1s", "", ""), ("50s", "the", "and"), ("1990s", "the", ""), ("Bo", "and", "the"), ("Oslo", "in", "and"), ("Iss", "", ""), ("lol", "", ""), ("oil", "of", "and"), ("oil", "5", "6"), ("soil", "", ""), ("so", "", ""), ("DB", "by", "plan"), ("SOS", "", ""), ("IBS", "", ""), ("BS", "5", "6"),
)


def _near(token: str) -> str:
    return "" if not token else "fig" if _FIGURE.fullmatch(token) else token.lower().rstrip(".") if token.lower().rstrip(".") in ("item", "note", "form", "section", "article", "class", "part", "series", "the") else "word"


def core_of(token: str) -> tuple[str, str]:
    """The part of a token that may be a number, and what was before it: money, a code's letters, or nothing."""
    core = token.strip(_STRIP + "%")
    money = "$" if core[:1] in "$€£" else ""
    core = core.lstrip("$€£").strip(_STRIP)
    m = _PREFIXED.fullmatch(core)
    return (m[1] or m[2], "code") if m else (core, money)


def _shape(core: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", "".join("9" if c.isdigit() else "L" if c in LIKE_DIGIT else c for c in core))


def number_features(core: str, i: int, lead: str, before: str, after: str) -> list[str]:
    kinds = "".join("9" if c.isdigit() else "L" if c in LIKE_DIGIT else "." for c in f"..{core}..")
    c, shape = core[i], _shape(core)
    a, z = _near(before), _near(after)
    tail = core[i:] if i and core[:i].isdigit() else ""
    return [
        f"n1{c}", f"n2{kinds[i + 1 : i + 4]}", f"n3{c}{kinds[i : i + 5]}", f"n4{shape}", f"n5{shape}{a}{z}", f"n6{lead}{shape}", f"n7{shape}{a}{c}", f"n8{'9' in kinds}{lead}", f"n9{'9' in kinds}{a}{z}{len(core)}",
        f"na{tail.lower()}", f"nb{core}{a}{z}", f"nc{'9' in kinds}{len(core) > 6}{lead}", f"nd{a}{tail}", "n",
    ]


def number_candidate(core: str) -> bool:
    """Whether ``core`` has letters among digits, or only letters and signs that digits are read as."""
    return _NUMBER.fullmatch(core) is not None and any(c in LIKE_DIGIT for c in core) and (any(map(str.isdigit, core)) or len(core) <= 6)


def mend_number(token: str, before: str, after: str, model) -> str | None:
    """The number that was printed, if the model replaces a character of ``token``, else None."""
    core, lead = core_of(token)
    if not number_candidate(core):
        return None
    digits = any(map(str.isdigit, core))
    ops = [model.best(number_features(core, i, lead, before, after), ["K", f"R:{LIKE_DIGIT[c]}"]) if c in LIKE_DIGIT else "K" for i, c in enumerate(core)]
    if all(o == "K" for o in ops) or (not digits and any(o == "K" and c in LIKE_DIGIT for o, c in zip(ops, core))):
        return None
    out = "".join(o[2:] if o != "K" else c for o, c in zip(ops, core))
    return token.replace(core, out, 1)


def number_examples(numbers: list[tuple], rng) -> list[tuple]:
    """Characters of numbers that were spoilt, and of tokens that only look like it."""
    spoils: dict[str, list[str]] = {}
    for noisy, digit in LIKE_DIGIT.items():
        spoils.setdefault(digit, []).append(noisy)
    out = []

    def add(core, lead, before, after, truth):
        out.extend((number_features(core, i, lead, before, after), ["K", f"R:{LIKE_DIGIT[c]}"], truth[i]) for i, c in enumerate(core) if c in LIKE_DIGIT)

    for token, before, after in numbers:
        core, lead = core_of(token)
        places = [i for i, c in enumerate(core) if c in spoils]
        if not places or not _BARE_DIGITS.fullmatch(core):
            continue
        if len(places) <= 2 and len(core) == len(places) and not lead and not (_near(before) == "fig" and _near(after) in ("fig", "")):
            if len(places) == 1:
                continue  # one letter alone says nothing
        for k in {1, rng.choice([1, 1, 1, 2])}:
            chosen = rng.sample(places, min(k, len(places)))
            s = "".join(rng.choice(spoils[c]) if i in chosen else c for i, c in enumerate(core))
            if s in ("is", "so", "ol", "os", "Is", "o", "i", "|"):
                continue
            if len(core) > 2 or any(map(str.isdigit, s)) or (_near(before) == "fig"):
                add(s, lead, before, after, [f"R:{core[i]}" if i in chosen else "K" for i in range(len(core))])
    for token, before, after in RIGHT * max(1, len(out) // (8 * len(RIGHT))):
        core, lead = core_of(token)
        if number_candidate(core):
            add(core, lead, before, after, ["K"] * len(core))
    return out


def words_of(token: str) -> list[str]:
    """The lower-case words of a token, spoilt ones too; numbers and codes have none."""
    core = token.strip(_STRIP)
    if len(core) < 2 or not _LETTERS.search(core):
        return []
    out = []
    for part in re.split(r"[-/&–—]", core):
        part = part.strip(_STRIP)
        letters = sum(c.isalpha() for c in part)
        if letters < 2 or _CODES.fullmatch(part) or not _SPOILT.fullmatch(part) or 2 * letters < len(part):
            continue
        out.append(part.lower())
    if "-" in core and len(out) > 1:
        out.append(core.lower())
    return out


EVENTS = "doc_id string, page_index int, line_order int, kind string, word string, left_part string, right_part string, next_line int, mark string"


def read_pages(model):
    def run(batches):
        """The events of every page: furniture, number misreads, words, and halves at line ends."""
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for pdf in batches:
            rows = []
            for doc, index, lines, support, heading in zip(pdf.doc_id, pdf.page_index, pdf["lines"], pdf.support, pdf.heading):
                texts, orders = [x["text"] or "" for x in lines], [x["line_order"] for x in lines]
                gone = furniture(page_of(lines, support, heading, index), len(texts), model)
                following = [None] * len(texts)
                nxt = None
                for i in range(len(texts) - 1, -1, -1):
                    following[i] = nxt
                    if not gone[i] and texts[i].strip():
                        nxt = i
                headless = set()
                for i, text in enumerate(texts):
                    add = lambda kind, word=None, a=None, b=None, j=None, mark=None: rows.append((doc, index, orders[i], kind, word, a, b, j, mark))  # noqa: B023, E731
                    if gone[i]:
                        add("furniture")
                    tokens = text.split()
                    m = None if gone[i] or following[i] is None else _BREAK.search(text)
                    if m:
                        head = _HEAD.match(texts[following[i]])
                        if head and _LETTERS.search(head[1]):
                            add("break", None, m[1].strip(_STRIP), head[1], orders[following[i]], text.rstrip()[-1])
                            tokens = tokens[:-1]
                            headless.add(following[i])
                    if i in headless:
                        tokens = tokens[1:]
                    seen = set()
                    for k, token in enumerate(tokens):
                        mended = mend_number(token, tokens[k - 1] if k else "", tokens[k + 1] if k + 1 < len(tokens) else "", model)
                        if mended is not None:
                            add("number", token, mended)
                            continue
                        for w in words_of(token):
                            if w not in seen:
                                seen.add(w)
                                add("word", w)
            yield pd.DataFrame(rows, columns=names).astype({"next_line": "Int32"})

    return run


def page_of(lines, support, heading, index) -> Page:
    none = lambda s: None if s is None or s["share"] is None else (s["share"], s["pages"])
    return Page([x["text"] or "" for x in lines], [x["confidence"] for x in lines], [none(s) for s in support], list(heading), index)


# The editor. ---------------------------------------------------------------------------------
def _labels() -> tuple[dict, dict]:
    """Possible labels of each character (K keep, D delete, R:x replace by x), and of the gap after it (N nothing, I:x insert x)."""
    chars, gaps = {}, {}
    for clean, noisy in CONFUSIONS:
        chars.setdefault(noisy[0], set()).add(f"R:{clean[0]}")
        if len(clean) > len(noisy):
            gaps.setdefault(noisy[-1], set()).add(f"I:{clean[len(noisy):]}")
        for k, c in enumerate(noisy[1:], 1):
            chars.setdefault(c, set()).add(f"R:{clean[k]}" if k < len(clean) else "D")
    return {c: ["K", *sorted(x)] for c, x in chars.items()}, {c: ["N", *sorted(x)] for c, x in gaps.items()}


LABELS, GAPS = _labels()


def operations(noisy: str, clean: str) -> list[tuple[str, str]]:
    """(label of the character, label of the gap after it) for each character of ``noisy`` read for ``clean``."""
    both = min(len(noisy), len(clean))
    out = [("K" if noisy[k] == clean[k] else f"R:{clean[k]}", "N") for k in range(both)] + [("D", "N")] * (len(noisy) - both)
    return [*out[:-1], (out[-1][0], f"I:{clean[both:]}")] if len(clean) > both else out


def commoner(n: int, m: int | None) -> str:
    """How much commoner the candidate is than the word, in powers of two."""
    return "none" if m is None else str(min(10, int(math.log2(max(m, 1) / max(n, 1))))) if m >= n else "less"


def char_features(w: str, i: int, more: str) -> list[str]:
    p = f"##{w}##"
    a, b, c, d, e = p[i : i + 5]
    size = f"{min(len(w), 5)}{more}"
    alpha = f"{b.isalpha():d}{c.isalpha():d}{d.isalpha():d}"
    return [f"c{c}", f"m{b}{c}{d}", f"l{b}{c}", f"r{c}{d}", f"L{a}{b}{c}", f"R{c}{d}{e}", f"k{alpha}", f"q{size}", f"Q{size}", f"s{size}{alpha}", f"t{c}{more}", f"u{c.isalpha():d}{more}", "w"]


JOINS = ["A", "J"]  # apart, or joined


def join_features(a: str, b: str, mark: str, n_joined: int, n_apart: int) -> list[str]:
    a, b = a.lower(), b.lower()
    known = f"{min(n_joined, 3)}{min(n_apart, 3)}{(n_joined > n_apart) - (n_joined < n_apart)}"
    return [f"j1{a[-1:]}", f"j2{a[-2:]}", f"j3{a[-3:]}", f"j4{b[:1]}", f"j5{b[:2]}", f"j6{b[:3]}", f"j7{a[-1:]}{b[:1]}", f"j8{min(len(a), 5)}", f"j9{min(len(b), 5)}", f"ja{a}", f"jb{b}", f"jc{known}", f"jd{known}", f"je{known}", f"jf{mark in SURE_MARKS}", f"jg{mark in SURE_MARKS}{known}", "j"]


def align(w: str, c: str) -> list[tuple[int, str, str]] | None:
    """The edits (place in ``w``, noisy, clean) that make ``c`` of ``w``, fewest first; None if confusions can't."""
    todo, seen = [(0, 0, 0, ())], set()
    while todo:
        cost, i, j, edits = heapq.heappop(todo)
        if (i, j) in seen:
            continue
        seen.add((i, j))
        if i == len(w) and j == len(c):
            return list(edits)
        if i < len(w) and j < len(c) and w[i] == c[j]:
            heapq.heappush(todo, (cost, i + 1, j + 1, edits))
        for clean, noisy in _BY_NOISY.get(w[i : i + 1], ()):
            if w.startswith(noisy, i) and c.startswith(clean, j):
                heapq.heappush(todo, (cost + 1, i + len(noisy), j + len(clean), (*edits, (i, noisy, clean))))
    return None


_BY_NOISY: dict[str, list[tuple[str, str]]] = {}
for _clean, _noisy in CONFUSIONS:
    _BY_NOISY.setdefault(_noisy[0], []).append((_clean, _noisy))


def decisions(w: str, edits, more: str):
    """(features, labels, label) of every character and gap that ``edits`` change."""
    for i, noisy, clean in edits:
        for k, (op, gap) in enumerate(operations(noisy, clean)):
            c = noisy[k]
            if op != "K":
                yield char_features(w, i + k, more), LABELS[c], op
            if gap != "N":
                yield [f"g{f}" for f in char_features(w, i + k, more)], GAPS[c], gap


def gain(w: str, edits, more: str, model) -> float:
    """By how much the model prefers these edits to keeping every character."""
    total = 0.0
    for features, labels, label in decisions(w, edits, more):
        s = model.scores(features, labels)
        total += s[label] - s[labels[0]]
    return total


def apply(w: str, edits) -> str:
    out, at = [], 0
    for i, noisy, clean in sorted(edits):
        out += [w[at:i], clean]
        at = i + len(noisy)
    return "".join(out) + w[at:]


def repair(w: str, n: int, known, model) -> tuple[str, int] | None:
    """(correction, place of its first edit) of the word ``w`` seen ``n`` times, or None where the model keeps it.

    known: (word, count) of its class, commonest first. Without a candidate, characters that no word has may be
    replaced by themselves.
    """
    best = (0.0, 0, None)
    for c, m in known:
        if m <= n:
            break
        if c != w and c.isalpha():
            edits = align(w, c)
            g = gain(w, edits, commoner(n, m), model) if edits else 0.0
            if g > 0:
                best = max(best, (g, m, edits), key=lambda x: x[:2])
    if best[2] is None and _SYMBOL.search(w):
        edits = []
        for i, c in enumerate(w):
            if not c.isalpha():
                options = [(gain(w, [(i, noisy, clean)], "none", model), clean, noisy) for clean, noisy in _BY_NOISY.get(c, ())]
                good = max((o for o in options if o[0] > 0), default=None)
                if good:
                    edits.append((i, good[2], good[1]))
        if edits:
            best = (1.0, 0, edits)
    return None if best[2] is None else (apply(w, best[2]), min(i for i, _, _ in best[2]))


def word_examples(counted: list[tuple[str, int]], rng) -> list[tuple]:
    """Characters of common words, spoilt and sound, each with a likely count of its own."""
    classes: dict[str, list] = {}
    for w, n in counted:
        classes.setdefault(level(w), []).append((w, n))
    out = []
    for w, m in counted:
        mates = [(c, k) for c, k in classes[level(w)] if c != w and k > m]
        bold = 64 if len(w) <= 3 else 6
        if any(k >= bold * m for _, k in mates):
            continue  # may be spoilt itself
        # A sound word beside a commoner one that it could have been.
        for c, k in mates:
            edits = align(w, c)
            if edits:
                out += [(f, ls, ls[0]) for f, ls, _ in decisions(w, edits, commoner(m, k))] * 4
        options = [(i, noisy, clean) for clean, noisy in CONFUSIONS for i in range(len(w)) if w.startswith(clean, i)]
        for i, noisy, clean in rng.sample(options, min(8, len(options))):
            s = w[:i] + noisy + w[i + len(clean) :]
            edits = [(i, noisy, clean)]
            rare = max(1, m // (bold * 2 ** rng.randint(0, 6)))
            if m >= bold * rare and len(w) > 2:
                out += [(f, ls, label) for f, ls, label in decisions(s, edits, commoner(rare, m))]
            # The same without a candidate: only signs and digits give themselves away.
            sign = not all(map(str.isalpha, noisy))
            out += [(f, ls, label if sign else ls[0]) for f, ls, label in decisions(s, edits, "none")]
            # A word that is hardly commoner explains nothing, and less so in a short word.
            weak = rng.randint(0, 1 if len(w) > 3 else 4)
            if not sign:
                out += [(f, ls, ls[0]) for f, ls, _ in decisions(s, edits, str(weak))]
    return out


def join_examples(counted: list[tuple[str, int]], compounds: list[tuple[str, int]], rng) -> list[tuple]:
    out = []
    for w, n in counted:
        if len(w) >= 5:
            i = rng.randint(2, len(w) - 2)
            for k in {n, 0}:
                out.append((join_features(w[:i], w[i:], "-", k, 0), JOINS, "J"))
            out.append((join_features(w[:i], w[i:], rng.choice(SURE_MARKS), rng.choice([0, n]), rng.choice([0, 0, 1])), JOINS, "J"))
    for w, n in compounds:
        a, _, b = w.partition("-")
        out += [(join_features(a, b, "-", k, m), JOINS, "A") for k, m in ((0, n), (0, n), (max(0, n - 1), n))]
    return out


def train(words: list[tuple[str, int]], compounds: list[tuple[str, int]], pages: list[Page] = (), numbers: list[tuple] = (), seed: int = SEED) -> AveragedPerceptron:
    """The editor from common words and compounds with their counts, sample pages, and (number, before, after) of them."""
    rng, model = random.Random(seed), AveragedPerceptron()
    examples = word_examples(words, rng) + join_examples(words, compounds, rng) + number_examples(numbers, rng)
    for page in pages:
        examples += edge_examples(page, rng)
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        for features, labels, truth in examples:
            model.learn(features, labels, truth)
    return model.finish()


def repair_classes(model):
    def run(batches):
        for pdf in batches:
            rows = []
            for members in pdf.members:
                known = sorted(((x["word"], x["n"]) for x in members if x["n"] > 0), key=lambda x: (-x[1], x[0]))
                for x in members:
                    if "-" not in x["word"]:
                        r = repair(x["word"], x["n"], known, model)
                        if r:
                            rows.append((x["word"], *r))
            yield pd.DataFrame(rows, columns=["word", "correction", "place"])

    return run


def scanned_pages(ocr_lines: DataFrame, native_pages: DataFrame, headings: DataFrame, salts: int = p1.SALTS) -> DataFrame:
    """(doc_id, page_index, lines, support, heading): the lines of every scanned page with what is known of each."""
    row = F.struct("line_order", "text", ("confidence" if "confidence" in ocr_lines.columns else F.lit(None).cast("double").alias("confidence")))
    lines = ocr_lines.where("doc_id is not null and page_index is not null and line_order is not null")
    pages = lines.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_set(row)).alias("lines"))
    # The first text of a line number; copies fell together in the set.
    pages = pages.withColumn("lines", F.filter("lines", lambda x, i: (i == 0) | (x["line_order"] != F.get("lines", i - 1)["line_order"])))
    scanned = lines.select("doc_id").distinct()
    keys = cut(p1.page_keys(native_pages.join(scanned, "doc_id", "left_semi"), skeleton_keys))
    nodes = p1.supported_nodes(keys, LEAST_PAGES, LEAST_SHARE)
    share = F.struct((F.col("support") * 100 / F.col("pages")).cast("int").alias("share"), F.col("support").cast("int").alias("pages"))
    kept = cut(nodes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line_key", share))).alias("kept")))
    # Merged, not broadcast: Spark's estimate of a report's list misses its copies.
    spread = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    titles = (
        headings.where("heading_text is not null")
        .select("doc_id", "page_index", F.explode(skeleton_keys(F.col("heading_text"))).alias("k"))
        .groupBy("doc_id", "page_index")
        .agg(F.collect_set("k").alias("titles"))
    )
    text = F.array_join(F.transform("lines", lambda x: F.translate(F.coalesce(x["text"], F.lit("")), "\n", " ")), "\n")
    df = pages.withColumn("k", skeleton_keys(text)).withColumn("salt", F.pmod(F.col("page_index"), F.lit(salts)))
    df = df.join(spread, ["doc_id", "salt"], "left").join(titles, ["doc_id", "page_index"], "left")
    support = F.transform("k", lambda k: F.when(k.isNotNull(), F.element_at("kept", k)))
    heading = F.transform("k", lambda k: F.coalesce(F.array_contains("titles", k), F.lit(False)))
    return df.select("doc_id", "page_index", "lines", support.alias("support"), heading.alias("heading"))


def sample(pages: DataFrame) -> tuple[list[Page], list[tuple]]:
    """TRAIN_PAGES pages in the order of a hash, and the numbers on them with the tokens beside them.

    Only about four times as many pages are ordered, so that tasks send few of them to the driver.
    """
    among = max(1, pages.count() // (4 * TRAIN_PAGES))
    rows = pages.where(F.pmod(F.xxhash64("page_index", "doc_id"), F.lit(among)) == 0).orderBy(F.xxhash64("doc_id", "page_index"), "doc_id", "page_index").limit(TRAIN_PAGES).collect()
    numbers = []
    for r in rows:
        for x in r["lines"]:
            t = (x["text"] or "").split()
            numbers += [(t[k], t[k - 1] if k else "", t[k + 1] if k + 1 < len(t) else "") for k in range(len(t)) if _BARE_DIGITS.fullmatch(core_of(t[k])[0])]
    return [page_of(r["lines"], r["support"], r["heading"], r["page_index"]) for r in rows], numbers


def commonest(counts: DataFrame, k: int) -> list[tuple[str, int]]:
    """The ``k`` commonest of ``counts`` (word, n). A histogram of n in powers of two tells which words are ordered at all."""
    sizes = sorted(((r.p, r["count"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()), reverse=True)
    least, held = 0, 0
    for p, n in sizes:
        least, held = p, held + n
        if held >= k:
            break
    return [(r[0], r[1]) for r in counts.where(F.col("n") >= 2**least).orderBy(F.desc("n"), "word").limit(k).collect()]


def analyse(ocr_lines: DataFrame, native_pages: DataFrame, headings: DataFrame, untrained: bool = False):
    """(pages, events, breaks, corrections): cut frames that the results are made of.

    breaks: (doc_id, page_index, line_order, next_line, left_part, right_part, joined, is_break).
    ``untrained``: with an editor that has learned nothing, to show what it decides.
    """
    pages = cut(scanned_pages(ocr_lines, native_pages, headings))
    seen = cut(pages.select(F.explode("lines").alias("x")).select(F.explode(F.split(F.lower("x.text"), r"[\s.,;:()]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    top = lambda pattern, k: commonest(seen.where(F.col("word").rlike(pattern)), k)
    model = AveragedPerceptron() if untrained else train(top(r"^\p{L}{3,}$", TRAIN_WORDS), [x for x in top(r"^\p{L}+-[\p{L}-]+$", TRAIN_WORDS // 4) if x[1] > 1], *sample(pages))
    ev = cut(pages.mapInPandas(read_pages(model), EVENTS))
    counts = cut(ev.where("kind = 'word'").groupBy("word").agg(F.count("*").alias("n")))
    halves = ev.where("kind = 'break'").select("doc_id", "page_index", "line_order", "next_line", "left_part", "right_part", "mark")
    halves = cut(halves.withColumn("joined", F.lower(F.concat("left_part", "right_part"))).withColumn("hyphened", F.lower(F.concat_ws("-", "left_part", "right_part"))))
    # Joined halves are judged as types of their own; those that no line has whole count 0.
    joined = halves.select(F.col("joined").alias("word")).distinct().join(counts, "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))
    stroke = F.pandas_udf(lambda w: w.map(level), "string")
    classes = counts.unionByName(joined).withColumn("class", stroke("word")).groupBy("class").agg(F.collect_list(F.struct("word", "n")).alias("members"))
    lone = F.col("members")[0]["word"].rlike(r"^\p{L}+$|-")
    wrong = cut(classes.where((F.size("members") > 1) | ~lone).select("members").mapInPandas(repair_classes(model), "word string, correction string, place int"))
    c = lambda key, n: counts.select(F.col("word").alias(key), F.col("n").alias(n))
    # A half that was misread counts as what it should have been.
    h = halves.join(wrong.select(F.col("word").alias("joined"), F.lower("correction").alias("right")), "joined", "left").withColumn("whole", F.coalesce("right", "joined"))
    h = h.join(c("whole", "n_joined"), "whole", "left").join(c("hyphened", "n_hyphened"), "hyphened", "left")

    def joins(a: pd.Series, b: pd.Series, mark: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([model.best(join_features(*x), JOINS) == "J" for x in zip(a, b, mark, n, m)], dtype=bool)

    nj, nh = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_hyphened", F.lit(0))
    is_break = F.pandas_udf(joins, "boolean")("left_part", "right_part", "mark", nj, nh)
    return pages, ev, cut(h.withColumn("is_break", is_break).select("doc_id", "page_index", "line_order", "next_line", "left_part", "right_part", "joined", "is_break")), wrong


def on_words(ev: DataFrame, of_words: DataFrame, salts: int = p1.SALTS) -> DataFrame:
    """The word events that ``of_words`` has; a word that stands in very many lines is spread over ``salts`` tasks."""
    events = ev.where("kind = 'word'").select("doc_id", "page_index", "line_order", "word").withColumn("salt", F.pmod("page_index", F.lit(salts)))
    return events.join(of_words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["word", "salt"]).drop("salt")


def found(ocr_lines: DataFrame, native_pages: DataFrame, headings: DataFrame, untrained: bool = False) -> DataFrame:
    """(doc_id, page_index, line_order, defect) as TESTDATA.md defines it."""
    _, ev, breaks, wrong = analyse(ocr_lines, native_pages, headings, untrained)
    row = lambda df, line, defect: df.select("doc_id", "page_index", line.alias("line_order"), F.lit(defect).alias("defect"))
    whole = on_words(ev, wrong)
    split = breaks.where("is_break").join(wrong.withColumnRenamed("word", "joined"), "joined")
    line = F.when(F.col("place") < F.length("left_part"), F.col("line_order")).otherwise(F.col("next_line"))
    return (
        row(ev.where("kind = 'furniture'"), F.col("line_order"), "furniture")
        .unionByName(row(breaks.where("is_break"), F.col("line_order"), "hyphen_break"))
        .unionByName(row(ev.where("kind = 'number'"), F.col("line_order"), "misread"))
        .unionByName(row(whole, F.col("line_order"), "misread"))
        .unionByName(row(split, line, "misread"))
        .distinct()
    )


# Repair. -------------------------------------------------------------------------------------
REPAIRED = "doc_id string, page_index int, text string"


def _like(correction: str, printed: str) -> str:
    """``correction`` in the case of ``printed``."""
    letters = [c for c in printed if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return correction.upper()
    return correction[:1].upper() + correction[1:] if printed[:1].isupper() else correction


def _mend_token(token: str, words: dict[str, str], numbers: dict[str, str]) -> str:
    if token in numbers:
        return numbers[token]
    core = token.strip(_STRIP)
    parts = [(_like(words[p.lower()], p) if p.lower() in words else p) for p in re.split(r"([-/&–—])", core)]
    return token.replace(core, "".join(parts), 1) if core else token


def _mend_pages(batches):
    for pdf in batches:
        out = []
        for row in pdf.itertuples():
            gone = set() if row.furniture is None else set(row.furniture)
            joins = {} if row.breaks is None else {b["line_order"]: b for b in row.breaks}
            words = {} if row.words is None else {w["word"]: w["correction"] for w in row.words}
            numbers = {} if row.numbers is None else {x["word"]: x["left_part"] for x in row.numbers}
            lines = [(x["line_order"], x["text"] or "") for x in row.lines if x["line_order"] not in gone]
            width = max((len(t) for _, t in lines), default=0)
            paragraphs, open_, skip = [], "", None
            for order, text in lines:
                s = text.strip()
                tokens = s.split()
                if skip is not None and tokens:
                    # The first word went to the line before; what follows its letters stays.
                    tail = tokens[0][len(skip) :] if tokens[0].startswith(skip) else ""
                    tokens = tokens[1:]
                    open_ += tail
                    skip = None
                if not s:
                    paragraphs.append(open_)
                    open_ = ""
                    continue
                b = joins.get(order)
                half = tokens.pop() if b and tokens else None
                mended = " ".join(_mend_token(t, words, numbers) for t in tokens)
                apart = _ENTRY_OR_ROW.search(s) is not None
                if apart and open_:
                    paragraphs.append(open_)
                    open_ = ""
                open_ = f"{open_} {mended}".strip()
                if half is not None:
                    lead = half[: half.lower().find(b["left_part"].lower())] if b["left_part"].lower() in half.lower() else ""
                    whole = b["left_part"] + b["right_part"]
                    whole = _like(b["correction"], whole) if b["correction"] else whole
                    open_, skip = f"{open_} {lead}{whole}".strip(), b["right_part"]
                elif apart or (_ENDS.search(s) and len(s) < 0.7 * width):
                    paragraphs.append(open_)
                    open_ = ""
            paragraphs.append(open_)
            out.append((row.doc_id, row.page_index, "\n\n".join(p for p in paragraphs if p)))
        yield pd.DataFrame(out, columns=["doc_id", "page_index", "text"])


_ENTRY_OR_ROW = re.compile(r"^(?:[•*▪–-]|\(?[a-z0-9]{1,2}[.)])\s|(?:[\s|](?:\(?[$€£]?\d[\d.,]*%?\)?|—)){2,}\s*$")


def repaired(ocr_lines: DataFrame, native_pages: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): every scanned page as paragraphs, without furniture, halves
    joined, misread words and numbers put right where the right form is known."""
    pages, ev, breaks, wrong = analyse(ocr_lines, native_pages, headings)
    page = ["doc_id", "page_index"]
    pages = pages.select(*page, "lines")
    known = wrong.where("correction is not null").select("word", "correction")
    words = on_words(ev, known).groupBy(*page).agg(F.collect_set(F.struct("word", "correction")).alias("words"))
    joined = breaks.where("is_break").join(known.withColumnRenamed("word", "joined"), "joined", "left")
    joined = joined.groupBy(*page).agg(F.collect_list(F.struct("line_order", "left_part", "right_part", "correction")).alias("breaks"))
    other = ev.groupBy(*page).agg(F.collect_set(F.when(F.col("kind") == "furniture", F.col("line_order"))).alias("furniture"), F.collect_set(F.when(F.col("kind") == "number", F.struct("word", "left_part"))).alias("numbers"))
    df = pages.join(other, page, "left").join(words, page, "left").join(joined, page, "left")
    return df.mapInPandas(_mend_pages, REPAIRED)
