"""Canonical forms of short factual records: figures, months, names, negations and ordinary words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from functools import lru_cache

#: Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NEGATIONS = frozenset(("not", "no", "never", "none", "nor", "neither", "cannot", "without", "nobody", "nothing", "nowhere", "hardly", "barely"))
#: Words without bearing on what is stated.
EMPTY = frozenset(
    "a an the this that these those any also and or but of in on at to for from by with as is was were be been being are has have had "
    "it its do does did so then there here very just quite rather really actually indeed still our we you they he she "
    "according note notes nb claim source checked last most recently edit unknown see appendix dev test train".split()
) - frozenset(("test", "train"))
#: Words of equal meaning in such records, by their common form.
SAME = {
    "whilst": "while", "occupies": "occupy", "takes": "take", "uses": "occupy", "verified": "confirm", "confirmed": "confirm",
    "attested": "confirm", "checked": "confirm", "operational": "work", "working": "work", "active": "active", "crew": "group",
    "team": "group", "unit": "group", "squad": "group", "group": "group", "relocated": "move", "moved": "move", "shifted": "move",
    "trial": "test", "trials": "test", "tests": "test", "completes": "finish", "finishes": "finish", "completed": "finish",
    "finished": "finish", "every": "all", "each": "all", "all": "all", "sites": "site", "agree": "agree", "concur": "agree",
    "say": "agree", "same": "agree", "storage": "space", "starting": "start", "starts": "start", "requires": "need", "needs": "need",
    "older": "old", "reviewed": "review", "inspected": "review", "examined": "review", "gray": "grey", "meters": "metres",
}
COMMON = frozenset(SAME.values())
_HOMOGLYPHS = str.maketrans(
    "аеосрхуіјѕԁһԛѡАВЕКМНОРСТХУІЈЅ" + "αορνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeocpxyijsdhqwABEKMHOPCTXYIJS" + "aopviktuxABEZHIKMNOPTYX",
)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_ASIDE = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]")
_TOKEN = re.compile(r"\d+(?:[,'’   ]\d{3})+(?!\d)|\d+(?:\.\d+)?|[^\W\d_]+")
_NO_FIGURE = re.compile(r"[^\d.]")
_STOP = re.compile(r"[.!?:]")
_LISTED = re.compile(r"^(?:[\s>#*+\-•]+|\(?\d{1,2}[.)]\s+|[A-Za-z][.)]\s+)+")


def plain(text: str) -> str:
    """The text without mark-up, entities, invisible characters, accents and look-alike letters."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(_HOMOGLYPHS)
    text = _LISTED.sub("", text.replace("*", "").replace("`", ""))
    return _ASIDE.sub(lambda m: " " if len((m[1] or m[2] or "").split()) <= 4 else m[0], text) if "(" in text or "[" in text else text


def tokens(text: str) -> tuple[list[tuple[str, bool | None]], bool]:
    """((token, capital) ...) and whether the letter case of the text can be trusted; capital is None for a capital that opens a sentence."""
    clean = plain(text)
    out: list[tuple[str, bool | None]] = []
    low = caps = odd = 0
    end = 0
    for m in _TOKEN.finditer(clean):
        w = m[0]
        before, end = end, m.end()
        if w[0].isdigit():
            out.append((_NO_FIGURE.sub("", w), False))
        elif w.islower():
            low += 1
            out.append((w, False))
        elif w[0].isupper():
            if len(w) == 1 or w[1:].islower():
                caps += 1
            elif len(w) > 3:
                odd += 1
            out.append((w.lower(), None if not out or _STOP.search(clean, before, m.start()) else True))
        else:
            odd += len(w) > 3
            out.append((w.lower(), False))
    return out, low > caps and caps > 0 and odd == 0


def near(a: str, b: str, k: int) -> bool:
    """Whether at most k insertions, deletions, substitutions or swaps of neighbours lead from a to b.

    Dynamic programming over a band of 2k + 1 cells, after what both begin and end with is set aside.
    """
    if a == b:
        return True
    if k <= 0 or abs(len(a) - len(b)) > k:
        return False
    at = 0
    less = min(len(a), len(b))
    while at < less and a[at] == b[at]:
        at += 1
    end = 0
    while end < less - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at : len(a) - end], b[at : len(b) - end]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) <= k
    far = k + 1
    width = 2 * k + 1
    # cell d of row i stands for column i + d - k; one cell more on the right for the row above
    above: list[int] = [far] * (width + 1)
    row = [max(0, d - k) if k <= d <= k + m else far for d in range(width)] + [far]
    for i in range(1, n + 1):
        now = [far] * (width + 1)
        best = far
        for d in range(max(0, k - i), min(width, m - i + k + 1)):
            j = i + d - k
            if j == 0:
                cost = i
            else:
                cost = row[d] + (a[i - 1] != b[j - 1])
                if d and now[d - 1] + 1 < cost:
                    cost = now[d - 1] + 1
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and above[d] + 1 < cost:
                    cost = above[d] + 1
            if row[d + 1] + 1 < cost:
                cost = row[d + 1] + 1
            now[d] = cost if cost < far else far
            if cost < best:
                best = cost
        if best > k:
            return False
        above, row = row, now
    return row[m - n + k] <= k


def slips(w: str) -> int:
    """Edits that a word of this length may have suffered."""
    return 0 if len(w) < 4 else 1 if len(w) < 7 else 2


class Vocabulary:
    """Frequent words of the collection: ordinary ones and names (mostly capitalised inside sentences)."""

    def __init__(self, words: dict[str, bool]):
        self.name = words
        self.deleted: dict[str, list[str]] = {}
        for w, is_name in words.items():
            if not is_name and len(w) >= (7 if w in NEGATIONS else 4):
                for v in {w, *self._shorter(w)}:
                    self.deleted.setdefault(v, []).append(w)
        self.memo: dict[str, str | None] = {}

    @staticmethod
    def _shorter(w: str) -> set[str]:
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    def correct(self, w: str) -> str | None:
        """The ordinary word of which w is a misspelling, if there is one."""
        if w not in self.memo:
            found: set[str] = set()
            one = self._shorter(w)
            for v in {w, *one}:
                found.update(self.deleted.get(v, ()))
            if len(w) >= 7:
                for v in {y for x in one for y in self._shorter(x)}:
                    found.update(self.deleted.get(v, ()))
            close = [(x, 1 if near(w, x, 1) else 2) for x in found if near(w, x, slips(w))]
            self.memo[w] = min(close, key=lambda x: (x[1], abs(len(x[0]) - len(w)), x[0]))[0] if close else None
            if len(self.memo) > 200_000:
                self.memo.clear()
                return self.correct(w)
        return self.memo[w]


@lru_cache(maxsize=1 << 16)
def _month(w: str) -> str | None:
    if w in MONTHS:
        return w
    close = [m for m in MONTHS if len(m) > 4 and near(w, m, 1)] if len(w) > 3 else []
    return close[0] if len(close) == 1 else None


def side_form(text: str, vocabulary: Vocabulary) -> tuple[str, str, str, int, str, str]:
    """(figures, months, names, negations, words, perhaps names) of one side, each sorted and joined by blanks.

    Perhaps names are unknown words that open a sentence, where the capital says nothing.
    """
    found, trusted = tokens(text)
    figures, months, names, words, perhaps, no = [], [], [], [], [], 0
    previous = ""
    for w, capital in found:
        if w[0].isdigit():
            figures.append(w)
        elif w in NEGATIONS or w == "t" and previous.endswith("n"):
            no += 1
        elif w in EMPTY or len(w) == 1:
            pass
        elif (m := _month(w)) is not None:
            months.append(m)
        else:
            kind = vocabulary.name.get(w)
            if kind is None:
                if w in SAME:
                    kind = False
                elif not (trusted and capital) and (fixed := vocabulary.correct(w)) is not None:
                    w, kind = fixed, False
                elif trusted and capital is None:
                    perhaps.append(w)
                    continue
                else:
                    kind = capital or not trusted
            if kind:
                names.append(w)
            elif w in NEGATIONS:
                no += 1
            elif w not in EMPTY:
                words.append(SAME.get(w, w))
        previous = w
    return " ".join(sorted(figures)), " ".join(sorted(set(months))), " ".join(sorted(set(names))), no, " ".join(sorted(words)), " ".join(sorted(set(perhaps)))


def facts(a: tuple, b: tuple) -> str:
    """Figures, months and negations of both sides, whichever way the sides stand: equal in all records that are the same."""
    return "|".join(sorted(f"{s[0]};{s[1]};{s[3]}" for s in (a, b)))


def key_strings(a: tuple, b: tuple, vocabulary: Vocabulary) -> list[str]:
    """The names of both sides, each for itself, with perhaps names and unknown words; without any, all words as one string."""
    out = {w for side in (a, b) for i in (2, 5) for w in side[i].split()}
    out.update(w for side in (a, b) for w in side[4].split() if w not in vocabulary.name and w not in COMMON)
    return sorted(out) or [" ".join(sorted(w for side in (a, b) for w in side[4].split()))]


def _pair_off(x: list[str], y: list[str]) -> tuple[list[str], list[str]]:
    """What is left of two word lists when equal and nearly equal words are taken away."""
    cx, cy = Counter(x), Counter(y)
    left, right = list((cx - cy).elements()), list((cy - cx).elements())
    for w in list(left):
        hit = next((v for v in right if near(w, v, max(slips(w), slips(v)) if min(len(w), len(v)) > 3 else 0)), None)
        if hit is not None:
            left.remove(w)
            right.remove(hit)
    return left, right


def same_side(a: tuple, b: tuple, share: float = 0.7) -> bool:
    """Equal figures, months and negations, names equal but for slips, and at least `share` of the shorter side's words in common."""
    if a[0] != b[0] or a[1] != b[1] or a[3] != b[3]:
        return False
    wa, wb = a[4].split(), b[4].split()
    left, right = _pair_off(a[2].split(), b[2].split())
    # a perhaps name counts as a name where the other side has it; a side may have others of its own
    left, pb = _pair_off(left, b[5].split())
    right, pa = _pair_off(right, a[5].split())
    pa, pb = _pair_off(pa, pb)
    if pa and pb:
        return False
    # a rare ordinary word may have been taken for a name on one side only
    if left:
        left, wb = _pair_off(left, wb)
    if right:
        right, wa = _pair_off(right, wa)
    if left or right:
        return False
    less = min(len(wa), len(wb))
    rest, _ = _pair_off(wa, wb)
    return len(wa) - len(rest) >= share * less


def same_record(x: tuple[tuple, tuple], y: tuple[tuple, tuple]) -> bool:
    return same_side(x[0], y[0]) and same_side(x[1], y[1]) or same_side(x[0], y[1]) and same_side(x[1], y[0])
