"""A linear-chain model over the possible sentence ends of a text: features, training and Viterbi decoding.

Every character is tagged as the last of its sentence or as inside it.  Only some characters can
be last ones (final marks with what closes with them, line breaks, blanks of scripts without
marks); all others are inside with certainty, so the chain runs over the former.
"""

from __future__ import annotations

import random
import re

MARKS = ".!?…。！？｡．।॥؟۔።፧‽⁇⁈⁉‼"
CLOSERS = "\"'”’»」』）)]】》〉*_“›"
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "„": "“”", "‘": "’", "《": "》", "〈": "〉", "【": "】", "‹": "›"}
_BRACKETS = "(（[【"
_BLANK = re.compile(r"\s*")


def script(ch: str) -> str:
    """A letter for the script of a character: Latin L, Cyrillic R, Greek G, Arabic A, Devanagari D, Kannada N, Ethiopic E, Thai T, kana J, Han C, other O, digit 0, no letter -."""
    o = ord(ch)
    if ch.isdigit():
        return "0"
    if o < 0x250:
        return "L" if ch.isalpha() else "-"
    for lo, hi, name in (
        (0x370, 0x3FF, "G"), (0x1F00, 0x1FFF, "G"), (0x400, 0x52F, "R"), (0x600, 0x77F, "A"), (0x8A0, 0x8FF, "A"), (0xFB50, 0xFEFC, "A"), (0x900, 0x97F, "D"), (0xC80, 0xCFF, "N"),
        (0xE00, 0xE7F, "T"), (0x1200, 0x139F, "E"), (0x3041, 0x30FF, "J"), (0x3400, 0x9FFF, "C"), (0x1E00, 0x1EFF, "L"),
    ):
        if lo <= o <= hi:
            return name if ch.isalnum() or name in "TDN" else "-"
    return "O" if ch.isalpha() else "-"


_EDGE = re.compile("[\"'" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")
_END = "[" + re.escape(MARKS) + "]+"
_GREEK_END = "[" + re.escape(MARKS + ";;") + "]+"
_SCAN = {(g, w): re.compile((_GREEK_END if g else _END) + (r"|\s+" if w else "")) for g in (False, True) for w in (False, True)}
_GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")
_THAI = re.compile("[\u0e00-\u0e7f]")


def spans(text: str) -> list[tuple[int, int]]:
    """(opening, closing) positions of matched quotations and brackets; a closing one is sought among the last 32 open ones."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    n = len(text)
    for m in _EDGE.finditer(text):
        i, ch = m.start(), m[0]
        if ch in "\"'":
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < n else " "
            at = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 33), -1) if stack[k][0] == ch), None)
            if at is not None and (ch == '"' or not after.isalnum()) and not before.isspace():
                out.append((stack[at][1], i))
                del stack[at:]
            elif (ch == '"' or not before.isalnum()) and not after.isspace():
                stack.append((ch, i))
        else:
            at = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 33), -1) if ch in PAIRS.get(stack[k][0], "")), None)
            if at is not None and not (ch == "’" and i + 1 < n and text[i + 1].isalnum() and i and text[i - 1].isalnum()):
                out.append((stack[at][1], i))
                del stack[at:]
            elif ch in PAIRS:
                stack.append((ch, i))
    return sorted(out)


def candidates(text: str, held: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start of the marks, end of the sentence if it ended there, marks) in order; the block's own end is not among them.

    marks is "\\n" for a line break without mark and " " for a blank in Thai text.
    """
    out: list[tuple[int, int, str]] = []
    n = len(text.rstrip())
    thai = _THAI.search(text) is not None
    closing = {c for _, c in (spans(text) if held is None else held)}
    done = 0
    for m in _SCAN[_GREEK.search(text) is not None, thai or "\n" in text].finditer(text, 0, n):
        i, j = m.span()
        if i < done:
            continue
        if not text[i].isspace():
            k = j
            while k < n:
                if text[k] in CLOSERS and (k in closing or text[k] in "*_”"):
                    k += 1
                elif text[k] in " \xa0\u202f" and k + 1 < n and text[k + 1] == "»" and k + 1 in closing:
                    k += 2
                else:
                    break
            if k < n:
                out.append((i, k, m[0]))
            done = k
        elif i and j < n and not (out and out[-1][1] == i):
            if "\n" in m[0]:
                out.append((i, i, "\n"))
            elif thai and (script(text[i - 1]) == "T" or script(text[j]) == "T" or text[i - 1] in "ๆฯ"):
                out.append((i, i, " "))
    return out


def _shape(w: str) -> str:
    if not w:
        return "-"
    if w.isdigit():
        return "9" if len(w) > 2 else "0"
    if len(w) == 1:
        return "X" if w.isupper() else "x"
    if "." in w:
        return "p" if any(c.isdigit() for c in w) else "D" if w[0].isupper() else "d"
    return ("C" if w[0].isupper() else "c") + str(min(len(w), 5))


def _class(ch: str) -> str:
    if not ch:
        return "e"
    if ch.isupper():
        return "U"
    if ch.islower():
        return "l"
    if ch.isdigit():
        return "0"
    if ch.isalpha() or script(ch) in "TDN":
        return script(ch)
    return "q" if ch in "\"'“«„‘「『¿¡" else "(" if ch in _BRACKETS else "," if ch in ",،،、，;；:：-–—" else "*" if ch in "*_`" else "o"


_BEFORE = re.compile(r"[^\s\"“«„‘「『(\[*`]*$")
_WORD = re.compile(r"[^\W\d_]+")
_PREVIOUS = re.compile(r"([^\W\d_]+)\.?\s+$")
_NAMED = re.compile(r"\s*([A-Z][a-zA-Z'’-]*)\s*")
_FOREIGN = re.compile(r"[A-Za-z][A-Za-z'’-]*")
_FIGURE = re.compile(r"\d[\d.,:]*")


def _beyond(text: str) -> str:
    """What follows a name at the beginning of the text; else the first letter of it, or its class where that is Latin."""
    m = _NAMED.match(text)
    rest = text[m.end() :] if m else text.lstrip()
    w = _WORD.match(rest)
    if m:
        return "N" + (w[0].lower()[:6] if w and w[0].isascii() else rest[:1])
    return rest[:1] if w and not w[0].isascii() else _class(rest[:1])


def contexts(text: str) -> tuple[list[int], list[list[tuple]]]:
    """(sentence ends if they are ends, context groups of each); `expand` turns a group into features."""
    held = spans(text)
    found = candidates(text, held)
    opened: list[tuple[int, int]] = []
    seen = 0
    ends: list[int] = []
    out: list[list[tuple]] = []
    for start, end, marks in found:
        while seen < len(held) and held[seen][0] < start:
            opened.append(held[seen])
            seen += 1
        while opened and opened[-1][1] < start:
            opened.pop()
        at = _BLANK.match(text, end).end()
        after, space = text[at : at + 14], text[end : min(at, end + 80)]
        g = "n" if "\n" in space else "0" if not space else "1"
        before = _BEFORE.search(text[max(0, start - 14) : start])[0]
        nxt = _class(after[:1])
        word_after = _WORD.match(after)
        nextword = word_after[0].lower()[:8] if word_after else after[:1]
        mark = marks if len(marks) < 3 else marks[:1] + "+"
        closed = "c" if text[start + len(marks) : end].strip("*_ ") else ""
        shape = _shape(before)
        where = "-"
        groups: list[tuple] = [("A", mark, g, nxt, closed, shape)]
        if opened:
            o, c = opened[-1]
            ahead = text[max(0, o - 60) : o].rstrip()
            pre = "s" if not ahead else "f" if ahead[-1] in MARKS or (ahead[-1] in CLOSERS and len(ahead) > 1 and ahead[-2] in MARKS) else ":" if ahead[-1] in ",:،：，" else "w"
            tail = text[c + 1 : c + 61]
            first = tail.lstrip()[:1]
            post = _class(first) + ("!" if tail[:1] and not tail[:1].isspace() else "")
            last = text[max(o + 1, c - 60) : c].rstrip()[-1:]
            fin = "." if last in MARKS else "," if last in ",،，、" else "w"
            where = f"{'b' if text[o] in _BRACKETS else 'q'}{'end' if c < end else 'in'}{pre}{post}{fin}"
            groups.append(("I", where[:4], pre, post, fin, first if post[0] not in "Ul0" else "", _beyond(tail)))
        groups.append(("B", where, mark, nxt, g))
        if mark == " ":
            left = _FIGURE.sub("0", _FOREIGN.sub("L", text[max(0, start - 24) : start]))[-6:]
            groups.append(("T", left, _FIGURE.sub("0", _FOREIGN.sub("L", text[at : at + 24]))[:5]))
        else:
            groups.append(("C", mark, before.lower() if len(before) <= 7 else "~" + before.lower()[-3:], nxt, g, script(before[-1:] or " ")))
            groups.append(("D", mark, nextword, shape, closed))
            groups.append(("F", where, mark, _beyond(text[at : at + 60])))
            if shape in "09" and (p := _PREVIOUS.search(text[max(0, start - len(before) - 16) : start - len(before)])):
                groups.append(("P", p[1].lower()[:8], nxt))
            if closed:
                groups.append(("E", where, nextword[:1]))
        ends.append(end)
        out.append(groups)
    return ends, out


def expand(group: tuple) -> list[str]:
    """The features of a context group."""
    kind = group[0]
    if kind == "A":
        _, m, g, nxt, closed, shape = group
        return ["b", f"m{m}", f"mg{m}{g}{nxt}{closed}", f"s{m}{shape}{g}{nxt}"]
    if kind == "B":
        _, where, m, nxt, g = group
        return [f"w{where}", f"wm{where}{m}{nxt}{g}"]
    if kind == "I":
        _, head, pre, post, fin, first, beyond = group
        return [f"wp{head}{pre}{fin}", f"wq{head}{post}", f"wr{head}{pre}", f"wt{head}{first or post}{fin}", f"wx{head}{beyond}", f"wy{head}{pre}{beyond}{fin}"]
    if kind == "C":
        _, m, word, nxt, g, s = group
        return [f"p{m}{word}", f"sc{s}{m}{nxt}{g}", *([f"pn{m}{word}|{nxt}{g}"] if word[:1] != "~" else [])]
    if kind == "D":
        _, m, nextword, shape, closed = group
        return [f"n{m}{nextword}", f"nw{m}{shape}|{nextword}", *([f"cn{m}{nextword}"] if closed else [])]
    if kind == "F":
        return [f"x{group[2]}{group[3]}", f"xw{group[1]}{group[2]}{group[3]}"]
    if kind == "P":
        return [f"q{group[1]}", f"q{group[1]}|{group[2]}"]
    if kind == "E":
        return [f"cw{group[1]}{group[2]}"]
    _, left, right = group
    out = [f"L{left[-k:]}" for k in (1, 2, 3, 5)] + [f"R{right[:k]}" for k in (1, 2, 3, 5)]
    return [*out, f"LS{script(left[-1:] or ' ')}{script(right[:1] or ' ')}", f"LR{left[-2:]}|{right[:2]}", f"LR3{left[-3:]}|{right[:3]}", f"ry{left[-1:] == 'ๆ'}{right[:1] == 'ๆ'}{right[:2]}"]


def features(text: str) -> tuple[list[int], list[list[str]]]:
    """(sentence ends if they are ends, features of each)."""
    ends, groups = contexts(text)
    return ends, [[f for g in gs for f in expand(g)] for gs in groups]


def viterbi(emissions: list[float], moves: dict[str, float]) -> list[int]:
    """The best 0/1 tags of the chain, emissions being the scores of tag 1 over tag 0."""
    if not emissions:
        return []
    t = [[moves.get(f"T{a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)]
    score = [0.0, emissions[0]]
    back: list[tuple[int, int]] = []
    for e in emissions[1:]:
        a = (score[0] + t[0][0], score[1] + t[1][0])
        b = (score[0] + t[0][1], score[1] + t[1][1])
        back.append((int(a[1] > a[0]), int(b[1] > b[0])))
        score = [max(a), max(b) + e]
    tag = int(score[1] > score[0])
    out = [tag]
    for x in reversed(back):
        tag = x[tag]
        out.append(tag)
    return out[::-1]


class Decoder:
    """Splits texts with given weights; sums of weights are kept per context group."""

    def __init__(self, weights: dict[str, float], keep: int = 400_000):
        self.weights, self.keep = weights, keep
        self.sums: dict[tuple, float] = {}

    def _sum(self, group: tuple) -> float:
        if len(self.sums) > self.keep:
            self.sums.clear()
        get = self.weights.get
        value = self.sums[group] = sum(get(f, 0.0) for f in expand(group))
        return value

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences of a text, without outer blanks."""
        ends, contexts_ = contexts(text)
        sums = self.sums
        tags = viterbi([sum(sums[g] if g in sums else self._sum(g) for g in gs) for gs in contexts_], self.weights)
        out, at = [], 0
        for end in [*(e for e, t in zip(ends, tags, strict=True) if t), len(text)]:
            part = text[at:end]
            bare = part.strip()
            if bare:
                first = at + len(part) - len(part.lstrip())
                out.append((first, first + len(bare)))
            at = end
        return out


def decode(text: str, weights: dict[str, float]) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text."""
    return Decoder(weights)(text)


def _group(text: str) -> str:
    counts: dict[str, int] = {}
    for c in text:
        s = script(c)
        if s not in "-0":
            counts[s] = counts.get(s, 0) + 1
    if not counts:
        return "L"
    others = {k: v for k, v in counts.items() if k != "L"}
    if others and sum(others.values()) * 3 >= counts.get("L", 0):
        return "J" if "J" in others else max(others, key=lambda k: (others[k], k))
    return "L"


_QUOTES = {"C": [("“", "”"), ("「", "」")], "J": [("「", "」"), ("“", "”")]}
_ANY = [("“", "”"), ('"', '"'), ("«", "»"), ("'", "'"), ("„", "“"), ("‘", "’"), ("« ", " »")]


def compose(sentences: list[str], rng: random.Random, blocks: int) -> list[tuple[str, list[int]]]:
    """Blocks of several sentences of one script with the ends of all but the last, disturbed as real blocks are.

    Sentences of scripts without marks are stripped of punctuation first.
    """
    by: dict[str, list[str]] = {}
    for s in sentences:
        s = s.strip()
        g = _group(s)
        if g == "T":
            s = s.rstrip(MARKS + " ")
        if s:
            by.setdefault(g, []).append(s)
    total = sum(len(v) for v in by.values())
    out: list[tuple[str, list[int]]] = []
    for g, pool in sorted(by.items()):
        for _ in range(max(blocks // 16, blocks * len(pool) // max(total, 1))):
            text, ends = "", []
            if rng.random() < 0.05:
                words = [w for w in rng.choice(pool).split() if w.isalpha() and len(w) <= 12]
                text = "**" + (" ".join(words[: rng.randint(1, 2)]) or "Note") + ":** "
            units = rng.randint(2, 6)
            for u in range(units):
                picked = [rng.choice(pool)]
                if rng.random() < 0.1 and g != "T":
                    picked = [x for x in (rng.choice(pool), rng.choice(pool)) if not re.search(r"[\"“”«»„‘「」『』]|(?<!\w)'", x)]
                    if len(picked) == 2:
                        o, c = rng.choice(_QUOTES.get(g, _ANY))
                        picked = [o + picked[0], picked[1] + c]
                    else:
                        picked = picked or [rng.choice(pool)]
                for x in picked:
                    if text and ends and ends[-1] == len(text):
                        text += _gap(g, text, rng)
                    text += x
                    ends.append(len(text))
                if rng.random() < 0.01 and g not in "TCJ" and u + 1 < units:
                    text = text.rstrip(MARKS) + "\n" if text[-1] in MARKS else text
                    ends[-1] = len(text.rstrip())
                    if text.endswith("\n"):
                        text += rng.choice(pool)
                        ends.append(len(text))
            ends.pop()
            if rng.random() < 0.1:
                text = text.rstrip(MARKS)
                ends = [e for e in ends if e < len(text)]
            out.append((text, ends))
    rng.shuffle(out)
    return out


def _gap(g: str, text: str, rng: random.Random) -> str:
    r = rng.random()
    if g in "CJ":
        return "" if r < 0.86 else "\n" if r < 0.93 else " "
    if g == "T":
        return " " if r < 0.85 else "\n" if r < 0.9 else rng.choice(["  ", "\xa0", "\t"])
    if r < 0.8:
        return " "
    if r < 0.88:
        return "\n"
    if r < 0.95 or text[-1] not in MARKS:
        return rng.choice(["  ", "\xa0", "\t", " \n"])
    return ""


#: Starting weights.  In Thai, blanks beside figures, foreign words and the repetition sign end no statement unless the words around say so.
START = {"LSTL": -2.0, "LSLT": -2.0, "LST0": -2.0, "LS0T": -2.0, "LSL0": -2.0, "LS0L": -2.0, "LSLL": -2.0}


def train(sentences: list[str], seed: int = 11, blocks: int = 6000, epochs: int = 6) -> dict[str, float]:
    """Weights of an averaged structured perceptron with Viterbi decoding in every step."""
    rng = random.Random(seed)
    data = []
    for text, gold in compose(sentences, rng, blocks):
        ends, feats = features(text)
        if ends:
            g = {*gold}
            data.append((feats, [int(e in g) for e in ends]))
    w: dict[str, float] = dict(START)
    total: dict[str, float] = {}
    step = 1
    for _ in range(epochs):
        rng.shuffle(data)
        for feats, gold in data:
            got = viterbi([sum(w.get(x, 0.0) for x in f) for f in feats], w)
            if got != gold:
                for f, a, b in zip(feats, gold, got, strict=True):
                    if a != b:
                        d = 1.0 if a else -1.0
                        for x in f:
                            w[x] = w.get(x, 0.0) + d
                            total[x] = total.get(x, 0.0) + d * step
                for k in range(1, len(gold)):
                    if gold[k - 1 : k + 1] != got[k - 1 : k + 1]:
                        for tags, d in ((gold, 1.0), (got, -1.0)):
                            x = f"T{tags[k - 1]}{tags[k]}"
                            w[x] = w.get(x, 0.0) + d
                            total[x] = total.get(x, 0.0) + d * step
            step += 1
    mean = {x: v - total.get(x, 0.0) / step for x, v in w.items()}
    return {x: v for x, v in mean.items() if abs(v) > 1e-6}
