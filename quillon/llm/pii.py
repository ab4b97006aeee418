"""Personal data: fixed patterns, and further candidates judged by boosted trees.

Base spans follow four patterns (email, ip, card, phone), leftmost and not
overlapping within a kind.  They are found by linear scans that give what the
patterns' regular expressions give, whatever the length of the text.

Generators with high recall propose further spans, which may overlap: secrets,
national telephone numbers, social security numbers, IBANs, IPv6 addresses and
spelled-out email addresses.  Gradient-boosted trees (numpy, logistic loss)
score each by its format and context; scores are calibrated, and each kind has
a threshold chosen for precision.  Accepted spans that touch no base span and
no better candidate are added.  The trees are trained on examples made from
public formats with a fixed seed, so no table is needed and the broadcast is
a few kilobytes.

Defined cases: a null or empty text has no spans (the digest is that of the
empty string).  Repeated rows are judged one by one.  Empty tables give empty
results; extra columns are kept by :func:`redacted`.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._common import table, unused

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_spelled", "iban", "ipv6", "secret", "ssn", "tel")
KINDS = BASE + ADDED
PRECISION = 0.98

Span = tuple[int, int, int]  # start, number of the kind, end

_SOME = re.compile(rb"[0-9@]|[\[(]at[\])]|::|[A-Za-z0-9_+/=-]{16}")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[A-Za-z]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"[\x20().0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether a number, however many zeros lead it, is at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    groups = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(groups):
        four = groups[i : i + 4]
        if all(b[0] - a[1] == 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(_octet(text[s:e]) for s, e in four):
                out.append((four[0][0], 1, four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(groups):
        j = i
        while j + 1 < len(groups) and groups[j + 1][0] - groups[j][1] == 1 and text[groups[j][1]] in " -":
            j += 1
        n = sum(e - s for s, e in groups[i : j + 1])
        if 12 <= n <= 19 and luhn("".join(text[s:e] for s, e in groups[i : j + 1])):
            out.append((groups[i][0], 2, groups[j][1]))
        i = j + 1
    at = text.find("+")
    while at >= 0:
        if at + 1 < len(text) and text[at + 1] in "0123456789" and (m := _PHONE.match(text, at + 2)):
            end = m.end()
            while end > at + 2 and text[end - 1] not in "0123456789":
                end -= 1
            if end > at + 3 and 9 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                out.append((at, 3, end))
        at = text.find("+", at + 1)
    return sorted(out)


# --- candidates -------------------------------------------------------------------------------

_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?")
#: Keys that name themselves.
_PREFIX = re.compile(r"AKIA|ASIA|sk-|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abps]-|AIza|eyJ|npm_|hf_")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_COLONS = re.compile(r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![A-Za-z0-9:])")
_SPELLED = re.compile(r"[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
#: Most groups of digits in a telephone number.
_GROUPS = 5
_BETWEEN = frozenset(" ().-/")


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Runs of sixteen or more token characters, of any length, but for plain words; after the last ``=`` inside."""
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        token = m.group()
        if "=" in token[:-2]:
            a += token.rindex("=", 0, -2) + 1
            token = text[a:b]
        some = any(c in "0123456789" for c in token)
        if len(token) >= 16 and any(c.isalpha() for c in token) and (some or not (token.islower() or token.isupper() or token.istitle())):
            yield a, b
    for m in _SIGNED.finditer(text):
        yield m.span()


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of windows of digit groups with up to two separators between: all that may be a number of a person."""
    groups = [m.span() for m in _DIGITS.finditer(text)]
    ssn, tel = KINDS.index("ssn"), KINDS.index("tel")
    solid = lambda c: c.isalnum() or c == "_"
    for i, (s, e) in enumerate(groups):
        if solid(text[s - 1 : s]) or e - s > 15:
            continue
        total, j = 0, i
        while True:
            x, y = groups[j]
            total += y - x
            if total > 15:
                break
            if not solid(text[y : y + 1]):
                if j - i == 2 and y - s == 11 and (e - s, y - x) == (3, 4) and text[e] == "-" == text[x - 1]:
                    yield s, ssn, y
                if total >= 7 and (j > i or total >= 9):
                    yield (s - 1 if text[s - 1 : s] == "(" and ")" in text[s:y] else s), tel, y
            j += 1
            if j - i == _GROUPS or j == len(groups) or groups[j][0] - y > 2 or not all(c in _BETWEEN for c in text[y : groups[j][0]]):
                break


def candidates(text: str) -> list[Span]:
    """Proposed spans of the added kinds, in texts of any length; they may overlap."""
    found: set[Span] = {(a, KINDS.index("secret"), b) for a, b in _secrets(text)}
    found.update(_numbers(text))
    for m in _IBAN.finditer(text):
        if m.start() == 0 or not text[m.start() - 1].isalnum():
            found.add((m.start(), KINDS.index("iban"), m.end()))
    if ":" in text:
        for m in _COLONS.finditer(text):
            if sum(c != ":" for c in m.group()) >= 4:
                found.add((m.start(), KINDS.index("ipv6"), m.end()))
    if "[at]" in text or "(at)" in text:
        for m in re.finditer(r"[\[(]at[\])]", text):
            lo = max(0, m.start() - 66)
            for x in _SPELLED.finditer(text, lo, min(len(text), m.end() + 320)):
                found.add((x.start(), KINDS.index("email_spelled"), x.end()))
    return sorted(found)


def _is_address(own: str) -> bool:
    try:
        ipaddress.IPv6Address(own)
    except ValueError:
        return False
    return True


def _turns(own: str) -> int:
    """How often small letters, capitals, digits and signs take turns."""
    kinds = [c.islower() + 2 * c.isupper() + 3 * c.isdigit() for c in own]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))


def _goes_on(side: str) -> bool:
    """Whether digits follow after at most two separators."""
    for c in side[:3]:
        if c in "0123456789":
            return True
        if c not in _BETWEEN:
            return False
    return False


_CUES = (
    re.compile(r"(?i)phone|tel\b|tel\.|call|mobile|fax|contact|numéro|telefon|anruf|llama|appel"),
    re.compile(r"(?i)ssn|social|security|taxpayer"),
    re.compile(r"(?i)token|secret|key|passw|auth|bearer|credential|private|pwd"),
    re.compile(r"(?i)iban|account|bank|konto|compte|cuenta|transfer"),
    re.compile(r"(?i)commit|sha\d*|md5|checksum|hash|digest|revision|build|etag|uuid"),
    re.compile(r"(?i)order|invoice|part|isbn|item|model|serial|version|page|date|price|total|ticket|case|no\.|\#|id\b"),
)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, kind, end = span
    own = text[start:end]
    left, right = text[max(0, start - 40) : start], text[end : end + 16]
    digits, upper, lower = sum(c in "0123456789" for c in own), sum("A" <= c <= "Z" for c in own), sum("a" <= c <= "z" for c in own)
    groups = [len(x) for x in _DIGITS.findall(own)] or [0]
    counts = [own.count(c) for c in set(own)]
    entropy = -sum(n / len(own) * log2(n / len(own)) for n in counts)
    valid = 0.0
    if KINDS[kind] == "iban":
        plain = own.replace(" ", "")
        valid = float(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    elif KINDS[kind] == "ipv6":
        valid = float(_is_address(own))
    return [
        *[float(kind == KINDS.index(k)) for k in ADDED],
        digits, upper, lower, end - start, len(own) - digits - upper - lower, entropy,
        float(all(c in "0123456789abcdef-" for c in own)), float(upper > 0 and lower > 0 and digits > 0), valid,
        len(groups), groups[0], groups[-1], max(groups), digits / len(own),
        *[float(bool(c.search(left))) for c in _CUES],
        float(left[-1:] in ("\"", "'") and right[:1] == left[-1:]), float(left.rstrip()[-1:] in ("=", ":")), float(left[-1:].isspace() or not left),
        float(left.rstrip()[-1:] in ("$", "€", "£", "#", "v")), float("-" in own), float("." in own), float("/" in own), float("(" in own),
        float(groups[0] == 4 and own[:2] in ("19", "20")), float(own.count(":")), float(bool(_PREFIX.match(own))),
        float(_goes_on(left[::-1])), float(_goes_on(right)), float(own[:1] == "0"), float(own[:1] == "("), len(max(_LETTERS.findall(own), key=len, default="")),
        _turns(own) / len(own), float("://" in left[-30:]), float("_" in own),
    ]


# --- boosted trees ----------------------------------------------------------------------------


@dataclass
class Trees:
    """Depth-wise trees over binned features: arrays [tree, node]."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    # Bins of all features side by side, so that one count serves them all; the last bin of a feature ends no split.
    binned = np.stack([np.searchsorted(c, x[:, f], "left") + f * bins for f, c in enumerate(cuts)], axis=1)
    ends = np.array([[i < len(c) for i in range(bins)] for c in cuts])
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(x), bias)
    inner = 2**depth - 1
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                best = 1e-6
                if len(own) > 8:
                    gs, hs = g[own].sum(), h[own].sum()
                    cells = binned[own].ravel()
                    gl, hl = (np.cumsum(np.bincount(cells, np.repeat(v[own], len(cuts)), ends.size).reshape(ends.shape), axis=1) for v in (g, h))
                    gain = np.where(ends, gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge), 0)
                    if gain.max() > best:
                        f, at = divmod(int(gain.argmax()), bins)
                        feature[k], cut[k] = f, cuts[f][at]
                node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[at]
        made.append((feature, cut, leaf))
    return Trees(*(np.array(a) for a in zip(*made, strict=True)), depth, bias)


# --- examples from public formats ---------------------------------------------------------------


def _examples(n: int, seed: int) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(text, kind, where the personal parts are); negatives, without any, are look-alikes of the same kind.

    Keys that name themselves by a prefix are personal whatever stands before
    them; other random tokens only if a word before them says so.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    chars = lambda k, abc: "".join(abc[i] for i in rng.integers(0, len(abc), k))
    word = lambda: chars(int(rng.integers(2, 10)), "etaoinshrdlucmfwyp")
    prose = lambda: " ".join(word() for _ in range(rng.integers(0, 6)))
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    mixed = letters + "0123456789"

    def iban() -> str:
        body = pick("DE", "FR", "ES", "GB", "NL"), digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
        plain = f"{body[0]}{check:02d}{body[1]}"
        return plain if rng.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))

    def named() -> str:
        return pick(
            "AKIA" + chars(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "sk-" + chars(int(rng.integers(24, 48)), mixed), "ghp_" + chars(36, mixed), "glpat-" + chars(20, mixed),
            f"xoxb-{digits(11)}-{chars(24, mixed)}", "AIza" + chars(35, mixed), f"eyJ{chars(30, mixed)}.eyJ{chars(40, mixed)}.{chars(43, mixed)}",
        )

    def number() -> str:
        return pick(
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}",
            f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        )

    def compressed() -> str:
        parts = [chars(int(rng.integers(1, 5)), hexes) for _ in range(int(rng.integers(3, 7)))]
        at = int(rng.integers(1, len(parts)))
        return ":".join(parts[:at]) + "::" + ":".join(parts[at:])

    for _ in range(n):
        kind = pick(*ADDED)
        good = rng.random() < 0.5
        lead, own, gap, tail = "", "", "", ""
        if kind == "secret":
            if good and rng.random() < 0.5:
                lead, own = pick("", "", "", "key ", "use ", "leaked: ", "found "), named()
            elif good:
                lead = pick("token = ", "token: ", "api_key = ", "secret = ", "password: ", "key=", "Authorization: Bearer ", "AUTH_TOKEN=")
                own = pick(chars(40, hexes), chars(32, hexes), chars(64, hexes), chars(int(rng.integers(20, 44)), mixed), chars(int(rng.integers(20, 44)), letters), chars(int(rng.integers(100, 700)), mixed))
            else:
                lead = pick("commit ", "sha256: ", "md5 ", "checksum = ", "build ", "revision ", "etag ", "digest: ", "uuid ", "")
                own = pick(
                    chars(40, hexes), chars(32, hexes), chars(64, hexes), f"{chars(8, hexes)}-{chars(4, hexes)}-4{chars(3, hexes)}-{chars(4, hexes)}-{chars(12, hexes)}",
                    f"{word()}-{word()}-{digits(2)}-{word()}-{word()}", f"{word()}_{word()}_{word()}_{word()}{digits(1)}", "/".join(word() for _ in range(6)) + digits(1),
                    f"{word()}{word().title()}{word().title()}{word().title()}", f"{word().title()}-{word()}-{word().title()}-{word()}", "-".join(word() for _ in range(5)) + f"-20{digits(2)}",
                    f"https://{word()}.com/{word()}/{word()}/{word()}-{word()}-{word()}-20{digits(2)}/{word()}", f"http://www.{word()}.org/20{digits(2)}/{digits(2)}/{word()}-{word()}-{word()}.html",
                )
        elif kind == "tel":
            if good:
                lead, own = pick("phone: ", "tel. ", "call ", "mobile ", "fax ", "contact: ", "Telefon ", "phone ", "my number, call ", ""), number()
                if not lead and not own.startswith("("):
                    lead = "call "
                gap, tail = pick(("", ""), ("", ""), (f" 20{digits(2)}-{digits(2)}-{digits(2)}", ""), ("/", number()), (" ", number()), (", ", number()))
            else:
                lead = pick("order ", "invoice ", "date ", "version ", "total ", "page ", "ticket #", "ISBN ", "", "part no. ")
                own = pick(
                    f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/19{digits(2)}", digits(9), digits(12), f"978-{digits(1)}-{digits(3)}-{digits(5)}", f"{digits(4)} {digits(4)}",
                    f"19{digits(2)}-20{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", digits(15), " ".join(digits(8)),
                    " ".join(digits(2) for _ in range(4)), " ".join(digits(int(rng.integers(1, 5))) for _ in range(12)), "-".join(digits(3) for _ in range(6)),
                )
        elif kind == "ssn":
            own = f"{digits(3)}-{digits(2)}-{digits(4)}"
            lead = pick("SSN ", "SSN: ", "social security number ", "taxpayer id ", "social security numbers ") if good else pick("part no. ", "model ", "order ", "item ", "")
            gap = pick("", " ", ", ")
            tail = f"{digits(3)}-{digits(2)}-{digits(4)}" if gap else ""
        elif kind == "iban":
            own = iban() if good else pick("AB", "XK", "MD") + digits(20)
            lead = pick("IBAN ", "IBAN: ", "account ", "bank transfer to ", "") if good else pick("serial ", "model ", "part ", "")
        elif kind == "ipv6":
            own = pick(":".join(chars(4, hexes) for _ in range(8)), compressed()) if good else pick(f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", ":".join(chars(2, hexes) for _ in range(6)), f"{digits(1)}:{digits(1)}:{digits(1)}:{digits(1)}")
            lead = pick("host ", "from ", "address ", "") if good else pick("time ", "ratio ", "verse ", "mac ", "at ")
        else:
            own = f"{word()}.{word()} [at] {word()} [dot] com" if good else f"{word()} (at) {word()} . {word()}"
            lead = pick("mail ", "contact ", "")
        quote = pick('"', "", "'") if kind == "secret" and good else ""
        before = f"{pick('', prose() + ' ')}{lead}{quote}"
        places = [(len(before), len(before) + len(own)), (len(before + own + gap), len(before + own + gap + tail))]
        yield f"{before}{own}{quote}{gap}{tail}{pick(' ', ', ', '. ', '; ')}{prose()}", kind, places if good else []


@dataclass
class Judge:
    trees: Trees
    slope: float
    shift: float
    threshold: dict[int, float]

    def accept(self, text: str, spans: list[Span]) -> list[tuple[float, Span]]:
        if not spans:
            return []
        p = self.probability(np.array([describe(text, s) for s in spans], float))
        return [(float(q), s) for q, s in zip(p, spans, strict=True) if q >= self.threshold[s[1]]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.margin(x) + self.shift)))


def _labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, kinds = [], [], []
    for text, kind, places in _examples(n, seed):
        for span in candidates(text):
            x.append(describe(text, span))
            y.append(float(KINDS[span[1]] == kind and (span[0], span[2]) in places))
            kinds.append(span[1])
    return np.array(x, float), np.array(y), np.array(kinds)


@cache
def judge(examples: int = 6000, precision: float = PRECISION) -> Judge:
    """Trees from one set of examples; calibration and thresholds from another."""
    x, y, _ = _labelled(examples, 11)
    trees = boost(x, y)
    x, y, kinds = _labelled(examples // 2, 12)
    m = trees.margin(x)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Platt's sigmoid, by Newton steps with a little ridge
        p = 1 / (1 + np.exp(-(slope * m + shift)))
        w, d = p * (1 - p), p - y
        hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(d * m).sum() + (slope - 1), d.sum()])
        slope, shift = slope - step[0], shift - step[1]
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    threshold = {}
    for kind in range(len(KINDS)):
        own = np.flatnonzero(kinds == kind)
        order = own[np.argsort(-p[own], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(right >= precision)
        threshold[kind] = max(0.5, float(p[order[ok[-1]]])) if len(ok) else 2.0
    return Judge(trees, float(slope), float(shift), threshold)


def all_spans(text: str, by: Judge) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), sorted."""
    base = base_spans(text)
    found = sorted(by.accept(text, candidates(text)), key=lambda x: (-x[0], x[1]))
    if not found:
        return base, base
    # Base spans of different kinds may overlap: merged, they and the added ones stay disjoint and sorted.
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in base:
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    added: list[Span] = []
    for _, span in found:
        at = bisect_left(starts, span[2])  # the first that starts at or after its end
        if not at or ends[at - 1] <= span[0]:
            starts.insert(at, span[0])
            ends.insert(at, span[2])
            added.append(span)
    return base, sorted(base + added)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _texts(column: pa.Array) -> list[str | None]:
    """Texts that may hold something; None for the others."""
    return [x.decode("utf-8") if x and _SOME.search(x) else None for x in column.cast(pa.binary()).to_pylist()]


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (joined), spans (joined)."""
    sent = docs.sparkSession.sparkContext.broadcast(judge())
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                rows = []
                for text in _texts(part.column(1)):
                    base, every = all_spans(text, sent.value) if text else ([], [])
                    rows.append((*[sum(k == i for _, k, _ in base) for i in range(4)], joined(base), joined(every)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=names)

    slim = docs.select("doc_id", F.col("text").cast("string"))
    schema = f"doc_id {dict(slim.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return slim.mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``redacted``: the text without its spans; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(judge())
    name, at = unused(docs, "redacted")[0], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(at).to_pylist()
            found = [redact(t, all_spans(t, sent.value)[1]) if t else o for t, o in zip(_texts(b.column(at)), own, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
