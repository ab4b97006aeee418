"""Toxicity: Levenshtein automata on a lexicon trie, and context windows.

The lexicon is a short seed list plus words learned from labels: those that
occur in many more toxic than clean documents.  Its trie and the Levenshtein
automata of its terms are intersected once, on the driver, into one
deterministic automaton over classes of characters.  Executors run it over all
words of a batch in step, a table lookup a character; nearly all words die
within a few characters.  A term may be matched with one edit only if that
matches hardly any clean document of the training sample.

Each hit is weighed by a window around it: more if the reader is addressed or
other hits are near, less inside quotation marks or next to a word of saying.
A logistic model over the sums of weighed and of quoted hits and their density
gives the score.

Learning takes at most ``TRAIN_ROWS`` labelled rows, the first in the order of
a hash of their id and text; scoring covers all rows.  Texts are whole in both,
and a score does not depend on how a long text is cut to be worked on.

Defined cases: a null, empty or blank text has no hits and gets the score of
the intercept.  Rows with a null label teach nothing.  A null ``doc_id`` counts
as the empty id.  Without labels of both classes the seed list and fixed
coefficients score.  Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import table
from .quality import held_out, labelled

THRESHOLD = 0.5
TRAIN_ROWS = 12000
#: Least different families of toxic documents with a learned term, and least ratio of its shares among toxic and clean ones.
LEAST_DOCS = 5
LEAST_RATIO = 12.0
#: Largest share of clean documents in which a term's misspellings may occur.
FUZZY_CLEAN = 0.002
FUZZY_LENGTH = 5
#: Worth of a misspelled hit, next to an exact one.
MISSPELLED = 0.7
WINDOW = 80

SEEDS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "loser", "imbecile", "bastard", "dumbass")
ADDRESS = frozenset("you your you're youre yourself u ur du dich dir dein vous tu toi ton votre te tus usted ustedes".split())
SAYING = frozenset("said says say wrote writes quote quoted quotes word words term called reported according sagte schrieb zitat dit écrit mot citation dijo escribió cita palabra".split())
_OPEN, _SHUT = "“«„‹", "”»›"


# --- the automaton ----------------------------------------------------------------------------


@dataclass
class Automaton:
    """Deterministic; state 0 is dead, 1 the start."""

    step: np.ndarray  # [state, class] -> state
    term: np.ndarray  # state -> accepted term or -1
    edits: np.ndarray  # state -> edits of that match
    longest: int
    shortest: int
    classes: np.ndarray  # code point -> class, for those below its length
    far: np.ndarray  # further code points with a class, sorted
    far_classes: np.ndarray  # their classes; 0 for all others

    def kinds(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[np.minimum(points, len(self.classes) - 1)]
        high = np.flatnonzero(points >= len(self.classes))
        at = np.searchsorted(self.far, points[high])
        known = at < len(self.far)
        known[known] = self.far[at[known]] == points[high[known]]
        out[high] = 0
        out[high[known]] = self.far_classes[at[known]]
        return out


def build(terms: list[str], edits: list[int]) -> Automaton:
    """The trie of ``terms``, each within its number of edits (0 or 1), made deterministic by subsets.

    A subset holds (trie node, edits made, term or -1): the term is fixed from
    its first edit on, as the budget is the term's own.
    """
    terms = [t.replace("ς", "σ") for t in terms]
    letters = sorted({c for t in terms for c in t})
    number = {c: i + 1 for i, c in enumerate(letters)}
    kids: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    fuzzy = [False]  # whether a term with edits lies below
    for i, t in enumerate(terms):
        node = 0
        fuzzy[0] = fuzzy[0] or edits[i] > 0
        for c in t:
            if number[c] not in kids[node]:
                kids[node][number[c]] = len(kids)
                kids.append({})
                ends.append([])
                fuzzy.append(False)
            node = kids[node][number[c]]
            fuzzy[node] = fuzzy[node] or edits[i] > 0
        ends[node].append(i)

    def closed(found: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Skips of a term's letter, which take an edit and no input."""
        out = set(found)
        for node, e in found:
            if e == 0:
                out |= {(kid, 1) for kid in kids[node].values() if fuzzy[kid]}
        return frozenset(x for x in out if x[1] == 0 or (x[0], 0) not in out)

    states = {closed({(0, 0)}): 1}
    queue, rows = list(states), []
    accept: list[tuple[int, int]] = [(-1, 0)]
    while len(rows) < len(queue):
        state = queue[len(rows)]
        best = min(((e, i) for node, e in state for i in ends[node] if e <= edits[i]), default=(0, -1))
        accept.append((best[1], best[0]))
        row = {}
        for c in {0} | {c for node, _ in state for c in kids[node]}:
            found = set()
            for node, e in state:
                if c in kids[node] and (e == 0 or fuzzy[kids[node][c]]):
                    found.add((kids[node][c], e))
                if e == 0:
                    if fuzzy[node]:
                        found.add((node, 1))  # a letter too many
                    found |= {(kid, 1) for d, kid in kids[node].items() if d != c and fuzzy[kid]}
            after = closed(found)
            if after and after not in states:
                states[after] = len(states) + 1
                queue.append(after)
            row[c] = states[after] if after else 0
        rows.append(row)
    step = np.zeros((len(queue) + 1, len(letters) + 1), np.int32)
    for i, row in enumerate(rows, 1):
        step[i] = row.pop(0)
        for c, to in row.items():
            step[i, c] = to
    classes = np.zeros(0x250, np.int32)
    for point in range(len(classes)):
        classes[point] = number.get(chr(point).lower(), 0)
    cases = {x: number[c] for c in letters for x in (c, c.upper(), c.title()) if len(x) == 1 and x.lower() == c}
    cases |= {"ς": number["σ"]} if "σ" in number else {}
    far = sorted(ord(x) for x in cases if ord(x) >= len(classes))
    sizes = [len(t) for t in terms] or [0]
    found = np.array(accept, np.int64)
    return Automaton(step, found[:, 0], found[:, 1], max(sizes) + 1, max(1, min(sizes) - 1), classes, np.array(far, np.int64), np.array([cases[chr(p)] for p in far], np.int32))


#: Letters and digits of all scripts, as in what is learned; accents of their own and signs without width do not part a word.
_WORDLIKE = np.array([chr(p).isalnum() for p in range(0x110000)])
_WORDLIKE[[*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]] = True


def _words_of(offsets: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    apart = ~_WORDLIKE[points]
    return _words.bounds(offsets, apart.view(np.uint8), np.array([False, True] + [False] * 254))


def run(machine: Automaton, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, term, edits) of all words that the automaton accepts, in order."""
    kinds = machine.kinds(points)
    size = end - start
    live = np.flatnonzero((size >= machine.shortest) & (size <= machine.longest))
    state = np.ones(len(live), np.int64)
    hits = []
    t = 0
    while len(live):
        ended = size[live] == t
        if ended.any():
            at, s = live[ended], state[ended]
            ok = machine.term[s] >= 0
            hits.append(np.stack([at[ok], machine.term[s[ok]], machine.edits[s[ok]]]))
            live, state = live[~ended], state[~ended]
        state = machine.step[state, kinds[start[live] + t]]
        alive = state > 0
        live, state = live[alive], state[alive].astype(np.int64)
        t += 1
    found = np.concatenate(hits, axis=1) if hits else np.empty((3, 0), np.int64)
    return tuple(found[:, np.argsort(found[0], kind="stable")])


# --- context ----------------------------------------------------------------------------------


def context(left: str, right: str, near: int) -> tuple[float, bool]:
    """(weight, whether quoted) of a hit between ``left`` and ``right``, with ``near`` other hits around."""
    line_l, line_r = left.rpartition("\n")[2], right.partition("\n")[0]
    opened = max(line_l.rfind(c) for c in _OPEN) > max(line_l.rfind(c) for c in _SHUT) and any(c in line_r for c in _SHUT)
    quoted = opened or (line_l.count('"') % 2 == 1 and '"' in line_r)
    around = [w.strip(".,;:!?\"'()") for w in (line_l.lower().split()[-6:] + line_r.lower().split()[:6])]
    weight = 1.0 + 0.5 * any(w in ADDRESS for w in around) + 0.25 * min(near, 4)
    if quoted:
        weight *= 0.3
    if any(w in SAYING for w in around):
        weight *= 0.6
    return weight, quoted


def found_in(machine: Automaton, column: pa.Array, limit: int = _words.PIECE) -> tuple[list[dict[tuple[int, int, bool], float]], np.ndarray]:
    """For each text {(term, edits, quoted): sum of window weights}, and its number of words.

    A hit or word is counted in the piece that its first character lies in;
    beyond it a piece shows two windows and the longest word that can hit.
    """
    out: list[dict[tuple[int, int, bool], float]] = [{} for _ in range(len(column))]
    n = np.zeros(len(column))
    for rows, offsets, raw, first, last in _words.overlapping(column, 4 * (2 * WINDOW + machine.longest), limit):
        head = (raw & 0xC0) != 0x80
        places = np.r_[0, np.cumsum(head)]
        cut, first, last = places[offsets], int(places[first]), int(places[last])  # in code points
        text = raw.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        start, end, row = _words_of(cut, points)
        own = (start >= first) & (start < last)
        np.add.at(n, rows, np.bincount(row[own], minlength=len(rows)))
        word, term, edits = run(machine, points, start, end)
        if not len(word):
            continue
        a, b, r = start[word], end[word], row[word]
        key = r * (len(points) + 2 * WINDOW) + a
        near = np.searchsorted(key, key + WINDOW, "right") - np.searchsorted(key, key - WINDOW, "left") - 1
        for i, (x, y, k) in enumerate(zip(a.tolist(), b.tolist(), r.tolist(), strict=True)):
            if not first <= x < last:
                continue
            left, right = text[max(int(cut[k]), x - WINDOW) : x], text[y : min(int(cut[k + 1]), y + WINDOW)]
            weight, quoted = context(left, right, int(near[i]))
            kind = (int(term[i]), int(edits[i]), quoted)
            held = out[rows[k]]
            held[kind] = held.get(kind, 0.0) + weight
    return out, n


# --- the model --------------------------------------------------------------------------------


@dataclass
class Model:
    machine: Automaton
    value: np.ndarray  # of each term
    coefficients: np.ndarray  # intercept first

    def features(self, hits: list[dict[tuple[int, int, bool], float]], n: np.ndarray) -> np.ndarray:
        """Weighed hits, quoted hits, and hits for 100 words; more of the first and last never mean less abuse."""
        x = np.zeros((len(hits), 3))
        for i, found in enumerate(hits):
            for (term, edits, quoted), w in found.items():
                x[i, int(quoted)] += self.value[term] * w * (MISSPELLED if edits else 1.0)
            x[i, 2] = 100 * x[i, 0] / max(n[i], 20)
        return np.log1p(x)

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.features(*found_in(self.machine, column))
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)))


#: Used where labels cannot teach: intercept, hits, quoted hits, density.
DEFAULT = np.array([-2.5, 1.5, 0.1, 0.5])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood."""
    z = np.c_[np.ones(len(x)), x]
    b = np.zeros(z.shape[1])
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return b


def learn_terms(sample: DataFrame) -> tuple[list[tuple[str, float]], int, int]:
    """([(term, value)], toxic families, clean families) from (doc_id, y, text).

    Near copies count once: documents are grouped by the least hash of their
    words, and shares are those of groups.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{3,24}"), F.lit(0)))
    bags = sample.select("y", words.alias("w")).filter(F.size("w") > 0)
    bags = bags.withColumn("family", F.array_min(F.transform("w", lambda x: F.xxhash64(x))))
    totals = bags.groupBy("y").agg(F.count_distinct("family").alias("n")).collect()
    n = {r["y"]: r["n"] for r in totals}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], toxic, clean
    seen = bags.select("y", "family", F.explode("w").alias("term")).distinct().groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    best = seen.withColumn("ratio", ratio).filter((F.col("t") >= LEAST_DOCS) & (F.col("ratio") >= LEAST_RATIO))
    rows = best.orderBy("term").collect()  # a part of the vocabulary of the bounded sample
    return [(r["term"], float(np.log(r["ratio"]))) for r in rows], toxic, clean


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    from ._common import materialize

    sample = materialize(labelled(docs, labels, label, TRAIN_ROWS), "toxic-sample")
    learned, _, _ = learn_terms(sample)
    value = {t: 2.5 for t in SEEDS} | dict(learned)
    terms = sorted(value)
    weights = np.array([value[t] for t in terms])
    machine = build(terms, [int(len(t) >= FUZZY_LENGTH) for t in terms])
    sent = sample.sparkSession.sparkContext.broadcast(machine)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, n = found_in(sent.value, b.column(2))
            flat = [[[t, e, int(q)] for t, e, q in h] for h in hits]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[x for y in f for x in y] for f in flat], pa.list_(pa.int32())), pa.array([list(h.values()) for h in hits], pa.list_(pa.float64())), pa.array(n)], names=["doc_id", "y", "kind", "w", "n"])

    schema = f"doc_id {dict(sample.dtypes)['doc_id']}, y int, kind array<int>, w array<double>, n double"
    found = sample.mapInArrow(collect, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "n").limit(TRAIN_ROWS)  # where ids repeat, rows are more than labels
    got = sorted(found.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["y"], r["n"]))
    y = np.array([r["y"] for r in got], float)
    hits = [{tuple(r["kind"][3 * i : 3 * i + 3]): w for i, w in enumerate(r["w"])} for r in got]
    hits = [{(t, e, bool(q)): w for (t, e, q), w in h.items()} for h in hits]
    # One edit only for terms whose misspellings keep away from clean documents that no exact term marks.
    loose = np.zeros(len(terms), np.int64)
    for h, label_ in zip(hits, y, strict=True):
        if not label_:
            for t in {t for t, e, _ in h if e}:
                loose[t] += 1
    clean = max(1, int((y == 0).sum()))
    edits = [int(len(t) >= FUZZY_LENGTH and loose[i] <= max(1, FUZZY_CLEAN * clean) and (clean >= 100 or t in SEEDS)) for i, t in enumerate(terms)]
    hits = [{k: w for k, w in h.items() if not k[1] or edits[k[0]]} for h in hits]
    machine = build(terms, edits)
    model = Model(machine, weights, DEFAULT)
    if 0 < y.sum() < len(y) and len(y) >= 50:
        x = model.features(hits, np.array([r["n"] for r in got]))
        used = x.any(axis=0)
        b = logistic(x[:, used], y)
        full = np.zeros(4)
        full[np.r_[True, used]] = b
        # What the sample has too little of keeps its prior weight.
        seen = np.r_[True, (x > 0).sum(axis=0) >= 20]
        full[~seen] = DEFAULT[~seen]
        full[[1, 3]] = np.maximum(full[[1, 3]], 0)
        model.coefficients = full
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1)))], names=["doc_id", "score"])

    slim = docs.select("doc_id", F.col("text").cast("string"))
    out = slim.mapInArrow(score, slim.select("doc_id").schema.add("score", "double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
