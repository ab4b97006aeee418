"""Per-document measures: basic, readability, lexical diversity, grammar, errors.

All are projections over a prepared row (see :func:`prepare`): no shuffle, no
Python worker.  Undefined ratios are null; where a measure is defined as 0 for
a degenerate input, that is stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

SHORT_WORD, LONG_WORD, SHORT_SENTENCE, LONG_SENTENCE = 3, 7, 5, 30


def prepare(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tagger=None, counted: bool = False) -> DataFrame:
    """Columns ``keep``, text, t (tokens), f (words), s (sentences), lens, slens and, if asked for, tags and counts.

    ``tagger`` maps the column of tokens to a column of part-of-speech tags;
    :func:`rule_tags` is the default of the grammar group.  ``counts`` are the
    :func:`frequencies` of the words, behind a generator of one row, so that
    measures that name several of its fields share one sort and fold.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(*keep, own.alias("text"), T.tokens(own).alias("t"), T.sentences(own).alias("s"))
    base = base.withColumns({"f": T.words(F.col("t")), "lens": F.transform("t", F.length), "slens": F.transform("s", T.sentence_words)})
    if counted:
        base = base.select("*", F.explode(F.array(frequencies(F.col("f")))).alias("counts"))
    return base.withColumn("tags", tagger(F.col("t"))) if tagger else base


def _sizes() -> tuple[Column, Column, Column, Column]:
    """Numbers of tokens, words, sentences and distinct tokens."""
    return F.size("t"), F.size("f"), F.size("s"), F.size(F.array_distinct("t"))


def _basic(stopwords: list[str] | tuple[str, ...]) -> dict[str, Column]:
    n_t, n_w, n_s, n_v = _sizes()
    return {
        "numberOfCharacters": F.length("text"),
        "numberOfCharactersNoSpaces": F.length(F.replace("text", F.lit(" "), F.lit(""))),
        "numberOfWords": n_w,
        "numberOfShortWords": T.ratio(T.count_if("lens", lambda n: n <= SHORT_WORD), n_t),
        "numberOfLongWords": T.ratio(T.count_if("lens", lambda n: n >= LONG_WORD), n_t),
        "mostFrequentWordLength": T.mode_first(F.col("lens")),
        "averageWordLength": T.ratio(T.total(F.col("lens"), lambda n: n), n_t),
        "numberOfSentences": n_s,
        "numberOfShortSentences": T.ratio(T.count_if("slens", lambda n: n <= SHORT_SENTENCE), n_s),
        "numberOfLongSentences": T.ratio(T.count_if("slens", lambda n: n >= LONG_SENTENCE), n_s),
        "mostFrequentSentenceLength": T.mode_first(F.col("slens")),
        "averageSentenceLength": T.ratio(n_w, n_s),
        "numberOfDifferentWords": n_v,
        "numberOfStopwords": T.ratio(T.count_if("t", lambda t: T.listed(t, stopwords)), n_t),
    }


def _readability(easy: list[str] | tuple[str, ...]) -> dict[str, Column]:
    _, n_w, n_s, n_v = _sizes()
    syllable_total = T.total(F.col("f"), T.syllables)
    per_sentence = T.ratio(n_w, n_s)
    hard = T.ratio(T.count_if("f", lambda w: ~T.listed(w, easy)), n_w)
    log_w = F.ln(n_w.cast("double"))
    inner = F.when((n_w > 1) & (n_v > 0), 2 - T.ratio(F.ln(n_v.cast("double")), log_w))
    ovix = F.when(inner > 0, T.ratio(log_w, F.ln(inner)))
    finite = F.when(ovix.isNotNull() & ~F.isnan(ovix) & (ovix < 99999), ovix).otherwise(F.lit(0.0))
    nouns = _tags("NN", "NNP", "NNS", "NNPS", "IN", "TO", "VBG", "VBN")
    others = _tags("PRP", "PRP$", "WP", "WP$", "RB", "RBR", "RBS", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
    return {
        "gunningFogIndex": 0.4 * (per_sentence + 100 * T.ratio(T.count_if("lens", lambda n: n > LONG_WORD), n_w)),
        "fleschReadingEase": 206.835 - 1.015 * per_sentence - 84.6 * T.ratio(syllable_total, n_w),
        "fleschKincaidGradeLevel": 0.39 * per_sentence + 11.8 * T.ratio(syllable_total, n_w) - 15.59,
        "daleChallReadabilityFormula": 0.1579 * (100 * hard) + 0.0496 * per_sentence + F.when(hard > 0.05, 3.6365).otherwise(0.0),
        "automatedReadabilityIndex": F.ceil(4.71 * T.ratio(T.total(F.col("f"), F.length), n_w) + 0.5 * per_sentence - 21.43),
        "simpleMeasureOfGobbledygook": 1.0430 * F.sqrt(T.ratio(T.count_if("f", lambda w: T.syllables(w) >= 3) * 30, n_s)) + 3.1291,
        "lix": per_sentence + 100 * T.ratio(T.count_if("lens", lambda n: n >= LONG_WORD), n_w),
        "wordVariationIndex": finite,
        "nominalRatio": F.coalesce(T.ratio(nouns, others), F.lit(0.0)),
    }


def frequencies(array: Column) -> Column:
    """Counts of the distinct values of an array, by one sort and one fold over it (linear, not a count for each value)."""
    ordered = F.array_sort(array)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("squares"), F.lit(0).alias("types"), F.lit(0).alias("once"))

    def step(acc: Column, w: Column) -> Column:
        same = acc["last"].eqNullSafe(w)
        n = F.when(same, acc["n"] + 1).otherwise(F.lit(1))
        # The square of a run's length grows by 2 n - 1 with each member.
        return F.struct(
            w.alias("last"), n.alias("n"), (acc["squares"] + (2 * n - 1)).alias("squares"),
            (acc["types"] + F.when(same, 0).otherwise(1)).alias("types"),
            (acc["once"] + F.when(n == 1, 1).when(n == 2, -1).otherwise(0)).alias("once"),
        )

    return F.aggregate(ordered, start, step)


def _lexical(easy: list[str] | tuple[str, ...]) -> dict[str, Column]:
    n_t, n_w, _, n_v = _sizes()
    counts = F.col("counts")
    ttr = T.ratio(n_v, n_w)
    types = counts["types"].cast("double")
    return {
        "typeTokenRatio": ttr,
        "guiraudsIndex": T.ratio(n_v, F.sqrt(n_w.cast("double"))),
        "yulesK": F.when(types > 0, 1e4 * (counts["squares"] - types) / (types * types)),
        "theDEstimate": F.when(ttr == 1, F.lit(0.0)).otherwise(-(n_t * ttr * ttr) / (2 * (ttr - 1))),
        "hapaxLegomena": T.ratio(counts["once"], n_w),
        "advancedGuiraudIndex": T.ratio(F.size(F.array_except(F.array_distinct("f"), T.literal_words(easy))), F.sqrt(n_w.cast("double"))),
    }


# --- grammar ----------------------------------------------------------------------------------

TAGS = tuple("CC CD DT EX FW IN JJ JJR JJS LS MD NN NNS NNP NNPS PDT POS PRP PRP$ RB RBR RBS RP SYM TO UH VB VBD VBG VBN VBP VBZ WDT WP WRB".split())
N_TAGS = 36

#: Closed classes of the default tagger: tag, words.
CLOSED = (
    ("CC", "and or but nor yet"),
    ("DT", "the a an this that these those each every no"),
    ("PRP", "i you he she it we they me him us them"),
    ("PRP$", "my your his her its our their"),
    ("TO", "to"),
    ("MD", "can could may might must shall should will would"),
    ("IN", "of in on at by for with from as if because about into over under between"),
    ("WP", "who whom what"),
    ("WP$", "whose"),
    ("WDT", "which"),
    ("WRB", "how when where why"),
    ("EX", "there"),
    ("RB", "not very also never always often too"),
    ("VBZ", "is has does"),
    ("VBP", "am are have do"),
    ("VBD", "was were had did"),
    ("VB", "be"),
    ("VBN", "been"),
    ("VBG", "being"),
    ("UH", "oh ah hello"),
)
#: Open classes: tag, regular expression.  What a match must end or begin with is tested first (:data:`HINTS`), as that is cheap.
SHAPES = (
    ("CD", r"^[0-9]+$"),
    ("VBG", r"^[\p{L}]{2,}ing$"),
    ("VBD", r"^[\p{L}]{2,}ed$"),
    ("RB", r"^[\p{L}]{2,}ly$"),
    ("JJS", r"^[\p{L}]{2,}est$"),
    ("JJR", r"^[\p{L}]{3,}er$"),
    ("JJ", r"^[\p{L}]{2,}(ble|ful|ous|ive|al|ic|less)$"),
    ("NNS", r"^[\p{L}]{2,}[^s]s$"),
    ("SYM", r"^[^\p{L}\p{N}_]+$"),
)
#: What any match of a shape fulfils.
HINTS = {
    "CD": lambda t: (t >= "0") & (t < ":"),
    "VBG": lambda t: t.endswith("ing"),
    "VBD": lambda t: t.endswith("ed"),
    "RB": lambda t: t.endswith("ly"),
    "JJS": lambda t: t.endswith("est"),
    "JJR": lambda t: t.endswith("er"),
    "JJ": lambda t: reduce(lambda a, b: a | b, [t.endswith(x) for x in ("ble", "ful", "ous", "ive", "al", "ic", "less")]),
    "NNS": lambda t: t.endswith("s"),
    "SYM": lambda t: (t < "a") | (t >= "{"),
}


def rule_tags(token_array: Column) -> Column:
    """Penn tags by closed word lists and endings; a token that is punctuation is its own tag."""

    def tag(token: Column) -> Column:
        (first, listed), *others = CLOSED
        closed = F.when(token.isin(*listed.split()), first)
        for name, listed in others:
            closed = closed.when(token.isin(*listed.split()), name)
        out = F.when(F.contains(F.lit(T.PUNCTUATION), token), token).when(T.listed(token, " ".join(words for _, words in CLOSED).split()), closed)
        for name, shape in SHAPES:
            out = out.when(HINTS[name](token) & token.rlike(shape), name)
        return out.otherwise("NN")

    return F.transform(token_array, tag)


def sql_tag(token: str) -> str:
    parts = [f"WHEN contains('{T.SQL_PUNCTUATION}', {token}) THEN {token}"]
    for name, listed in CLOSED:
        quoted = ", ".join(f"'{w}'" for w in listed.split())
        parts.append(f"WHEN {token} IN ({quoted}) THEN '{name}'")
    parts += [f"WHEN regexp_matches({token}, '{shape}') THEN '{name}'" for name, shape in SHAPES]
    return f"CASE {' '.join(parts)} ELSE 'NN' END"


def _tags(*names: str) -> Column:
    return T.count_if("tags", lambda t: t.isin(*names))


def _tag_count(name: str) -> Column:
    """How often a tag is there, as :func:`_tags`, from one line of all tags that the counts of a row share."""
    line = F.concat(F.lit("\x01"), F.array_join("tags", "\x01\x01"), F.lit("\x01"))
    one = F.lit(f"\x01{name}\x01")
    return ((F.octet_length(line) - F.octet_length(F.replace(line, one, F.lit("")))) / F.octet_length(one)).cast("int")


def tree_height(heads: Column) -> Column:
    """Height of a dependency tree from 1-based head positions (0: root); a leaf is 1, no tree is 0.

    As many passes as the tree is high would do; folding over the positions
    once for each level keeps it an expression.  Heads are bounded by the
    length of a sentence.
    """
    n = F.size(heads)

    def depth(start: Column) -> Column:
        walk = F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            F.struct(start.alias("at"), F.lit(0).alias("d")),
            lambda acc, _: F.when(acc["at"] > 0, F.struct(F.get(heads, acc["at"] - 1).alias("at"), (acc["d"] + 1).alias("d"))).otherwise(acc),
            lambda acc: acc["d"],
        )
        return walk

    return F.when(n > 0, F.array_max(F.transform(F.sequence(F.lit(1), n), depth))).otherwise(F.lit(0))


def _grammar(heads: str | None = None) -> dict[str, Column]:
    """``heads`` names a column with an array of head positions for each sentence, as a parser gives them."""
    _, n_w, n_s, _ = _sizes()
    words = F.array_distinct(F.filter("tags", lambda t: ~F.contains(F.lit(T.PUNCTUATION), t)))
    out = {
        "numberOfDifferentPosTags": F.size(words) / F.lit(float(N_TAGS)),
        # Without a parser, sentences hang together as chains to the next word: the height is the number of pieces.
        "sentenceStructureTreeHeight": T.ratio(T.total(F.col(heads), tree_height), F.size(heads)) if heads else T.ratio(T.total(F.col("slens"), lambda n: n), n_s),
        "correctVerbForm": T.ratio(_tags("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"), n_w),
    }
    # The count of possessive wh-pronouns is the one kept under pos_WP.
    return out | {f"pos_{t}": _tag_count("WP$" if t == "WP" else t) for t in TAGS}


# --- errors -----------------------------------------------------------------------------------

#: A sentence that starts with a small letter, or the pronoun I written small.
CAPITAL_RES = (r"(^|[.!?]\s+)\p{Ll}", r"\bi\b")
#: A space before a mark, no space after one, or a doubled mark.
PUNCTUATION_RES = (r"\s[,;:!?]", r"[,;]\p{L}", r",,|;;|::")


def capitalization_errors(text: Column) -> Column:
    out = F.lit(0)
    for r in CAPITAL_RES:
        out = out + F.regexp_count(text, F.lit(r))
    return out


def punctuation_errors(text: Column) -> Column:
    out = F.lit(0)
    for r in PUNCTUATION_RES:
        out = out + F.regexp_count(text, F.lit(r))
    return out


def spelling_errors(prepared: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, numberOfSpellcheckingErrors): distinct words of letters that ``lexicon`` (word) lacks."""
    own = prepared.select("doc_id", F.explode_outer(F.array_distinct(F.filter("f", lambda w: w.rlike(r"^\p{L}+$")))).alias("word"))
    known = lexicon.select("word").distinct().withColumn("known", F.lit(1))
    joined = own.join(known, "word", "left")
    return joined.groupBy("doc_id").agg(F.count(F.when(F.col("word").isNotNull() & F.col("known").isNull(), 1)).alias("numberOfSpellcheckingErrors"))


# --- registry ---------------------------------------------------------------------------------

GROUPS = ("basic", "readability", "lexical", "grammar")


def group(name: str, stopwords: list[str] | None = None, easy: list[str] | None = None, heads: str | None = None) -> dict[str, Column]:
    """Columns of a group in their fixed order."""
    stop, simple = stopwords or T.STOPWORDS, easy or T.EASY_WORDS
    return {"basic": lambda: _basic(stop), "readability": lambda: _readability(simple), "lexical": lambda: _lexical(simple), "grammar": lambda: _grammar(heads)}[name]()


def measures(docs: DataFrame, groups: tuple[str, ...] = GROUPS, names: list[str] | None = None, tagger=rule_tags, **lists) -> DataFrame:
    """doc_id and the measures of ``groups`` in their order, as doubles; ``names`` selects some."""
    keep = ("doc_id", *([lists["heads"]] if lists.get("heads") else []))
    prepared = prepare(docs, keep=keep, tagger=tagger if {"grammar", "readability"} & set(groups) else None, counted="lexical" in groups and (names is None or bool({"yulesK", "hapaxLegomena"} & set(names))))
    columns = {k: c for g in groups for k, c in group(g, **lists).items() if names is None or k in names}
    return prepared.select("doc_id", *[c.cast("double").alias(k) for k, c in columns.items()])


def dictionary_syllables(docs: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """(doc_id, syllables): words of ``pronunciations`` (word, syllables) have the least number listed, others that of the rules.

    Texts give (doc_id, word, n) with repeats already summed; each different
    word is looked up, or scored by the rules, once.
    """
    words = prepare(docs).select("doc_id", F.explode_outer("f").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    listed = pronunciations.groupBy("word").agg(F.min("syllables").alias("listed"))
    scored = words.select("word").distinct().join(listed, "word", "left").select("word", F.coalesce("listed", T.syllables(F.col("word"))).alias("k"))
    joined = words.join(scored, "word", "left")
    return joined.groupBy("doc_id").agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).cast("long").alias("syllables"))
