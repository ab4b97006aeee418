"""All registered queries over the driver's tables, and SQL for DuckDB that gives the same rows.

``documents`` are the essays, ``labels`` their grades (0 to 3), ``benchmark``
a source text, ``embeddings`` dense vectors with a grade.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import attributes as A
from quillon.operators import coherence as C
from quillon.operators import content as V
from quillon.operators import consistency, evaluation, graph, selection
from quillon.sources.staging import materialize
from quillon.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six places, -0.0 as 0.0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), PLACES) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes])


# --- measures of single documents ---------------------------------------------------------------


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _mode(array: str) -> str:
    rows = f"list_transform(list_distinct({array}), lambda v: {{'n': len(list_filter({array}, lambda x: x = v)), 'p': -list_position({array}, v), 'v': v}})"
    return f"list_max({rows}).v"


def _tag_count(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"len(list_filter(g, lambda x: x IN ({listed})))"


NT, NW, NS, NV = "len(t)", "len(f)", "len(s)", "len(list_distinct(t))"
SLENS = "list_transform(s, lambda x: len(string_split(x, ' ')))"
LENS = "list_transform(t, lambda x: length(x))"
SYL = f"coalesce(list_sum(list_transform(f, lambda w: {T.sql_syllables('w')})), 0)"
WS = _div(NW, NS)
HARD = _div(f"len(list_filter(f, lambda w: NOT list_contains({_quoted(T.EASY_WORDS)}, w)))", NW)
TTR = _div(NV, NW)
INNER = f"(CASE WHEN {NW} > 1 AND {NV} > 0 THEN 2 - ln({NV}) / ln({NW}) END)"
OVIX = f"(CASE WHEN {INNER} > 0 THEN ln({NW}) / nullif(ln({INNER}), 0) END)"
HV = "map_values(h)"
TYPES = f"coalesce(len({HV}), 0)"
_long = lambda test: f"len(list_filter({LENS}, lambda n: n {test}))"
_sent = lambda test: f"len(list_filter({SLENS}, lambda n: n {test}))"

SQL = {
    "numberOfCharacters": "length(text)",
    "numberOfCharactersNoSpaces": "length(replace(text, ' ', ''))",
    "numberOfWords": NW,
    "numberOfShortWords": _div(_long("<= 3"), NT),
    "numberOfLongWords": _div(_long(">= 7"), NT),
    "mostFrequentWordLength": _mode("lens"),
    "averageWordLength": _div("coalesce(list_sum(lens), 0)", NT),
    "numberOfSentences": NS,
    "numberOfShortSentences": _div(_sent("<= 5"), NS),
    "numberOfLongSentences": _div(_sent(">= 30"), NS),
    "mostFrequentSentenceLength": _mode("slens"),
    "averageSentenceLength": WS,
    "numberOfDifferentWords": NV,
    "numberOfStopwords": _div(f"len(list_filter(t, lambda x: list_contains({_quoted(T.STOPWORDS)}, x)))", NT),
    "gunningFogIndex": f"0.4 * ({WS} + 100 * {_div(_long('> 7'), NW)})",
    "fleschReadingEase": f"206.835 - 1.015 * {WS} - 84.6 * {_div(SYL, NW)}",
    "fleschKincaidGradeLevel": f"0.39 * {WS} + 11.8 * {_div(SYL, NW)} - 15.59",
    "daleChallReadabilityFormula": f"0.1579 * (100 * {HARD}) + 0.0496 * {WS} + CASE WHEN {HARD} > 0.05 THEN 3.6365 ELSE 0 END",
    "automatedReadabilityIndex": f"ceil(4.71 * {_div('coalesce(list_sum(list_transform(f, lambda w: length(w))), 0)', NW)} + 0.5 * {WS} - 21.43)",
    "simpleMeasureOfGobbledygook": f"1.0430 * sqrt({_div(f'len(list_filter(f, lambda w: {T.sql_syllables(chr(119))} >= 3)) * 30', NS)}) + 3.1291",
    "lix": f"{WS} + 100 * {_div(_long('>= 7'), NW)}",
    "wordVariationIndex": f"coalesce(CASE WHEN {OVIX} < 99999 THEN {OVIX} END, 0)",
    "nominalRatio": f"coalesce({_div(_tag_count('NN', 'NNP', 'NNS', 'NNPS', 'IN', 'TO', 'VBG', 'VBN'), _tag_count('PRP', 'PRP$', 'WP', 'WP$', 'RB', 'RBR', 'RBS', 'VB', 'VBD', 'VBG', 'VBN', 'VBP', 'VBZ'))}, 0)",
    "typeTokenRatio": TTR,
    "guiraudsIndex": _div(NV, f"sqrt({NW})"),
    "yulesK": f"CASE WHEN {TYPES} > 0 THEN 1e4 * (list_sum(list_transform({HV}, lambda x: x * x))::DOUBLE - {TYPES}) / ({TYPES}::DOUBLE * {TYPES}) END",
    "theDEstimate": f"CASE WHEN {TTR} = 1 THEN 0 ELSE -({NT} * {TTR} * {TTR}) / (2 * ({TTR} - 1)) END",
    "hapaxLegomena": _div(f"len(list_filter({HV}, lambda x: x = 1))", NW),
    "advancedGuiraudIndex": _div(f"len(list_filter(list_distinct(f), lambda w: NOT list_contains({_quoted(T.EASY_WORDS)}, w)))", f"sqrt({NW})"),
    "numberOfDifferentPosTags": f"len(list_distinct(list_filter(g, lambda x: NOT contains('{T.SQL_PUNCTUATION}', x)))) / 36.0::DOUBLE",
    "sentenceStructureTreeHeight": _div("coalesce(list_sum(slens), 0)", NS),
    "correctVerbForm": _div(_tag_count("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"), NW),
    **{f"pos_{t}": _tag_count("WP$" if t == "WP" else t) for t in A.TAGS},
}


def measure_sql(names: list[str]) -> str:
    """The measures ``names`` in SQL; tags and counts are made only if a measure needs them."""
    body = {n: SQL[n] for n in names}
    tagged = any("(g," in b for b in body.values())
    counted = any("(h)" in b for b in body.values())
    extra = f", list_transform(t, lambda x: {A.sql_tag('x')}) AS g" if tagged else ""
    extra += ", list_aggregate(f, 'histogram') AS h" if counted else ""
    columns = ", ".join(f'round(({b})::DOUBLE, {PLACES}) + 0.0 AS "{n}"' for n, b in body.items())
    return f"WITH {T.SQL_PREP}, full_ AS (SELECT *, {LENS} AS lens, {SLENS} AS slens{extra} FROM prep) SELECT doc_id, {columns} FROM full_"


MEASURES = {
    "basic_counts": ("basic", ["numberOfCharacters", "numberOfCharactersNoSpaces", "numberOfWords", "numberOfSentences", "numberOfDifferentWords"]),
    "basic_ratios": ("basic", ["numberOfShortWords", "numberOfLongWords", "averageWordLength", "numberOfShortSentences", "numberOfLongSentences", "averageSentenceLength"]),
    "mode_word_length": ("basic", ["mostFrequentWordLength"]),
    "mode_sentence_length": ("basic", ["mostFrequentSentenceLength"]),
    "stopword_ratio": ("basic", ["numberOfStopwords"]),
    "readability_lengths": ("readability", ["gunningFogIndex", "automatedReadabilityIndex", "lix", "wordVariationIndex"]),
    "flesch": ("readability", ["fleschReadingEase", "fleschKincaidGradeLevel"]),
    "smog": ("readability", ["simpleMeasureOfGobbledygook"]),
    "dale_chall": ("readability", ["daleChallReadabilityFormula"]),
    "nominal_ratio": ("readability", ["nominalRatio"]),
    "ttr_guiraud": ("lexical", ["typeTokenRatio", "guiraudsIndex"]),
    "yules_k": ("lexical", ["yulesK"]),
    "d_estimate": ("lexical", ["theDEstimate"]),
    "hapax": ("lexical", ["hapaxLegomena"]),
    "advanced_guiraud": ("lexical", ["advancedGuiraudIndex"]),
    "pos_profile": ("grammar", ["numberOfDifferentPosTags", "sentenceStructureTreeHeight", "correctVerbForm"]),
    "pos_pivot": ("grammar", [f"pos_{t}" for t in A.TAGS]),
}


def _measure_query(name: str, group: str, names: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(A.measures(table(spark, sf_dir, "documents"), (group,), names))

    run.__name__ = name
    return query(measure_sql(names))(run)


for _name, (_group, _names) in MEASURES.items():
    _measure_query(_name, _group, _names)


@query(f"WITH {T.SQL_PREP} SELECT doc_id, {SYL}::DOUBLE AS syllables FROM prep")
def syllable_total(spark, sf_dir):
    prepared = A.prepare(table(spark, sf_dir, "documents"))
    return prepared.select("doc_id", T.total(F.col("f"), T.syllables).alias("syllables"))


@query(f"""WITH {T.SQL_PREP} SELECT doc_id, len(list_filter(list_distinct(f), lambda w: regexp_matches(w, '^\\p{{L}}+$')
  AND NOT list_contains({_quoted(sorted({*T.STOPWORDS, *T.EASY_WORDS}))}, w)))::BIGINT AS "numberOfSpellcheckingErrors" FROM prep""")
def spell_errors(spark, sf_dir):
    from quillon.sources import tables

    return A.spelling_errors(A.prepare(table(spark, sf_dir, "documents")), tables.default_lexicon(spark))


def _counts(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for p in patterns).replace("''','", "''','")


@query("SELECT doc_id, (" + " + ".join("len(regexp_extract_all(coalesce(text, ''), '" + p.replace("'", "''") + "'))" for p in A.CAPITAL_RES) + ')::BIGINT AS "numberOfCapitalizationErrors" FROM documents')
def cap_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", A.capitalization_errors(F.coalesce("text", F.lit(""))).cast("long").alias("numberOfCapitalizationErrors"))


@query("SELECT doc_id, (" + " + ".join("len(regexp_extract_all(coalesce(text, ''), '" + p.replace("'", "''") + "'))" for p in A.PUNCTUATION_RES) + ')::BIGINT AS "numberOfPunctuationErrors" FROM documents')
def punct_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", A.punctuation_errors(F.coalesce("text", F.lit(""))).cast("long").alias("numberOfPunctuationErrors"))


# --- vector space -------------------------------------------------------------------------------


def sql_tfidf(rows: str) -> str:
    """CTEs cnt, wts (doc_id, term, w) over ``rows`` (doc_id, text)."""
    return f"""
trm AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{T.TERM_RE}'),
          lambda x: NOT list_contains({_quoted(T.STOPWORDS)}, x))) AS term FROM {rows}),
cnt AS (SELECT doc_id, term, count(*) AS n FROM trm GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(DISTINCT doc_id) FROM cnt)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM cnt GROUP BY term),
raw AS (SELECT doc_id, term, n * idf AS r FROM cnt JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(r * r)) AS nrm FROM raw GROUP BY doc_id),
wts AS (SELECT doc_id, term, r / nrm AS w FROM raw JOIN nrm USING (doc_id))"""


GRADES = "grades AS (SELECT doc_id, 2 * quality + (1 - toxic) AS grade FROM labels), graded AS (SELECT d.doc_id, d.text FROM documents d JOIN grades USING (doc_id))"


def grades_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def graded_weights(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(weights, grades): TF-IDF over the graded documents."""
    grades = grades_of(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(grades, "doc_id", "left_semi")
    return materialize(V.tfidf(V.terms(docs)), "weights"), grades


@query(f"WITH {sql_tfidf('documents')} SELECT doc_id, term, round(w, {PLACES}) AS w FROM wts")
def tfidf_weights(spark, sf_dir):
    return rounded(V.tfidf(V.terms(table(spark, sf_dir, "documents"))))


@query(f"""WITH r AS (SELECT doc_id, text FROM documents UNION ALL (SELECT -1, text FROM benchmark ORDER BY item_id LIMIT 1)), {sql_tfidf("r")}
SELECT a.doc_id, round(coalesce(sum(a.w * b.w), 0), {PLACES}) AS cosine FROM wts a LEFT JOIN (SELECT * FROM wts WHERE doc_id = -1) b USING (term)
WHERE a.doc_id <> -1 GROUP BY a.doc_id""")
def cosine_source(spark, sf_dir):
    source = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.lit(-1).cast("long").alias("doc_id"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(source)
    return rounded(V.cosine_source(V.terms(docs), -1))


@query(f"""WITH {GRADES}, {sql_tfidf("graded")},
dots AS (SELECT a.doc_id, b.doc_id AS neighbour, round(sum(a.w * b.w), 9) AS cosine FROM wts a JOIN wts b USING (term) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, neighbour) AS k FROM dots)
SELECT b.doc_id, neighbour, round(cosine, {PLACES}) AS cosine, grade::DOUBLE AS "scoreCosineSimilarityMax" FROM best b JOIN grades g ON g.doc_id = neighbour WHERE k = 1""")
def nearest_graded(spark, sf_dir):
    return rounded(V.nearest(*graded_weights(spark, sf_dir)))


@query(f"""WITH {GRADES}, {sql_tfidf("graded")},
top AS (SELECT grade FROM grades ORDER BY grade DESC, doc_id LIMIT 5),
refs AS (SELECT f.reference, count(*) AS times FROM top JOIN (SELECT grade, min(doc_id) AS reference FROM grades GROUP BY grade) f USING (grade) GROUP BY ALL),
dots AS (SELECT a.doc_id, sum(a.w * b.w * times) AS dot FROM wts a JOIN wts b USING (term) JOIN refs ON b.doc_id = reference WHERE a.doc_id <> reference GROUP BY a.doc_id)
SELECT i.doc_id, round(coalesce(dot, 0) / greatest((SELECT sum(times) FROM refs) - coalesce(r.times, 0), 1), {PLACES}) AS "cosineTopEssaySimilarityAverage"
FROM (SELECT DISTINCT doc_id FROM wts) i LEFT JOIN dots USING (doc_id) LEFT JOIN refs r ON r.reference = i.doc_id""")
def top5_similarity(spark, sf_dir):
    return rounded(V.top_similarity(*graded_weights(spark, sf_dir)))


POINTS = f"""{GRADES}, {sql_tfidf("graded")},
pts AS (SELECT unnest(range((SELECT min(grade) FROM grades)::BIGINT, (SELECT max(grade) FROM grades)::BIGINT + 1)) AS point),
sums AS (SELECT grade, term, sum(w) AS v FROM wts JOIN grades USING (doc_id) GROUP BY ALL),
own AS (SELECT doc_id, grade AS point, sum(w * v) AS dot FROM wts JOIN sums USING (term) GROUP BY ALL),
sizes AS (SELECT grade AS point, count(*) AS size FROM grades GROUP BY ALL),
means AS (SELECT g.doc_id, p.point, coalesce(size, 0) - (g.grade = p.point)::INT AS n,
    coalesce(dot, 0) - CASE WHEN g.grade = p.point AND g.doc_id IN (SELECT doc_id FROM wts) THEN 1 ELSE 0 END AS d
  FROM grades g CROSS JOIN pts p LEFT JOIN own o ON o.doc_id = g.doc_id AND o.point = p.point LEFT JOIN sizes s ON s.point = p.point),
mean AS (SELECT doc_id, point, CASE WHEN n > 0 THEN d / n ELSE 0 END AS mean FROM means)"""


@query(f"WITH {POINTS} SELECT doc_id, point::INT AS point, round(mean, {PLACES}) + 0.0 AS mean FROM mean")
def score_point_means(spark, sf_dir):
    return rounded(V.similarity_by_grade(*graded_weights(spark, sf_dir)))


@query(f"""WITH {POINTS},
k AS (SELECT doc_id, point, round(mean, 9) AS mean, row_number() OVER (PARTITION BY doc_id ORDER BY round(mean, 9), point) AS r,
  row_number() OVER (PARTITION BY doc_id ORDER BY point) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM mean),
a AS (SELECT doc_id, min(point) AS lo, max(point) AS hi, sum(point * r) AS p, sum(point * i) AS hp, sum(point * (n + 1 - i)) AS lp,
  sum(CASE WHEN i > floor(n / 2) THEN mean ELSE -mean END) AS c FROM k GROUP BY doc_id)
SELECT doc_id, round((hi - lo) * (p - lp)::DOUBLE / nullif((hp - lp)::DOUBLE, 0) + lo, {PLACES}) AS "cosinePattern", round(c, {PLACES}) + 0.0 AS "cosineSumOfCorrelationValues" FROM a""")
def cosine_pattern(spark, sf_dir):
    return rounded(V.pattern(V.similarity_by_grade(*graded_weights(spark, sf_dir))))


@query(f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
fl AS (SELECT vec_id, label, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS v FROM u),
s AS (SELECT label AS point, i, sum(v) AS s FROM fl GROUP BY ALL),
n AS (SELECT label AS point, count(*) AS n FROM embeddings GROUP BY ALL),
d AS (SELECT vec_id, label, point, sum(v * s) AS dot FROM fl JOIN s USING (i) GROUP BY ALL)
SELECT vec_id, point, round(CASE WHEN n - (label = point)::INT > 0 THEN (dot - (label = point)::INT) / (n - (label = point)::INT) ELSE 0 END, {PLACES}) + 0.0 AS mean FROM d JOIN n USING (point)""")
def embedding_means(spark, sf_dir):
    return rounded(V.embedding_similarity(table(spark, sf_dir, "embeddings")))


# --- coherence ----------------------------------------------------------------------------------

WINDOWS = f"""{T.SQL_PREP},
wd AS (SELECT doc_id, list_filter(f, lambda x: NOT list_contains({_quoted(T.STOPWORDS)}, x)) AS words FROM prep),
sz AS (SELECT floor(avg(len(words)) * 0.25)::INT AS w0 FROM wd),
fi AS (SELECT doc_id, words, len(words) AS n, w0, len(list_filter(range(0, 31), lambda k: len(words) <= (w0 >> k::INT) AND (w0 >> k::INT) > 0)) AS h FROM wd, sz),
fj AS (SELECT *, w0 >> h::INT AS w, [10, 5, 2, 1][least(h, 3) + 1] AS step FROM fi),
fk AS (SELECT *, list_filter(list_transform(range(0, greatest(0, floor((n - w) / step)::BIGINT + 1) + 1), lambda k: words[k * step + 1 : k * step + w]),
  lambda p: length(array_to_string(p, '')) > 1) AS parts FROM fj),
pt AS (SELECT doc_id, CASE WHEN n > 0 AND len(parts) > 0 THEN parts ELSE [['0']] END AS parts FROM fk),
win AS (SELECT doc_id, unnest(range(0, len(parts))) AS win, unnest(parts) AS part FROM pt)"""

VECTORS = f"""{WINDOWS},
lg AS (SELECT doc_id, win, unnest(list_filter(part, lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]{{2,}}$'))) AS term FROM win),
ct AS (SELECT doc_id, win, term, count(*) AS n FROM lg GROUP BY ALL),
tot AS (SELECT doc_id, count(*) AS cnt FROM win GROUP BY ALL),
idf AS (SELECT c.doc_id, term, ln((1.0::DOUBLE + any_value(cnt)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM ct c JOIN tot USING (doc_id) GROUP BY ALL),
raw AS (SELECT doc_id, win, term, n * idf AS r FROM ct JOIN idf USING (doc_id, term)),
nrm AS (SELECT doc_id, win, sqrt(sum(r * r)) AS nrm FROM raw GROUP BY ALL),
vec AS (SELECT doc_id, win, term, r / nrm AS w FROM raw JOIN nrm USING (doc_id, win))"""


def _words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.content_words(F.col("text")).alias("words"))


def _measured(spark, sf_dir, *names: str) -> DataFrame:
    """Some of the coherence measures.  Equal windows lie at a distance of rounding errors, whose root is about 1e-8: five places."""
    out = C.coherence(table(spark, sf_dir, "documents").select("doc_id", "text"), names=names)
    return out.select("doc_id", *[(F.round(n, 5) + F.lit(0.0)).alias(n) for n in names])


@query(f"WITH {WINDOWS} SELECT doc_id, count(*)::BIGINT AS n_windows, sum(len(part))::BIGINT AS n_words FROM win GROUP BY doc_id")
def windows(spark, sf_dir):
    words = _words(spark, sf_dir)
    return C.windows(words, C.window_size(words)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.size("part")).alias("n_words"))


@query(f"WITH {VECTORS} SELECT doc_id, count(DISTINCT term)::BIGINT AS n_terms, count(*)::BIGINT AS n_weights, round(sum(w), {PLACES}) AS total FROM vec GROUP BY doc_id")
def window_tfidf(spark, sf_dir):
    words = _words(spark, sf_dir)
    return rounded(C.vector_totals(words, C.window_size(words)))


@query(f"""WITH {VECTORS},
dt AS (SELECT a.doc_id, a.win, sum(a.w * b.w) AS dot FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.term = b.term AND b.win = a.win + 1 GROUP BY ALL),
has AS (SELECT w.doc_id, w.win, (n.nrm IS NOT NULL)::INT AS has FROM win w LEFT JOIN nrm n USING (doc_id, win)),
st AS (SELECT *, lead(has) OVER (PARTITION BY doc_id ORDER BY win) AS nx FROM has),
ds AS (SELECT s.doc_id, sqrt(greatest(0, has + nx - 2 * coalesce(dot, 0))) AS e, CASE WHEN has = 1 AND nx = 1 THEN 1 - coalesce(dot, 0) ELSE 0 END AS c
  FROM st s LEFT JOIN dt USING (doc_id, win) WHERE nx IS NOT NULL),
ag AS (SELECT doc_id, avg(e) AS ae, max(e) AS xe, avg(c) AS ac, max(c) AS xc FROM ds GROUP BY doc_id)
SELECT i.doc_id, round(coalesce(ae, 0), 5) + 0.0 AS "avgDistanceNeighbouringPointsEuc", round(coalesce(xe, 0), 5) + 0.0 AS "maxDistanceNeighbouringPointsEuc",
  round(coalesce(ac, 0), 5) + 0.0 AS "avgDistanceNeighbouringPointsCos", round(coalesce(xc, 0), 5) + 0.0 AS "maxDistanceNeighbouringPointsCos"
FROM (SELECT DISTINCT doc_id FROM win) i LEFT JOIN ag USING (doc_id)""")
def neighbour_distances(spark, sf_dir):
    return _measured(spark, sf_dir, *[f"{k}DistanceNeighbouringPoints{m}" for m in ("Euc", "Cos") for k in ("avg", "max")])


@query(f"""WITH {VECTORS},
cr AS (SELECT a.doc_id, a.term, sum(a.w * b.w) AS xy FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.term = b.term AND b.win = a.win + 1 GROUP BY ALL),
en AS (SELECT v.doc_id, term, any_value(cnt) AS n, sum(w) AS x, sum(w * w) AS xx, sum(CASE WHEN win = 0 THEN w ELSE 0 END) AS f, sum(CASE WHEN win = cnt - 1 THEN w ELSE 0 END) AS l
  FROM vec v JOIN tot USING (doc_id) GROUP BY ALL),
tm AS (SELECT e.*, coalesce(xy, 0) AS xy, xx - n * (x / n) * (x / n) AS sp FROM en e LEFT JOIN cr USING (doc_id, term)),
sm AS (SELECT doc_id, count(*) AS k, sum(sp) AS sp,
  sum(CASE WHEN sp > 1e-12 THEN 2 * (xy - (x / n) * (2 * x - f - l) + (n - 1) * (x / n) * (x / n)) / sp ELSE 0 END) AS m,
  sum(CASE WHEN sp > 1e-12 THEN 2 * (2 * xx - f * f - l * l - 2 * xy) / sp ELSE 0 END) AS g FROM tm GROUP BY doc_id)
SELECT t.doc_id, round(sqrt(greatest(0, coalesce(sp, 0) / cnt)), 5) + 0.0 AS "standardDistance",
  round(CASE WHEN cnt > 1 AND k > 0 THEN cnt * m / (2.0::DOUBLE * (cnt - 1) * k) ELSE 0 END, 5) + 0.0 AS "moransI",
  round(CASE WHEN cnt > 1 AND k > 0 THEN (cnt - 1) * g / (4.0::DOUBLE * (cnt - 1) * k) ELSE 0 END, 5) + 0.0 AS "gearysC"
FROM tot t LEFT JOIN sm USING (doc_id)""")
def dispersion(spark, sf_dir):
    return _measured(spark, sf_dir, "standardDistance", "moransI", "gearysC")


PAIRS = f"""{VECTORS},
has AS (SELECT w.doc_id, w.win, (n.nrm IS NOT NULL)::INT AS has FROM win w LEFT JOIN nrm n USING (doc_id, win)),
dt AS (SELECT a.doc_id, a.win AS i, b.win AS j, sum(a.w * b.w) AS dot FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.term = b.term AND a.win < b.win GROUP BY ALL),
pr AS (SELECT a.doc_id, a.win AS i, b.win AS j, sqrt(greatest(0, a.has + b.has - 2 * coalesce(dot, 0))) AS e,
    CASE WHEN a.has = 1 AND b.has = 1 THEN 1 - coalesce(dot, 0) ELSE 0 END AS c
  FROM has a JOIN has b ON a.doc_id = b.doc_id AND a.win < b.win LEFT JOIN dt ON dt.doc_id = a.doc_id AND dt.i = a.win AND dt.j = b.win)"""


@query(f"""WITH {PAIRS}, ag AS (SELECT doc_id, avg(e) AS ae, max(e) AS xe, avg(c) AS ac, max(c) AS xc FROM pr GROUP BY doc_id)
SELECT t.doc_id, round(coalesce(ae, 0), 5) + 0.0 AS "avgDistanceAnyPointsEuc", round(coalesce(xe, 0), 5) + 0.0 AS "maxDistanceAnyPointsEuc",
  round(coalesce(ac, 0), 5) + 0.0 AS "avgDistanceAnyPointsCos", round(greatest(coalesce(xc, 0), 0), 5) + 0.0 AS "maxDistanceAnyPointsCos" FROM tot t LEFT JOIN ag USING (doc_id)""")
def any_point_distances(spark, sf_dir):
    return _measured(spark, sf_dir, *[f"{k}DistanceAnyPoints{m}" for m in ("Euc", "Cos") for k in ("avg", "max")])


@query(f"""WITH {PAIRS}, nn AS (SELECT doc_id, i, min(e) AS near FROM (SELECT doc_id, i, e FROM pr UNION ALL SELECT doc_id, j, e FROM pr) GROUP BY ALL),
mn AS (SELECT doc_id, avg(near) AS mean FROM nn GROUP BY doc_id),
cf AS (SELECT doc_id, any_value(mean) AS mean, avg((near <= mean + 1e-6)::INT) AS share FROM nn JOIN mn USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, round(coalesce(2 * sqrt(cnt) * mean, 0), 5) + 0.0 AS "clarkEvansNearestNeighbour", round(coalesce(mean, 0), 5) + 0.0 AS "avgDistanceNearestNeighbour",
  round(coalesce(share, 0), 5) + 0.0 AS "cumulativeFrequencyDistribution" FROM tot t LEFT JOIN cf USING (doc_id)""")
def nearest_windows(spark, sf_dir):
    return _measured(spark, sf_dir, "clarkEvansNearestNeighbour", "avgDistanceNearestNeighbour", "cumulativeFrequencyDistribution")


@query(f"""WITH {VECTORS},
ce AS (SELECT v.doc_id, term, sum(w) / any_value(cnt) AS c FROM vec v JOIN tot USING (doc_id) GROUP BY ALL),
cc AS (SELECT doc_id, sum(c * c) AS cc FROM ce GROUP BY doc_id),
xc AS (SELECT v.doc_id, win, sum(w * c) AS xc FROM vec v JOIN ce USING (doc_id, term) GROUP BY ALL),
ds AS (SELECT w.doc_id, w.win, sqrt(greatest(0, (xc IS NOT NULL)::INT + coalesce(cc, 0) - 2 * coalesce(xc, 0))) AS e,
    CASE WHEN xc IS NOT NULL AND cc > 0 THEN 1 - xc / sqrt(cc) ELSE 0 END AS c FROM win w LEFT JOIN xc USING (doc_id, win) LEFT JOIN cc ON cc.doc_id = w.doc_id)
SELECT doc_id, round(avg(e), 5) + 0.0 AS "avgDistanceCentroidEuc", round(min(e), 5) + 0.0 AS "minDistanceCentroidEuc", round(max(e), 5) + 0.0 AS "maxDistanceCentroidEuc",
  round(avg(c), 5) + 0.0 AS "avgDistanceCentroidCos", round(min(c), 5) + 0.0 AS "minDistanceCentroidCos", round(max(c), 5) + 0.0 AS "maxDistanceCentroidCos" FROM ds GROUP BY doc_id""")
def centroid_distances(spark, sf_dir):
    return _measured(spark, sf_dir, *[f"{k}DistanceCentroid{m}" for m in ("Euc", "Cos") for k in ("avg", "min", "max")])


@query(f"""WITH {PAIRS}, av AS (SELECT doc_id, avg(e) AS mean FROM pr GROUP BY doc_id),
cl AS (SELECT p.doc_id, i, j FROM pr p JOIN av USING (doc_id) WHERE e <= mean + 1e-6),
tp AS (SELECT a.doc_id, a.term, 2 * sum(a.w * b.w) AS top FROM cl JOIN vec a ON a.doc_id = cl.doc_id AND a.win = i JOIN vec b ON b.doc_id = cl.doc_id AND b.win = j AND b.term = a.term GROUP BY ALL),
al AS (SELECT doc_id, term, sum(w) * sum(w) - sum(w * w) AS every FROM vec GROUP BY ALL),
sm AS (SELECT doc_id, sum(CASE WHEN abs(every) > 1e-12 THEN coalesce(top, 0) / every ELSE 0 END) / count(*) AS g FROM al LEFT JOIN tp USING (doc_id, term) GROUP BY doc_id)
SELECT t.doc_id, round(CASE WHEN cnt > 1 THEN coalesce(g, 0) ELSE 0 END, 5) + 0.0 AS "getissG" FROM tot t LEFT JOIN sm USING (doc_id)""")
def getis_g(spark, sf_dir):
    return _measured(spark, sf_dir, "getissG")


@query()
def coherence_all(spark, sf_dir):
    return rounded(C.coherence(table(spark, sf_dir, "documents").select("doc_id", "text")))


# --- evaluation ---------------------------------------------------------------------------------

PRED = "p AS (SELECT l.doc_id, 2 * quality + (1 - toxic) AS true_, (n_chars % 9) / 2.0::DOUBLE AS predicted, (l.doc_id % 10)::INT AS fold FROM labels l JOIN documents d USING (doc_id)), q AS (SELECT *, round_even(predicted, 0) AS r FROM p)"
_CHANCE = "sum(r * r) + sum(true_ * true_)::DOUBLE - 2 * sum(r) * sum(true_) / count(*)"
KAPPA = f"CASE WHEN abs({_CHANCE}) > 1e-12 THEN 1 - sum((r - true_) * (r - true_)) / ({_CHANCE}) END"


def predictions(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return grades_of(spark, sf_dir).join(docs, "doc_id").select("doc_id", F.col("grade").alias("true"), ((F.col("n_chars") % 9) / 2.0).alias("predicted"), (F.col("doc_id") % 10).cast("int").alias("fold"))


FOLDED = f"""{PRED}, f AS (SELECT fold, count(*) AS n, avg((r = true_)::INT) AS agreement, 1 - avg(abs(r - true_)) AS closeness, {KAPPA} AS kappa FROM q GROUP BY ROLLUP (fold))"""


@query(f"WITH {FOLDED} SELECT fold, n::BIGINT AS n, round(agreement, 6) AS agreement, round(closeness, 6) AS closeness, round(kappa, 6) AS kappa FROM f")
def qwk_by_fold(spark, sf_dir):
    return rounded(evaluation.by_fold(predictions(spark, sf_dir)).drop("is_total"))


@query(f"""WITH {FOLDED} SELECT round(max(CASE WHEN fold IS NULL THEN agreement END), 5) AS "exactAgreement", round(max(CASE WHEN fold IS NULL THEN kappa END), 5) AS "weightedKappa",
  round(avg(CASE WHEN fold IS NOT NULL THEN closeness END), 5) AS "exactAgreementFolds", round(avg(CASE WHEN fold IS NOT NULL THEN kappa END), 5) AS "weightedKappaFolds" FROM f""")
def score_predictions(spark, sf_dir):
    return evaluation.score_predictions(predictions(spark, sf_dir))


@query(f'WITH {PRED} SELECT true_::INT AS "true", r::INT AS predicted, count(*)::BIGINT AS n FROM q GROUP BY ALL')
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(predictions(spark, sf_dir))


@query(f"WITH {PRED} SELECT true_::INT AS rating, count(*)::BIGINT AS n FROM q GROUP BY ALL")
def rating_histogram(spark, sf_dir):
    return evaluation.histogram(predictions(spark, sf_dir))


@query("""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM labels)
SELECT doc_id, least(floor(idx / floor(n / 10)), 10)::INT AS fold FROM i""")
def kfold_assignment(spark, sf_dir):
    return selection.folds(grades_of(spark, sf_dir), "doc_id").select("doc_id", "fold")


@query("""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM labels),
j AS (SELECT *, floor(n / 10)::BIGINT AS c, n % 10 AS e FROM i)
SELECT doc_id, (CASE WHEN idx < e * (c + 1) THEN floor(idx / (c + 1)) ELSE e + floor((idx - e * (c + 1)) / c) END)::INT AS fold FROM j""")
def kfold_even(spark, sf_dir):
    return selection.folds(grades_of(spark, sf_dir), "doc_id", even=True).select("doc_id", "fold")


_FS = ["numberOfCharacters", "averageWordLength", "numberOfSentences", "averageSentenceLength", "numberOfDifferentWords"]


@query(f"""WITH {GRADES}, m AS ({measure_sql(_FS)}), j AS (SELECT m.*, grade FROM m JOIN grades USING (doc_id)),
c AS ({" UNION ALL ".join(f"SELECT '{n}' AS name, corr(" + chr(34) + n + chr(34) + ", grade) AS r, count(*) AS n FROM j" for n in _FS)})
SELECT name, round(r * r * (n - 2) / (1 - r * r), 4) AS f FROM c""")
def feature_scores(spark, sf_dir):
    data = rounded(A.measures(table(spark, sf_dir, "documents"), ("basic",), _FS)).join(grades_of(spark, sf_dir), "doc_id")
    return selection.f_scores(data, _FS).select("name", F.round("f", 4).alias("f"))


@query("""WITH w AS (SELECT (doc_id % 5)::INT AS fold, lang AS name, floor(count(*) / 10) AS weight FROM documents GROUP BY ALL)
SELECT fold, name, rank() OVER (PARTITION BY fold ORDER BY weight DESC) + (count(*) OVER (PARTITION BY fold, weight) - 1) / 2.0::DOUBLE AS rank FROM w""")
def attribute_ranks(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 5).cast("int").alias("fold"), F.col("lang").alias("name")).agg(F.floor(F.count(F.lit(1)) / 10).alias("weight"))
    return selection.average_ranks(counts)


def _training(spark, sf_dir, names: list[str]) -> DataFrame:
    data = A.measures(table(spark, sf_dir, "documents"), ("basic", "lexical"), names)
    return data.join(selection.folds(grades_of(spark, sf_dir), "doc_id", 5), "doc_id")


@query()
def cross_validation(spark, sf_dir):
    return evaluation.score_predictions(selection.cross_predict(_training(spark, sf_dir, _FS).cache(), _FS, "ridge", 5))


# --- graph --------------------------------------------------------------------------------------

EDGES = """e AS (SELECT 'customer' || c_custkey AS child, 'nation' || c_nationkey AS parent FROM customer
  UNION ALL SELECT 'nation' || n_nationkey, 'region' || n_regionkey FROM nation UNION ALL SELECT 'region' || r_regionkey, 'world' FROM region)"""


def edges_of(spark, sf_dir) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(name("customer", "c_custkey").alias("child"), name("nation", "c_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(name("nation", "n_nationkey").alias("child"), name("region", "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(name("region", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return c.unionByName(n).unionByName(r)


@query(f"WITH RECURSIVE {EDGES}, c AS (SELECT child, parent, 1 AS steps FROM e UNION SELECT c.child, e.parent, c.steps + 1 FROM c JOIN e ON c.parent = e.child) SELECT child, parent, min(steps)::INT AS steps FROM c GROUP BY ALL")
def subclass_closure(spark, sf_dir):
    return graph.closure(edges_of(spark, sf_dir))


def statements_of(spark, sf_dir) -> DataFrame:
    """Line items as statements: the customer keeps, returns or awaits a kind of part."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    said = F.when(F.col("l_returnflag") == "R", "not keeps").when(F.col("l_returnflag") == "A", "keeps").otherwise("awaits")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sent"), F.lit("customer").alias("subject"),
        said.alias("predicate"), (F.col("l_partkey") % 50).cast("string").alias("object"),
    )


STATED = """s AS (SELECT o_custkey AS doc_id, l_orderkey * 10 + l_linenumber AS sent, 'customer' AS subject,
  CASE l_returnflag WHEN 'R' THEN 'not keeps' WHEN 'A' THEN 'keeps' ELSE 'awaits' END AS predicate, (l_partkey % 50)::VARCHAR AS object
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {STATED} SELECT a.doc_id, a.sent, a.subject, a.predicate, a.object, min(b.sent) AS with_sent, arg_min(b.predicate, b.sent) AS with_predicate
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.object = b.object AND b.sent < a.sent
WHERE (a.predicate, b.predicate) IN (('keeps', 'not keeps'), ('not keeps', 'keeps')) GROUP BY ALL""")
def conflicts(spark, sf_dir):
    rows = statements_of(spark, sf_dir)
    return graph.property_conflicts(rows, graph.negations(rows))


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child),
r AS (SELECT n_nationkey AS doc_id, 0 AS sent, 'nation' || n_nationkey AS subject, 'trades' AS predicate, 'region' || n_regionkey AS object FROM nation)
SELECT *, false AS inferred FROM r UNION ALL SELECT doc_id, sent, subject, predicate, child, true FROM r JOIN c ON c.parent = r.object""")
def propagated(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("sent"), F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("subject"), F.lit("trades").alias("predicate"),
        F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("object"),
    )
    return graph.propagate(rows, edges_of(spark, sf_dir))


_CLAUSE = graph.CLAUSE.replace("'", "''")
TRIPLES = f"""{T.SQL_PREP},
parts AS (SELECT doc_id, generate_subscripts(s, 1)::INT - 1 AS sent, unnest(s) AS x FROM prep),
matched AS (SELECT doc_id, sent, regexp_extract(x, '{_CLAUSE}', ['a', 'n', 'p', 'o']) AS m FROM parts WHERE regexp_matches(x, '{_CLAUSE}')),
named AS (SELECT doc_id, sent, regexp_replace(lower(m.a), '^(a|an|the) ', '') AS subject, CASE WHEN m.n <> '' THEN 'not ' ELSE '' END || lower(m.p) AS predicate,
  regexp_replace(lower(m.o), '^(a|an|the) ', '') AS object FROM matched),
said AS (SELECT * FROM named WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> '' AND lower(subject) <> lower(object))"""


@query(f"WITH {TRIPLES} SELECT * FROM said")
def triples(spark, sf_dir):
    return graph.triples(table(spark, sf_dir, "documents"))


@query(f"""WITH {TRIPLES}, wrong AS (SELECT a.doc_id, a.sent, a.subject, a.predicate, a.object, min(b.sent) AS at, arg_min(b.predicate, b.sent) AS other
  FROM said a JOIN said b ON a.doc_id = b.doc_id AND a.subject = b.subject AND a.object = b.object AND b.sent < a.sent AND (a.predicate = 'not ' || b.predicate OR b.predicate = 'not ' || a.predicate) GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n, string_agg('''' || concat_ws(' ', subject, predicate, object) || ''' contradicts ''' || concat_ws(' ', subject, other, object) || '''', '; ' ORDER BY sent) AS detail FROM wrong GROUP BY doc_id),
every AS (SELECT DISTINCT doc_id FROM documents)
SELECT doc_id AS "essayId", 0.0::DOUBLE AS "consistencyErrors", coalesce(n, 0)::DOUBLE AS "semanticErrors", coalesce(n, 0)::DOUBLE AS sum,
  CASE WHEN n > 0 THEN 'The text contradicts itself in ' || n || ' place(s).' ELSE '' END AS feedback, coalesce(detail, '') AS feedback_detail FROM every LEFT JOIN told USING (doc_id)""")
def feedback(spark, sf_dir):
    return graph.check_consistency(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""WITH m AS (SELECT DISTINCT p_name AS text, string_split(p_name, ' ') AS a FROM part), n AS (SELECT 'part' || p_partkey AS uri, p_partkey AS ord, string_split(lower(p_name || ' ' || p_type), ' ') AS b FROM part),
k AS (SELECT text, uri, ord, 2.0::DOUBLE * len(list_filter(a, lambda w: list_contains(b, w))) / (len(a) + len(b)) AS similarity FROM m, n)
SELECT text, arg_min(uri, ord) AS uri, round(arg_min(similarity, ord), 6) AS similarity FROM k WHERE similarity >= 0.7 GROUP BY text""")
def near_nodes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_partkey").alias("ord"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    return rounded(graph.fuzzy_links(part.select(F.col("p_name").alias("text")), nodes), "text", "uri")


BORDERS = "d AS (SELECT 'region' || r_regionkey AS a, 'region' || (r_regionkey + 1) AS b FROM region)"


def borders_of(spark, sf_dir) -> DataFrame:
    """Regions with neighbouring keys are disjoint."""
    region = lambda k: F.concat(F.lit("region"), F.col("r_regionkey") + k)
    return table(spark, sf_dir, "region").select(region(0).alias("a"), region(1).alias("b"))


@query(f"""WITH RECURSIVE {EDGES}, {BORDERS}, c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child),
t AS (SELECT DISTINCT o_custkey AS doc_id, 'buyer' AS entity, 'nation' || (o_orderkey % 25) AS class FROM orders),
u AS (SELECT doc_id, entity, class AS k FROM t UNION SELECT doc_id, entity, parent FROM t JOIN c ON c.child = t.class)
SELECT DISTINCT x.doc_id, x.entity, d.a, d.b FROM u x JOIN d ON x.k = d.a JOIN u y ON y.doc_id = x.doc_id AND y.entity = x.entity AND y.k = d.b""")
def class_conflicts(spark, sf_dir):
    types = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("buyer").alias("entity"), F.concat(F.lit("nation"), F.col("o_orderkey") % 25).alias("class"))
    return graph.class_conflicts(types.distinct(), edges_of(spark, sf_dir), borders_of(spark, sf_dir))


TRADES = """t AS (SELECT o_custkey AS doc_id, o_orderkey::INT AS sent, 'buyer' AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'likes' WHEN 1 THEN 'not likes' ELSE 'sees' END AS predicate,
  CASE WHEN o_orderkey % 4 = 0 THEN 'region' || (o_orderkey % 5) ELSE 'nation' || (o_orderkey % 25) END AS object FROM orders)"""


def trades_of(spark, sf_dir) -> DataFrame:
    """Orders as statements of liking, disliking or seeing a nation or a region."""
    key = F.col("o_orderkey")
    what = F.when(key % 4 == 0, F.concat(F.lit("region"), key % 5)).otherwise(F.concat(F.lit("nation"), key % 25))
    said = F.when(key % 3 == 0, "likes").when(key % 3 == 1, "not likes").otherwise("sees")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.cast("int").alias("sent"), F.lit("buyer").alias("subject"), said.alias("predicate"), what.alias("object"))


@query(f"""WITH RECURSIVE {EDGES}, {TRADES}, c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child),
n AS (SELECT child AS a, parent AS b FROM c UNION SELECT parent, child FROM c UNION SELECT object, object FROM t),
w AS (SELECT x.doc_id, x.sent, x.subject, x.predicate, x.object, min({{'s': y.sent, 'p': y.predicate, 'o': y.object}}) AS w
  FROM t x JOIN n ON n.a = x.object JOIN t y ON y.doc_id = x.doc_id AND y.subject = x.subject AND y.object = n.b AND y.sent < x.sent
  WHERE (x.predicate, y.predicate) IN (('likes', 'not likes'), ('not likes', 'likes')) GROUP BY ALL)
SELECT doc_id, sent, subject, predicate, object, w.s AS with_sent, w.p AS with_predicate, w.o AS with_object FROM w""")
def inherited_conflicts(spark, sf_dir):
    rows = trades_of(spark, sf_dir)
    return graph.inherited_conflicts(rows, graph.negations(rows), edges_of(spark, sf_dir))


@query(f"""WITH {TRADES} SELECT q.doc_id, q.subject, 'likes' AS predicate, q.object, min(t.sent) AS sent FROM (SELECT DISTINCT doc_id, subject, object FROM t) q
LEFT JOIN t ON t.doc_id = q.doc_id AND t.subject = q.subject AND t.object = q.object AND t.predicate = 'likes' GROUP BY ALL""")
def statement_index(spark, sf_dir):
    rows = trades_of(spark, sf_dir)
    return consistency.statement_index(rows.withColumn("predicate", F.lit("likes")), rows)


@query()
def guarded_insertion(spark, sf_dir):
    """Orders as statements, each with the addition of a class of the buyer."""
    rows = trades_of(spark, sf_dir)
    said = rows.withColumns({"step": F.lit(1), "kind": F.lit("triple")})
    added = rows.withColumns({"step": F.lit(0), "kind": F.lit("axiom"), "predicate": F.lit("type")})
    return consistency.guarded(said.unionByName(added), edges_of(spark, sf_dir), borders_of(spark, sf_dir), graph.negations(rows))


# --- event time ---------------------------------------------------------------------------------


@query("""WITH e AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_id % 4 AS true_, (user_id % 5)::DOUBLE AS r FROM events),
k AS (SELECT start, count(*) AS n, avg((r = true_)::INT) AS agreement, sum((r - true_) * (r - true_)) AS apart,
  sum(r * r) + sum(true_ * true_)::DOUBLE - 2 * sum(r) * sum(true_) / count(*) AS chance FROM e GROUP BY start)
SELECT start, n::BIGINT AS n, round(agreement, 6) AS agreement, round(CASE WHEN abs(chance) > 1e-12 THEN 1 - apart / chance END, 6) AS kappa FROM k""")
def event_agreement(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", (F.col("event_id") % 4).cast("int").alias("true"), (F.col("user_id") % 5).cast("double").alias("predicted"))
    return rounded(streams.windowed_agreement(events))
