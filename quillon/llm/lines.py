"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are the parts of a text between newlines, without outer spaces; blank
ones are left alone.  Equal lines are one class, and so are lines of at least
``LEAST_CHARS`` characters within one edit of each other, and what such links
connect.  Of each class the first occurrence by (doc_id, line number) stays.

The join: with a threshold of one edit a line of length n is split into two
segments, one of which the other line must hold unchanged, the first aligned
to its start or the second aligned to its end.  The index is keyed by length,
segment and its hash; a line probes with its own length and with one less.
Keys are counted first, with map-side sums; only rows of keys with company go
on.  A key of more than ``BUCKET`` rows is split: what is left between the
equal ends is halved again, and one half must be equal too, until at most one
character is left.  So every bucket ends up small without dropping a pair.

Pairs of small buckets are verified by a banded bit-parallel edit distance on
the part between their equal ends: one machine word for each number of edits
holds the diagonals of the band, and a fold over the characters updates them.

A line's number is a 64-bit hash.  Different lines that share one are found by
an aggregate over all lines and given other numbers, so no two lines are ever
taken for one.  Links without a distance check need 128 equal bits.

Defined cases: a null, empty or blank text has no lines.  Every row is a
document of its own, whether its doc_id is repeated or null: rows are told
apart by doc_id and the MD5 of their text, and ordered by them, null ids last.
Of rows equal in both, one counts as the first and all lines of the others
repeat it.  Empty tables give empty results; extra columns are ignored by
:func:`dedup_report` and kept, whatever their names, by :func:`dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _graph
from ._common import materialize, small, table, unused

LEAST_CHARS = 20
BUCKET = 32
#: Parts of a line of which all but one must be unchanged before a pair is verified.
BLOCKS = 16


def _hash(line: Column, attempt: int = 0) -> Column:
    return F.xxhash64(F.lit(attempt), line) if attempt else F.xxhash64(line)


def ids_tell(docs: DataFrame) -> bool:
    """Whether doc_id alone tells the rows apart."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 or doc_id is null").take(1)


def row_key(text: Column, told: bool) -> Column:
    """What tells rows of one doc_id, or without any, apart; the same for all if there are none such."""
    return F.lit("") if told else F.md5(F.coalesce(text.cast("string"), F.lit("")))


def occurrences(docs: DataFrame, told: bool, moved: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, pos, line, id) of every line that is not blank; ``moved`` has the ids of lines that may not have their hash."""
    keyed = docs.select("doc_id", row_key(F.col("text"), told).alias("row"), F.split(F.col("text").cast("string"), "\n").alias("lines"))
    parts = keyed.select("doc_id", "row", F.posexplode("lines").alias("pos", "raw"))
    found = parts.select("doc_id", "row", "pos", F.trim("raw").alias("line")).filter("line <> ''").withColumn("id", _hash(F.col("line")))
    if moved is None:
        return found
    other = F.broadcast(moved.select(F.col("line").alias("m_line"), F.col("id").alias("m_id")))
    joined = found.join(other, F.col("line") == F.col("m_line"), "left")
    return joined.select("doc_id", "row", "pos", "line", F.coalesce("m_id", "id").alias("id"))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((id, line, n) of all different lines with an id of their own, the (line, id) whose id is not their hash)."""
    lines = materialize(occurrences(docs, True).groupBy("id", "line").agg(F.count(F.lit(1)).alias("n")), "lines")
    moved, attempt = None, 0
    while True:
        shared = materialize(lines.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id"), "line-clashes")
        if not shared.take(1):
            return lines, moved
        shared = lines.join(F.broadcast(shared), "id").groupBy("id").agg(F.min("line").alias("first"))
        attempt += 1
        # About n**2 / 2**65 pairs: none up to billions of lines, some hundreds among 1e11.
        clash = lines.join(F.broadcast(shared), "id", "left")
        other = F.when(F.col("first").isNotNull() & (F.col("line") != F.col("first")), _hash(F.col("line"), attempt)).otherwise(F.col("id"))
        lines = materialize(clash.select(other.alias("id"), "line", "n"), "lines")
        moved = materialize(lines.filter(F.col("id") != _hash(F.col("line"))).select("line", "id"), "lines-moved")


# --- candidates -------------------------------------------------------------------------------


def _key(line: Column, size: Column, a: Column, b: Column, seed: int = 0) -> Column:
    """A hash of the length of the shorter line and the characters fixed at the start and at the end."""
    parts = (size, a, b, F.substring(line, F.lit(1), a), F.right(line, b))
    return F.xxhash64(F.lit(seed), *parts) if seed else F.xxhash64(*parts)


def first_keys(lines: DataFrame) -> DataFrame:
    """(id, n, long, a, b, key, key2): a row for each key of a line; ``n`` is the shorter length, ``long`` whether the line has one more."""
    own = F.length("line")
    specs = []
    for long in (0, 1):
        n = own - long
        head = F.floor(n / 2).cast("int")
        zero = F.lit(0)
        specs += [F.struct(n.alias("n"), F.lit(long).alias("long"), a.alias("a"), b.alias("b"), _key(F.col("line"), n, a, b).alias("key"), F.lit(None).cast("long").alias("key2")) for a, b in ((head, zero), (zero, n - head))]
    rows = lines.select("id", F.explode(F.array(*specs)).alias("k")).select("id", "k.*")
    return rows.filter(F.col("n") >= LEAST_CHARS)


def _halved(rows: DataFrame) -> DataFrame:
    """Keys of rows (with their line) that fix half of what is left as well; ``key2`` is a second hash where at most one character is left then."""
    left = F.col("n") - F.col("a") - F.col("b")
    half = F.floor(left / 2).cast("int")
    # Of one character left, a longer line has two, and the shorter one's is the first or the last of them.
    head, tail = F.greatest(half, F.lit(1)), F.greatest(left - half, F.lit(1))
    pairs = ((F.col("a") + head, F.col("b")), (F.col("a"), F.col("b") + tail))
    n, line = F.col("n"), F.col("line")
    check = lambda a, b: F.when(n - a - b <= 1, _key(line, n, a, b, 1)).alias("key2")
    specs = [F.struct(n, F.col("long"), a.alias("a"), b.alias("b"), _key(line, n, a, b).alias("key"), check(a, b)) for a, b in pairs]
    return rows.select("id", F.explode(F.array(*specs)).alias("k")).select("id", "k.*")


def candidates(lines: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """((x, y) pairs to verify, (a, b) sure links) among different ``lines`` (id, line), which should be materialised."""
    keys = first_keys(lines)
    verify, sure = None, None
    while True:
        sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(1 - F.col("long")).alias("short"))
        sizes = materialize(sizes.filter("rows > 1 and short > 0"), "line-keys")
        kept = materialize(keys.join(small(sizes.select("key", "rows")), "key"), "line-company")
        cold = kept.filter(F.col("rows") <= bucket).select("id", "key", "long")
        x = cold.filter("long = 0").select(F.col("id").alias("x"), "key")
        y = cold.select(F.col("id").alias("y"), "key", "long")
        found = x.join(y, "key").filter("x < y or (long = 1 and x <> y)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        verify = found if verify is None else verify.unionByName(found)
        # With at most one character left, lines of a key and length differ in it alone: links without a check.
        hot = kept.filter(F.col("rows") > bucket)
        left = F.col("n") - F.col("a") - F.col("b")
        ended = hot.filter((left <= 1) & (F.col("long") == 0) | (left == 0))
        ended = materialize(ended.select("id", "key", "key2"), "line-ended")
        low = small(materialize(ended.groupBy("key", "key2").agg(F.min("id").alias("low")), "line-lows"))
        star = ended.join(low, ["key", "key2"]).select(F.col("id").alias("a"), F.col("low").alias("b"))
        sure = star if sure is None else sure.unionByName(star)
        # Longer lines beside a shorter one with one free character go on with it.
        more = hot.filter(left >= 1).select("id", "n", "long", "a", "b")
        more = materialize(more, "line-hot")
        if not more.take(1):
            return verify.distinct(), sure.filter("a <> b").distinct()
        keys = _halved(more.join(lines.select("id", "line"), "id"))


# --- verification -----------------------------------------------------------------------------


def within(x: Column, y: Column, tau: int = 1) -> Column:
    """Whether two strings are within ``tau`` edits, by bit-parallel steps over the diagonals of a band.

    Bit d + tau of word e: after the characters of ``x`` so far, position
    (their number + d) of ``y`` is reached with e edits.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    chars = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    # Beside each character of x come those of y that the band meets there, so that a step costs the same anywhere.
    beside = [F.concat(F.array_repeat(F.lit(None).cast("string"), -d), chars(y)) if d < 0 else F.slice(chars(y), d + 1, F.length(y) + 1) for d in range(-tau, tau + 1)]
    zipped = F.arrays_zip(chars(x), *beside)
    start, word = [], 1 << tau
    for _ in range(tau + 1):
        start.append(F.lit(word).cast("int"))
        word = (word | word << 1) & full
    names = [f"r{e}" for e in range(tau + 1)]
    zero = F.struct(*[s.alias(n) for s, n in zip(start, names, strict=True)])

    def step(acc: Column, z: Column) -> Column:
        same = F.lit(0)
        for k in range(width):
            same = same + F.when(z[str(k + 1)] == z["0"], F.lit(1 << k)).otherwise(F.lit(0))
        new = [acc["r0"].bitwiseAND(same)]
        for e in range(1, tau + 1):
            old = acc[f"r{e - 1}"]
            moved = acc[f"r{e}"].bitwiseAND(same).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1))
            new.append(moved.bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full)))
        after = F.struct(*[v.cast("int").alias(n) for v, n in zip(new, names, strict=True)])
        return F.when(z["0"].isNull(), acc).otherwise(after)  # beyond the end of x

    gap = F.length(y) - F.length(x)

    def reached(acc: Column) -> Column:
        word = acc["r0"]
        for n in names[1:]:
            word = word.bitwiseOR(acc[n])
        return word.bitwiseAND(_bit(gap + tau, width)) != 0

    return (F.abs(gap) <= tau) & F.aggregate(zipped, zero, step, reached)


def _bit(at: Column, width: int) -> Column:
    out = F.lit(0)
    for k in range(width):
        out = F.when(at == k, F.lit(1 << k)).otherwise(out)
    return out


def verified(pairs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows of ``pairs`` (lx, ly with their lengths nx, ny, ...) within one edit.

    Of ``blocks`` parts of the shorter line all but one must be unchanged,
    aligned to the start before it and to the end after it.  Parts are compared
    from either end up to the first that differs, which rules out most pairs
    after a look at few of them; equal ends don't change a distance, so only
    the part between them goes through the bit-parallel steps.
    """
    swap = F.col("nx") > F.col("ny")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    rows = pairs.filter(F.abs(F.col("nx") - F.col("ny")) <= 1).withColumns({"short": pick("lx", "ly"), "tall": pick("ly", "lx"), "n": pick("nx", "ny"), "m": pick("ny", "nx")})
    n, m = F.col("n"), F.col("m")
    edge = lambda j: F.floor(j * n / blocks).cast("int")

    def same(j: Column, shift: Column) -> Column:
        size = edge(j + 1) - edge(j)
        return F.substring(F.col("short"), edge(j) + 1, size) == F.substring(F.col("tall"), edge(j) + 1 + shift, size)

    def run(test) -> Column:
        """How many of the tests 0, 1, ... hold before the first that doesn't; none is made after it."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(blocks - 1)), F.lit(0), lambda acc, k: F.when((acc == k) & test(k), acc + 1).otherwise(acc))

    lead = run(lambda k: same(k, F.lit(0)))
    trail = run(lambda k: same(blocks - 1 - k, m - n))
    rows = rows.withColumn("j", F.least(lead, F.lit(blocks - 1))).withColumn("trail", trail).filter(F.col("j") + F.col("trail") >= blocks - 1)
    head, tail = edge(F.col("j")), n - edge(F.col("j") + 1)
    part = lambda c, size: F.substring(F.col(c), head + 1, size - head - tail)
    return rows.filter(within(part("short", n), part("tall", m)))


def classes(lines: DataFrame) -> DataFrame:
    """(node, root) of all lines (id, line) that link to another."""
    verify, sure = candidates(lines.filter(F.length("line") >= LEAST_CHARS))
    verify = materialize(verify, "line-pairs")
    ids = materialize(verify.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "line-ids")
    texts = materialize(lines.select("id", "line", F.length("line").alias("n")).join(small(ids), "id", "left_semi"), "line-texts")
    x, y = (texts.select(F.col("id").alias(k), F.col("line").alias(f"l{k}"), F.col("n").alias(f"n{k}")) for k in "xy")
    spark = lines.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # Few bytes but much work a row: dealt by number, so that small files don't end up in a task or two.
    pairs = verify.join(x, "x").join(y, "y").repartition(tasks, "x", "y")
    linked = verified(pairs).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _graph.components(linked.unionByName(sure))


def dropped(docs: DataFrame, told: bool | None = None) -> DataFrame:
    """(doc_id, row, pos, class_id) of every line that repeats an earlier one of another row, or of its own at another place."""
    told = ids_tell(docs) if told is None else told
    lines, moved = numbered(docs)
    roots = materialize(classes(lines), "line-roots")
    alone = lines.filter("n > 1").select("id").join(roots.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.col("id").alias("class_id"))
    repeated = materialize(roots.select(F.col("node").alias("id"), F.col("root").alias("class_id")).unionByName(alone), "line-classes")
    found = occurrences(docs, told, moved).select("doc_id", "row", "pos", "id").join(small(repeated), "id")
    found = materialize(found.select("doc_id", "row", "pos", "class_id"), "line-repeats")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("row"), F.col("pos"))
    # Counted and broadcast if few, so that a class of very many lines stays spread.
    first = small(materialize(found.groupBy("class_id").agg(F.min(place).alias("first")), "line-first"))
    later = found.join(first, "class_id").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "row", "pos", "class_id")
    return later if told else later.distinct()


def _lists(docs: DataFrame, told: bool) -> DataFrame:
    """(g_id, g_row, dropped): the sorted numbers of the dropped lines of each row that has any."""
    gone = dropped(docs, told).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return gone.withColumnsRenamed({"doc_id": "g_id", "row": "g_row"})


def _copies(rows: DataFrame, doc_id: str, row: str, uid: str) -> DataFrame | None:
    """(c_id, c_row, first): the rows that come more than once, with the least ``uid``; None if there are none."""
    many = rows.groupBy(F.col(doc_id).alias("c_id"), F.col(row).alias("c_row")).agg(F.count(F.lit(1)).alias("k"), F.min(uid).alias("first"))
    many = materialize(many.filter("k > 1").select("c_id", "c_row", "first"), "line-copies")
    return small(many) if many.take(1) else None


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0, ascending) of every row."""
    parts = F.split(F.col("text").cast("string"), "\n")
    none = F.array().cast("array<int>")
    told = ids_tell(docs)
    if told:
        n = F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0))
        slim = docs.select("doc_id", F.greatest(n, F.lit(0)).cast("long").alias("n_lines"))
        gone = _lists(docs, told)
        out = slim.join(gone, slim["doc_id"] == gone["g_id"], "left").select("doc_id", "n_lines", F.coalesce("dropped", none).alias("dropped"))
        return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")
    solid = F.filter(F.transform(parts, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    slim = docs.select("doc_id", row_key(F.col("text"), told).alias("row"), F.coalesce(solid, none).alias("lines"), F.monotonically_increasing_id().alias("uid"))
    slim = materialize(slim, "line-rows")
    gone = _lists(docs, told)
    out = slim.join(gone, slim["doc_id"].eqNullSafe(gone["g_id"]) & (slim["row"] == gone["g_row"]), "left")
    drops = F.coalesce("dropped", none)
    copies = _copies(slim, "doc_id", "row", "uid")
    if copies is not None:
        out = out.join(copies, out["doc_id"].eqNullSafe(copies["c_id"]) & (out["row"] == copies["c_row"]), "left")
        drops = F.when(F.col("uid") != F.col("first"), F.col("lines")).otherwise(drops)
    out = out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), drops.alias("dropped"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts; other lines, and all rows, stay as they are."""
    row, uid, gid, grow, drops, cid, crow, first = unused(docs, "row", "uid", "g_id", "g_row", "dropped", "c_id", "c_row", "first")
    told = ids_tell(docs)
    gone = _lists(docs, told).withColumnsRenamed({"g_id": gid, "g_row": grow, "dropped": drops})
    keyed = docs.withColumn(row, row_key(F.col("text"), told))
    copies = None if told else _copies(docs.select("doc_id", row_key(F.col("text"), told).alias("row"), F.lit(0).alias("uid")), "doc_id", "row", "uid")
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def cleaned(rows: DataFrame, all_of_it: Column) -> DataFrame:
        joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone[gid]) & (rows[row] == gone[grow]), "left")
        parts = F.split(F.col("text").cast("string"), "\n")
        left = F.filter(parts, lambda x, i: ~F.array_contains(F.col(f"`{drops}`"), i))
        blank = F.filter(parts, lambda x: F.trim(x) == "")
        own = F.when(all_of_it, F.array_join(blank, "\n")).when(F.col(f"`{drops}`").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
        return joined.select(*[own.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])

    if copies is None:
        return cleaned(keyed, F.lit(False))
    copies = copies.withColumnsRenamed({"c_id": cid, "c_row": crow}).drop("first")
    same = keyed["doc_id"].eqNullSafe(copies[cid]) & (keyed[row] == copies[crow])
    # Only rows that come more than once are written, with a number that tells them apart.
    many = materialize(keyed.join(copies, same, "left_semi").withColumn(uid, F.monotonically_increasing_id()), "line-copied-rows")
    firsts = _copies(many, "doc_id", row, uid).withColumnsRenamed({"c_id": cid, "c_row": crow, "first": first})
    marked = many.join(firsts, many["doc_id"].eqNullSafe(firsts[cid]) & (many[row] == firsts[crow])).select(*columns, row, uid, first)
    again = cleaned(marked, F.col(uid) != F.col(first))
    return cleaned(keyed.join(copies, same, "left_anti"), F.lit(False)).unionByName(again)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents")).withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


#: Lines one edit apart agree once a character is left out of both at one place, or of the longer one.
SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS r FROM documents),
p AS (SELECT r, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t),
o AS (SELECT r, pos, trim(raw, ' ') AS line FROM p WHERE trim(raw, ' ') <> ''),
l AS (SELECT line, row_number() OVER (ORDER BY line) AS id, length(line) AS n FROM (SELECT DISTINCT line FROM o)),
q AS (SELECT id, n, unnest(range(1, n + 1)) AS i, line FROM l WHERE n >= {LEAST_CHARS}),
v AS (SELECT id, n, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS h, substr(line, 1, i - 1) || substr(line, i + 1) AS rest FROM q),
e AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM v a JOIN v b ON a.h = b.h AND a.n = b.n AND a.i = b.i AND a.rest = b.rest AND a.id <> b.id
  UNION SELECT DISTINCT a.id, b.id FROM v a JOIN l b ON a.rest = b.line AND b.n >= {LEAST_CHARS}
  UNION SELECT DISTINCT b.id, a.id FROM v a JOIN l b ON a.rest = b.line AND b.n >= {LEAST_CHARS}),
w AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id),
c AS (SELECT id, min(root) AS class FROM w GROUP BY id),
m AS (SELECT r, pos, coalesce(class, id) AS class FROM o JOIN l USING (line) LEFT JOIN c USING (id)),
d AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY r, pos) AS k FROM m),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dropped, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (k > 1), '') AS dropped FROM d GROUP BY r)
SELECT t.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(dropped, '') AS dropped
FROM t LEFT JOIN g USING (r)
"""
