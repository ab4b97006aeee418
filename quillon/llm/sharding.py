"""Sharding over fixed virtual slots, in DataFrame functions only.

Records hash into ``n_slots`` virtual slots.  Bytes are summed per slot, and a
versioned table maps slots to shards: the heaviest slot first, each to the
shard that is lightest so far.  Rebalancing edits the map, never the hash: only
rows of reassigned slots move.

The largest state is the map, one row a slot.  Document texts never shuffle:
the scan reduces each row to id, size, checksum and slot.

Defined cases: a null text has size 1 and checksum 0.  A null ``doc_id`` hashes
by its text's checksum, so that many of them spread.  Repeated rows stay
separate rows, next to each other in one slot; only where a slot gets far more
rows than others, its records of over ``COPIES`` rows are spread over all
slots, so that no slot is a hot group.  Empty tables give empty
results.  Extra columns are kept by :func:`assign` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, new_path, small, unused

N_SLOTS = 8192
N_SHARDS = 16
#: Most rows of one record (doc_id and text) in a slot that has far more rows than the mean.
COPIES = 1000
#: Given to the reader, as the map of an empty table has no files.
MAP = "vslot int, shard int, bytes long, n_rows long, version int"


def sizes(text: Column) -> tuple[Column, Column]:
    """(UTF-8 bytes plus 1, unsigned CRC-32 of the UTF-8 bytes)."""
    full = F.coalesce(text, F.lit(""))
    return F.octet_length(full).cast("long") + 1, F.crc32(full.cast("binary"))


def slot_of(doc_id: Column, text_crc32: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record; a function of the record alone."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), text_crc32.cast("string")))
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def weigh(docs: DataFrame, n_slots: int = N_SLOTS, text: str = "text") -> DataFrame:
    """One slim row a document: doc_id, size, text_crc32, vslot."""
    size, crc = sizes(F.col(text))
    slim = docs.select(F.col("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    return slim.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), n_slots))


def slot_bytes(slim: DataFrame) -> DataFrame:
    return slim.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def hot_records(slim: DataFrame, weights: DataFrame, n_slots: int, copies: int) -> DataFrame | None:
    """(h_id, h_crc) of the records with over ``copies`` rows in slots of over ``copies`` rows and four times the mean; None if there are none."""
    total = weights.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    heavy = weights.filter(F.col("n_rows") > copies + 4 * total / n_slots).select("vslot")  # at most a quarter of the slots
    if not heavy.take(1):
        return None
    rows = slim.join(F.broadcast(heavy), "vslot").groupBy(F.col("doc_id").alias("h_id"), F.col("text_crc32").alias("h_crc")).agg(F.count(F.lit(1)).alias("n"))
    found = materialize(rows.filter(F.col("n") > copies).select("h_id", "h_crc"), "hot-records")
    return small(found) if found.take(1) else None


def spread(rows: DataFrame, hot: DataFrame, n_slots: int, doc_id: str = "doc_id", crc: str = "text_crc32", vslot: str = "vslot") -> DataFrame:
    """``rows`` with the slots of ``hot`` records drawn anew for each row, by the row's place in its file."""
    names = unused(rows, "h_id", "h_crc", "h_any")
    marked = hot.withColumnsRenamed(dict(zip(("h_id", "h_crc"), names[:2], strict=True))).withColumn(names[2], F.lit(True))
    joined = rows.join(marked, rows[doc_id].eqNullSafe(marked[names[0]]) & (rows[crc] == marked[names[1]]), "left")
    anew = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_slots)).cast("int")
    return joined.withColumn(vslot, F.when(F.col(names[2]), anew).otherwise(F.col(vslot))).drop(*names)


def _place(slots: Column, loads: Column) -> Column:
    """Greedy placement by one fold over slots in falling weight: array of (vslot, bytes, n_rows, shard).

    ``slots`` is bounded by the number of virtual slots, ``loads`` by the number of shards.
    """
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shard"))

    def step(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i + 1 == at, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["shard"], F.array(at - 1)).alias("shard"),
        )

    return F.aggregate(slots, start, step, lambda acc: acc["shard"])


def build_map(weights: DataFrame, n_shards: int = N_SHARDS, version: int = 1) -> DataFrame:
    """Slot-to-shard map (version, vslot, shard, bytes, n_rows) from the weights of slots."""
    order = F.array_sort(
        F.collect_list(F.struct((-F.col("bytes")).alias("w"), F.col("vslot"), F.col("bytes"), F.col("n_rows")))
    )
    one = weights.agg(order.alias("s")).withColumn(
        "shards", _place(F.col("s"), F.expr(f"transform(sequence(1, {int(n_shards)}), x -> 0L)"))
    )
    return one.select(F.explode(F.arrays_zip("s", "shards")).alias("z")).select(
        F.lit(version).alias("version"), F.col("z.s.vslot").alias("vslot"), F.col("z.shards").alias("shard"),
        F.col("z.s.bytes").alias("bytes"), F.col("z.s.n_rows").alias("n_rows"),
    )


def rebalance(current: DataFrame, n_shards: int, weights: DataFrame | None = None) -> DataFrame:
    """The next version of a map for ``n_shards`` shards, moving few slots.

    Each shard keeps its slots, heaviest first, while their sum stays within
    the mean load; the others, those of shards that no longer exist, and slots
    new in ``weights`` are placed anew on the lightest shards.
    """
    cur = current.select("version", "vslot", "shard", "bytes", "n_rows")
    if weights is not None:
        now = weights.select("vslot", F.col("bytes").alias("b"), F.col("n_rows").alias("n"))
        cur = cur.join(now, "vslot", "full_outer").select(
            F.coalesce("version", F.lit(0)).alias("version"), "vslot", "shard",
            F.coalesce("b", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n_rows"),
        )
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    total, last = cur.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("version"), F.lit(0))).first()
    marked = cur.withColumn("v", F.lit(last)).withColumn(
        "keep", F.coalesce((F.col("shard") < n_shards) & (F.sum("bytes").over(run) <= -(-total // n_shards)), F.lit(False))
    )
    item = F.struct((-F.col("bytes")).alias("w"), F.col("vslot"), F.col("bytes"), F.col("n_rows"))
    loads = F.array(*[F.coalesce(F.sum(F.when(F.col("keep") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("long") for k in range(n_shards)])
    one = marked.agg(
        F.array_sort(F.collect_list(F.when(~F.col("keep"), item))).alias("s"), loads.alias("loads"), F.max("v").alias("v")
    ).withColumn("shards", _place(F.col("s"), F.col("loads")))
    moved = one.select("v", F.explode(F.arrays_zip("s", "shards")).alias("z")).select(
        (F.col("v") + 1).alias("version"), F.col("z.s.vslot").alias("vslot"), F.col("z.shards").alias("shard"),
        F.col("z.s.bytes").alias("bytes"), F.col("z.s.n_rows").alias("n_rows"),
    )
    kept = marked.filter("keep").select((F.col("v") + 1).alias("version"), "vslot", "shard", "bytes", "n_rows")
    return kept.unionByName(moved)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the map table at ``path``; older versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    maps = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == F.lit(version))


def place(slim: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and position of each row of ``slim``: ``slot`` counts 0, 1, ... within the shard.

    Positions are sums in two steps: rows before the slot in its shard, by a
    window over the map, then the row's number within its virtual slot.  No
    task sees more than a virtual slot's slim rows.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        slim.withColumn("rank", F.row_number().over(inner).cast("long"))
        .join(starts, "vslot")
        .select("doc_id", "size", "text_crc32", F.col("shard"), (F.col("start") + F.col("rank") - 1).alias("slot"), "vslot")
    )


def shard_table(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None, copies: int = COPIES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, vslot of every row; the map is stored as version 1 at ``map_path``."""
    spark = docs.sparkSession
    slim = materialize(weigh(docs, n_slots), "shard-slim")
    weights = materialize(slot_bytes(slim), "slot-weights")
    hot = hot_records(slim, weights, n_slots, copies)
    if hot is not None:
        slim = materialize(spread(slim, hot, n_slots), "shard-spread")
        weights = slot_bytes(slim)
    path = map_path or new_path(spark, "slot-map")
    save_map(build_map(weights, n_shards), path)
    return place(slim, load_map(spark, path))


def assign(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None, copies: int = COPIES) -> DataFrame:
    """``docs`` with a ``shard`` column: rows stay in place, only the map (bounded by ``n_slots``) is joined.

    A text counts as in the module's defined cases; an empty table stays empty,
    and a column that is called ``shard`` already makes the new one ``shard_``.
    """
    spark = docs.sparkSession
    path = map_path or new_path(spark, "slot-map")
    slim = weigh(docs, n_slots)
    weights = materialize(slot_bytes(slim), "slot-weights")
    hot = hot_records(slim, weights, n_slots, copies)
    slot, shard, crc = unused(docs, "vslot", "shard", "crc")
    every = F.sequence(F.lit(0), F.lit(n_slots - 1))
    if hot is not None:
        # Rows are drawn to slots anew where they lie, so every slot needs a place in the map.
        weights = slot_bytes(spread(slim, hot, n_slots))
        all_slots = spark.range(1).select(F.explode(every).alias("vslot"))
        weights = all_slots.join(F.broadcast(weights), "vslot", "left").na.fill(0)
    save_map(build_map(weights, n_shards), path)
    full = docs.withColumn(crc, sizes(F.col("text"))[1])
    full = full.withColumn(slot, slot_of(F.col("doc_id"), F.col(crc), n_slots))
    if hot is not None:
        full = spread(full, hot, n_slots, crc=crc, vslot=slot)
    where = load_map(spark, path).select(F.col("vslot").alias(slot), F.col("shard").alias(shard))
    return full.join(F.broadcast(where), slot).select(*[F.col(f"`{c}`") for c in docs.columns], shard)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._common import table

    out = shard_table(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )


def _sql_crc32(octets: str) -> str:
    """CRC-32 of a list of bytes in SQL: the step of a byte is linear, so it is the sum of those of its bits."""
    bits = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        bits.append(f"{c} * ((xor(c, b) >> {k}) & 1)")
    step = "c >> 8"
    for b in bits:
        step = f"xor({step}, {b})"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


SQL = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS octets FROM documents),
d AS (SELECT doc_id, size, {_sql_crc32('octets')} AS text_crc32 FROM t),
s AS (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || CAST(text_crc32 AS VARCHAR))), 1, 8))::BIGINT % {N_SLOTS} AS INTEGER) AS v FROM d),
w AS (SELECT v, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, v) AS k FROM s GROUP BY v),
g AS (
  SELECT 0::BIGINT AS k, list_transform(range({N_SHARDS}), lambda x: 0::BIGINT) AS loads, -1::INTEGER AS shard
  UNION ALL
  SELECT w.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + bytes ELSE x END),
    list_position(loads, list_min(loads)) - 1
  FROM g JOIN w ON w.k = g.k + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY v, doc_id, text_crc32, size) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, v AS virtual_slot
FROM s JOIN w USING (v) JOIN g USING (k)
"""
