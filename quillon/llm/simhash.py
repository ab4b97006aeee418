"""SimHash near-dedup with a pigeonring filter.

Fingerprints: 64 counters over the XXH64 hashes of a text's word shingles.
Two fingerprints link if they differ in at most ``TAU`` bits.

Candidates come from the pigeonring principle.  Cut the 64 bits into
m = TAU + 1 segments on a ring.  If two fingerprints differ in at most TAU
bits, some segment starts a chain in which, for every length l, the first l
segments together differ in at most floor(l * TAU / m) bits.  The first
segment of such a chain is equal, and the second differs in at most one bit,
so one of its halves is equal too.  An equi-join key is therefore a mask of
fixed bits (a whole segment and a half of the next) with the bits under it:
2 m keys of 24 bits for each fingerprint, and no pair is missed.  Within a
bucket the longer prefixes of the chain prune before the full Hamming check.

A bucket with more than ``BUCKET`` different fingerprints is split: its free
bits are cut into TAU + 1 parts, one of which must be equal, which gives keys
with more fixed bits.  With 9 free bits a bucket has at most 512 members, so
splitting ends, every bucket is bounded, and nothing is dropped.  From a
bucket only a spanning forest of its links leaves.

Equal fingerprints are collapsed before the search, so copies cost nothing.

Defined cases: a null or empty text, or one without words, has fingerprint 0
and links like any other.  Fewer words than a shingle make one shingle.
Repeated rows get the same component.  A null ``doc_id`` is kept, and is never
the least id unless a group has no other.  An empty table gives an empty
result.  Extra columns are ignored by :func:`groups` and kept by :func:`dedup`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _graph
from ._common import materialize, own_numbers, small, table, unused

TAU = 3
SHINGLE = 3
SEED = 42
#: Most different fingerprints of a bucket that is searched as a whole; at least 2**9.
BUCKET = 512

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Bytes of a text that are split into words at a time.
_PIECE = 1 << 20


# --- fingerprints -----------------------------------------------------------------------------


def _digests(text: bytes, shingle: int, seed: int, one: Callable[[bytes, int], bytes] = xxhash.xxh64_digest) -> Iterator[bytes]:
    """Concatenated big-endian hashes of the shingles of ``text``, a bounded piece of it at a time."""
    text, at, words, any_yet = text.translate(_LOWER), 0, [], False
    while at < len(text):
        cut = len(text)
        if at + _PIECE < cut and (m := _SPACE.search(text, at + _PIECE)):
            cut = m.start()
        words += text[at:cut].split()
        at = cut
        if len(words) >= shingle:
            buf = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            start = (end - size)[: len(words) - shingle + 1].tolist()
            yield b"".join([one(buf[a:b], seed) for a, b in zip(start, end[shingle - 1 :].tolist(), strict=True)])
            words, any_yet = words[len(words) - shingle + 1 :], True
    if words and not any_yet:
        yield one(b" ".join(words), seed)


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts."""
    counts, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        rows = np.array([r for r, _ in held])
        sizes = np.array([len(d) // 8 for _, d in held])
        data = np.frombuffer(b"".join(d for _, d in held), np.uint8).reshape(-1, 8)
        base = np.repeat(np.arange(len(held)) * 256, sizes)
        part = [np.bincount(base + data[:, k], minlength=len(held) * 256).reshape(-1, 256) @ _BITS for k in range(8)]
        np.add.at(counts, rows, np.concatenate(part, axis=1))
        np.add.at(n, rows, sizes)
        held.clear()

    waiting = 0
    for row, text in enumerate(texts):
        for digests in _digests(text or b"", shingle, seed):
            held.append((row, digests))
            waiting += len(digests)
            if waiting > 1 << 20 or len(held) >= 256:
                flush()
                waiting = 0
    if held:
        flush()
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long."""

    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                fp = fingerprints(_binary(part.column(part.num_columns - 1)), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], names=[*part.schema.names[:-1], name])

    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(text))
    return slim.mapInArrow(run, slim.drop(text).withColumn(name, F.lit(0).cast("long")).schema)


# --- candidates -------------------------------------------------------------------------------


def _parts(positions: list[int], n: int) -> list[list[int]]:
    cuts = [round(k * len(positions) / n) for k in range(n + 1)]
    return [positions[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _mask(positions: list[int]) -> int:
    return sum(1 << p for p in positions)


def chain_masks(tau: int = TAU, chain: int = 2) -> list[tuple[int, int]]:
    """(rotation, mask) of all first-level keys: the first ``chain`` segments, each with a part that must be equal."""
    rings = _parts(list(range(64)), tau + 1)
    m, out = len(rings), []
    for r in range(m):
        masks = [0]
        for length in range(1, chain + 1):
            budget = length * tau // m
            masks = [old | _mask(p) for old in masks for p in _parts(rings[(r + length - 1) % m], budget + 1)]
        out += [(r, mask) for mask in masks]
    return out


def child_masks(mask: int, tau: int = TAU) -> list[int]:
    """Masks that fix one of tau + 1 parts of the free bits as well."""
    free = [p for p in range(64) if not mask >> p & 1]
    return [mask | _mask(p) for p in _parts(free, tau + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(one: np.uint64, others: np.ndarray, chain: list[np.uint64], budgets: list[int], tau: int) -> np.ndarray:
    """Which of ``others`` are within tau bits of ``one``: prefixes of the chain first, then all bits."""
    diff = others ^ one
    at = np.arange(len(diff))
    for mask, budget in zip(chain, budgets, strict=True):
        at = at[np.bitwise_count(diff[at] & mask) <= budget]
        if not len(at):
            break
    out = np.zeros(len(diff), bool)
    out[at[np.bitwise_count(diff[at]) <= tau]] = True
    return out


def _forest(fps: np.ndarray, chain: list[np.uint64], budgets: list[int], tau: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among different fingerprints."""
    out, left = [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = _near(one, left, chain, budgets, tau)
            if near.any():
                found = left[near]
                out += [(one, x) for x in found]
                todo += list(found)
                left = left[~near]
    return out


def _link(keys: DataFrame, rotations: dict[int, int], tau: int) -> DataFrame:
    """Forest edges (a, b) of all buckets (mid, val); a bucket's rows come sorted, one bucket in memory at a time."""
    rings = [_mask(p) for p in _parts(list(range(64)), tau + 1)]
    m = len(rings)
    prefixes = [[np.uint64(sum(rings[(r + i) % m] for i in range(n))) for n in range(2, m)] for r in range(m)]
    budgets = [n * tau // m for n in range(2, m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(mid: np.ndarray, val: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            new = np.flatnonzero(np.r_[True, (mid[1:] != mid[:-1]) | (val[1:] != val[:-1])])
            size = np.diff(np.r_[new, len(mid)])
            edges: list[tuple[int, int]] = []
            for at, n in zip(new[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                r = rotations[int(mid[at])]
                edges += _forest(fp[at : at + n], prefixes[r], budgets, tau)
            if not edges:
                return None
            a, b = np.array(edges, np.uint64).T.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], names=["a", "b"])

        rest = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            cols = [batch.column(0).to_numpy(False), batch.column(1).to_numpy(False), batch.column(2).to_numpy(False).view(np.uint64)]
            mid, val, fp = (np.concatenate(x) for x in zip(rest, cols, strict=True))
            same = (mid == mid[-1]) & (val == val[-1])
            cut = int(np.argmax(same))
            if cut and (out := found(mid[:cut], val[:cut], fp[:cut])):
                yield out
            rest = [mid[cut:].copy(), val[cut:].copy(), fp[cut:].copy()]
        if len(rest[0]) and (out := found(*rest)):
            yield out

    dealt = keys.repartition("mid", "val").sortWithinPartitions("mid", "val")
    return dealt.select("mid", "val", "fp").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, tau: int = TAU, chain: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all of ``fps`` (different longs ``fp``) within ``tau`` bits of each other.

    ``fps`` should be materialised: it is read twice a level.
    """
    spark = fps.sparkSession
    level = chain_masks(tau, chain)
    key = lambda mid, mask: F.struct(F.lit(mid).alias("mid"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("val"))
    keys = fps.select("fp", F.explode(F.array(*[key(i, mask) for i, (_, mask) in enumerate(level)])).alias("k")).select("fp", "k.mid", "k.val")
    out = None
    while True:
        rotations = {i: r for i, (r, _) in enumerate(level)}
        hot = materialize(keys.groupBy("mid", "val").count().filter(F.col("count") > bucket).select("mid", "val"), "hot-buckets")
        some = bool(hot.take(1))
        cold = keys.join(hot, ["mid", "val"], "left_anti") if some else keys
        edges = _link(cold, rotations, tau)
        out = edges if out is None else out.unionByName(edges)
        if not some:
            return out
        deeper = [(r, child, i) for i, (r, mask) in enumerate(level) for child in child_masks(mask, tau)]
        small = spark.createDataFrame([(i, j, _signed(c)) for j, (_, c, i) in enumerate(deeper)], "mid int, child int, mask long")
        parts = small.groupBy("mid").agg(F.collect_list(F.struct("child", "mask")).alias("kids"))  # tau + 1 a row
        again = keys.join(hot, ["mid", "val"], "left_semi").join(F.broadcast(parts), "mid")
        kids = again.select("fp", F.explode("kids").alias("k"))
        keys = materialize(kids.select("fp", F.col("k.child").alias("mid"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("val")), "split-buckets")
        level = [(r, child) for r, child, _ in deeper]


# --- groups -----------------------------------------------------------------------------------


def group_of(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, component_id, root) from materialised (doc_id, fp): the least doc_id reachable over links, and the group itself.

    Where an id is that of several texts, groups may share their least id; ``root`` tells them apart.
    """
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fp-least")
    roots = materialize(_graph.components(links(least.select("fp"), tau)), "fp-roots").withColumnRenamed("node", "fp")
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written first, so that the join reads both sides as dealt and AQE can split the root of a large group.
    named = materialize(named, "fp-named")
    lows = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "fp-lows")
    return materialize(named.join(lows, "root").select("fp", "component_id", "root"), "fp-groups")


def groups(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """doc_id, fp (signed long), component_id and root of every row of ``docs`` (doc_id, text)."""
    prints = materialize(with_fingerprint(docs.select("doc_id", "text"), shingle), "fingerprints")
    return prints.join(group_of(prints, tau), "fp").select("doc_id", "fp", "component_id", "root")


def _keep_first(docs: DataFrame, slim: DataFrame, recompute) -> DataFrame:
    """The row with the least (doc_id, fp) of each group; ``slim`` has doc_id, fp, component_id and root of every row.

    Rows whose doc_id is not repeated are dropped by an anti-join with the ids
    of those that go; only rows that share an id, or have none, are told apart
    by ``recompute(rows, text column, name)``, which adds their fp.
    """
    ids = slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("component_id").alias("component_id"))
    once = F.col("doc_id").isNotNull() & (F.col("n") == 1)
    # The texts shuffle only if more rows go than may be broadcast.
    lost = small(materialize(ids.filter(once & (F.col("doc_id") != F.col("component_id"))).select("doc_id"), "lost-ids"))
    again = materialize(ids.filter(~once).select(F.col("doc_id").alias("again")), "repeated-ids")
    if not again.take(1):
        return docs.join(lost, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.join(again, docs["doc_id"].eqNullSafe(again["again"]), "left_semi")
    single = docs.join(again, docs["doc_id"].eqNullSafe(again["again"]), "left_anti").join(lost, "doc_id", "left_anti")
    winners = slim.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("w")).select("w.doc_id", "w.fp")
    name, copy, wid, wfp = unused(docs, "fp", "text_copy", "w_id", "w_fp")
    own = recompute(rows.withColumn(copy, F.col("text")), copy, name)
    w = winners.select(F.col("doc_id").alias(wid), F.col("fp").alias(wfp))
    kept = own.join(w, own["doc_id"].eqNullSafe(w[wid]) & (own[name] == w[wfp]), "left_semi").dropDuplicates(["doc_id", name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*columns).unionByName(kept.select(*columns))


def dedup(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """The rows of ``docs`` but one of each group of :func:`groups`."""
    slim = materialize(groups(docs, shingle, tau), "groups")
    return _keep_first(docs, slim, lambda rows, text, name: with_fingerprint(rows, shingle, text=text, name=name))


# --- five-word shingles at a similarity of 0.8 --------------------------------------------------
#
# At that similarity SimHash distances are about 15 % of the bits, where keys of the pigeonring
# principle no longer select: a key short enough to be equal is shared by most unrelated pairs.
# So pairs meet on one of BANDS keys of BAND_ROWS least hashes each (a pair at 0.8 shares one
# with a probability of 0.995). Pigeonring prunes those: from some of SEGMENTS segments on, the
# differences of every run of segments must stay within their share of REACH, before all 128 bits
# are compared (about 19 +- 4 differ at 0.8, so REACH keeps all but one in a million). What the
# pairs that are left connect is a family. Within a family the exact Jaccard similarity of the
# shingle sets decides.

WIDE_SHINGLE = 5
SIMILAR = (4, 5)
SEGMENTS = 8
#: Most bits in which a pair may differ that is compared exactly.
REACH = 40
BANDS, BAND_ROWS = 10, 4
#: Most rows of a bucket, and most texts of a family, that are compared as a whole.
BLOCK = 4096
SET_BLOCK = 512
#: About as many rows of a larger one are compared with all others first.
PIVOTS = 32

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def _wide_digests(text: bytes) -> Iterator[bytes]:
    return _digests(text, WIDE_SHINGLE, SEED, xxhash.xxh3_128_digest)


def wide_prints(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as [n, 2] uint64, band keys as [n, BANDS] uint64)."""
    counts, n = np.zeros((len(texts), 128), np.int64), np.zeros(len(texts), np.int64)
    least = np.full((len(texts), BANDS * BAND_ROWS), 2**64 - 1, np.uint64)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        rows = np.array([r for r, _ in held])
        sizes = np.array([len(d) // 16 for _, d in held])
        data = np.frombuffer(b"".join(d for _, d in held), np.uint8).reshape(-1, 16)
        base = np.repeat(np.arange(len(held)) * 256, sizes)
        part = [np.bincount(base + data[:, k], minlength=len(held) * 256).reshape(-1, 256) @ _BITS for k in range(16)]
        np.add.at(counts, rows, np.concatenate(part, axis=1))
        np.add.at(n, rows, sizes)
        h, start = np.ascontiguousarray(data[:, :8]).view(np.uint64).reshape(-1), np.cumsum(sizes) - sizes
        for k in range(BANDS * BAND_ROWS):
            np.minimum.at(least[:, k], rows, np.minimum.reduceat(h * _A[k] + _B[k], start))
        held.clear()

    waiting = 0
    for row, text in enumerate(texts):
        for digests in _wide_digests(text or b""):
            held.append((row, digests))
            waiting += len(digests)
            if waiting > 1 << 20 or len(held) >= 256:
                flush()
                waiting = 0
    if held:
        flush()
    prints = np.packbits(2 * counts > n[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1, 2)
    keys = np.empty((len(texts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(texts), band + 1, np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = (key ^ (least[:, k] >> np.uint64(11))) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return prints, keys


def whole_print(text: bytes | None) -> bytes:
    """A hash of all shingles of a text in order; other than the 128 bits, it tells near copies apart."""
    out = xxhash.xxh3_64()
    for digests in _wide_digests(text or b""):
        out.update(digests)
    return out.digest()


def with_wide_print(docs: DataFrame, text: str = "text", name: str = "fp", bands: str | None = None) -> DataFrame:
    """``docs`` without its text, with the 128 bits and the hash of the whole as one binary column and, if asked for, the band keys."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = _binary(part.column(part.num_columns - 1))
                prints, keys = wide_prints(texts)
                own = [pa.array([x.tobytes() + whole_print(t) for x, t in zip(prints, texts, strict=True)], pa.binary())]
                own += [pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))] if bands else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], names=[*part.schema.names[:-1], name, *([bands] if bands else [])])

    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(text))
    shape = slim.drop(text).withColumn(name, F.lit(b""))
    return slim.mapInArrow(run, (shape.withColumn(bands, F.array(F.lit(0).cast("long"))) if bands else shape).schema)


def within_ring(diff: np.ndarray, radius: int) -> np.ndarray:
    """Rows of ``diff`` ([n, 2] words of differing bits) with at most ``radius`` bits, most others pruned by chains of segments."""
    bits = np.bitwise_count(np.ascontiguousarray(diff).view(np.uint16))
    at = np.arange(len(bits))
    sums = np.zeros((len(bits), SEGMENTS), np.int64)
    alive = np.ones((len(bits), SEGMENTS), bool)
    for length in range(1, SEGMENTS):
        # Column r holds the differences of the chain that starts at segment r.
        sums += np.roll(bits, 1 - length, axis=1)
        alive &= sums <= length * radius // SEGMENTS
        some = alive.any(axis=1)
        if not some.all():
            at, bits, sums, alive = at[some], bits[some], sums[some], alive[some]
        if not len(at):
            break
    out = np.zeros(len(diff), bool)
    out[at[bits.sum(axis=1) <= radius]] = True
    return out


def _wide_forest(nodes: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links."""
    edges = []
    left = np.arange(len(nodes))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = within_ring(prints[left] ^ prints[one], radius)
            if near.any():
                found = left[near]
                edges += [(nodes[one], x) for x in nodes[found]]
                todo += found.tolist()
                left = left[~near]
    return edges


def _wide_link(rows: DataFrame, radius: int) -> DataFrame:
    """Forest edges (a, b) of each bucket (k1, k2), from (k1, k2, node, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k1: np.ndarray, k2: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            new = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            size = np.diff(np.r_[new, len(k1)])
            out: list[tuple[int, int]] = []
            for at, n in zip(new[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                out += _wide_forest(node[at : at + n], fp[at : at + n], radius)
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*out, strict=True)], names=["a", "b"])

        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.uint64)]
        for batch in batches:
            raw = np.frombuffer(b"".join(x[:16] for x in batch.column(3).to_pylist()), np.uint64).reshape(-1, 2)
            cols = [*[batch.column(i).to_numpy(False) for i in range(3)], raw]
            now = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            cut = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))
            if cut and (out := found(*(x[:cut] for x in now))):
                yield out
            rest = [x[cut:].copy() for x in now]
        if len(rest[0]) and (out := found(*rest)):
            yield out

    dealt = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.select("k1", "k2", "node", "fp").mapInArrow(run, "a long, b long")


def similar_links(nodes: DataFrame, radius: int = REACH, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what is within ``radius`` bits in a band's bucket, from ``nodes`` (node, fp, bands), which should be materialised."""
    keys = materialize(nodes.select("node", "fp", F.explode("bands").alias("k1")), "wide-keys")
    return _connected(keys, lambda rows: _wide_link(rows, radius), block)


def _connected(keys: DataFrame, link: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """Edges that connect the links in each bucket k1 of ``keys`` (k1, node, ...), which should be materialised.

    ``link`` compares all rows of a bucket (k1, k2).  A bucket of more than
    ``block`` rows is dealt into blocks, each with the same few pivots, which
    joins what is near a pivot over all blocks.  Near is not transitive, so
    every row that is not in the bucket's largest component is then compared
    with all rows of the bucket: no link is lost, and a group of copies, however
    large, costs its size.  Only what is far from most others costs a pass each
    ``block`` rows.
    """
    zero = F.lit(0).cast("long")
    sizes = keys.groupBy("k1").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block)
    hot = materialize(sizes.select("k1", F.ceil(F.col("rows") / block).cast("long").alias("blocks"), F.ceil(F.col("rows") / PIVOTS).cast("long").alias("apart")), "hot-buckets")
    if not hot.take(1):
        return link(keys.withColumn("k2", zero))
    payload = [c for c in keys.columns if c not in ("k1", "node")]
    shape = ["k1", "k2", "node", *payload]
    cold = keys.join(small(hot.select("k1")), "k1", "left_anti").withColumn("k2", zero)
    warm = keys.join(small(hot), "k1").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.sequence(zero, F.col("blocks") - 1)
    pivots = warm.filter(F.pmod(F.xxhash64(F.lit(7), "node"), F.col("apart")) == 0).withColumn("k2", F.explode(every)).filter("k2 <> own")
    first = cold.select(*shape).unionByName(warm.withColumn("k2", F.col("own")).select(*shape)).unionByName(pivots.select(*shape))
    edges = materialize(link(first), "near-pairs")
    roots = materialize(_graph.components(edges), "near-roots")
    # By component; a node without any link is one of its own.
    placed = warm.select("k1", "node").join(roots, "node", "left").select("k1", "node", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed, "near-placed")
    largest = placed.groupBy("k1", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("k1").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = materialize(placed.join(small(materialize(largest, "near-largest")), "k1").filter("root <> main").select("k1", "node"), "near-rest")
    if not rest.take(1):
        return edges
    half = max(1, block // 2)
    counts = materialize(rest.groupBy("k1").agg(F.ceil(F.count(F.lit(1)) / half).cast("long").alias("parts")), "near-counts")
    again = warm.join(small(counts), "k1")
    aside = again.join(small(rest), ["k1", "node"], "left_semi").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")))
    aside = aside.withColumn("c", F.explode(every)).withColumn("k2", F.col("part") * F.col("blocks") + F.col("c"))
    whole = again.withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).withColumn("k2", F.col("part") * F.col("blocks") + F.col("own"))
    return edges.unionByName(link(aside.select(*shape).unionByName(whole.select(*shape))))


def with_sets(docs: DataFrame) -> DataFrame:
    """(fp, shingles) of ``docs`` (doc_id, text): the different hashes of the shingles, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                texts = _binary(b.column(0).slice(lo, 512))
                prints, _ = wide_prints(texts)
                fp = pa.array([x.tobytes() + whole_print(t) for x, t in zip(prints, texts, strict=True)], pa.binary())
                sets = [np.unique(np.frombuffer(b"".join(_wide_digests(t or b"")), np.int64)[::2]) for t in texts]
                yield pa.RecordBatch.from_arrays([fp, pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "fp binary, shingles array<long>")


def _set_forest(nodes: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets at ``SIMILAR`` or more; ``values`` has the sets one after the other."""
    over, under = SIMILAR
    _, values = np.unique(values, return_inverse=True)
    mark = np.zeros(len(values), bool)
    starts = np.cumsum(sizes) - sizes
    edges = []
    left = np.arange(len(nodes))
    flat, size = values, sizes
    while len(left) > 1:
        todo, first = [int(left[0])], True
        while todo and len(left):
            one = todo.pop()
            own = values[starts[one] : starts[one] + sizes[one]]
            mark[own] = True
            both = np.diff(np.r_[0, np.cumsum(mark[flat])][np.r_[0, np.cumsum(size)]])
            mark[own] = False
            near = under * both >= over * (size + sizes[one] - both)
            if first:
                near[0], first = True, False
            if near.any():
                found = left[near]
                edges += [(nodes[one], x) for x in nodes[found] if x != nodes[one]]
                todo += [x for x in found.tolist() if x != one]
                flat, left, size = flat[np.repeat(~near, size)], left[~near], size[~near]
    return edges


def _set_link(rows: DataFrame) -> DataFrame:
    """Forest edges (a, b) of each bucket (k1, k2), from (k1, k2, node, shingles); one bucket in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k1: np.ndarray, k2: np.ndarray, node: np.ndarray, sets: pa.Array) -> pa.RecordBatch | None:
            new = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            size = np.diff(np.r_[new, len(k1)])
            out: list[tuple[int, int]] = []
            for at, n in zip(new[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                own = sets.slice(at, n)
                out += _set_forest(node[at : at + n], own.flatten().to_numpy(False), own.value_lengths().to_numpy(False).astype(np.int64))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*out, strict=True)], names=["a", "b"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch if rest is None else pa.concat_batches([rest, batch])
            k1, k2, node = (now.column(i).to_numpy(False) for i in range(3))
            cut = int(np.argmax((k1 == k1[-1]) & (k2 == k2[-1])))
            if cut and (out := found(k1[:cut], k2[:cut], node[:cut], now.column(3).slice(0, cut))):
                yield out
            rest = now.slice(cut)
        if rest is not None and (out := found(*(rest.column(i).to_numpy(False) for i in range(3)), rest.column(3))):
            yield out

    dealt = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.select("k1", "k2", "node", "shingles").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, fp, component_id and root of every row, for five-word shingles at a similarity of 0.8."""
    prints = materialize(with_wide_print(docs.select("doc_id", "text"), bands="bands"), "wide-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("bands").alias("bands"))
    nodes = own_numbers(materialize(nodes.withColumn("node", F.xxhash64("fp")), "wide-nodes"), "fp", "node")
    families = _graph.components(similar_links(nodes.select("node", "fp", "bands"), reach)).withColumnRenamed("root", "k1")
    members = materialize(nodes.select("node", "fp", "low").join(families, "node"), "wide-families")
    ids = small(materialize(members.select(F.col("low").alias("member")).distinct(), "family-ids"))
    texts = with_sets(docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("member")), "left_semi"))
    sets = texts.join(members.select("fp", "node", "k1"), "fp").groupBy("node").agg(F.first("k1").alias("k1"), F.first("shingles").alias("shingles"))
    sets = materialize(sets, "family-sets")
    roots = materialize(_graph.components(_connected(sets, _set_link, SET_BLOCK)), "wide-roots")
    named = nodes.select("node", "fp", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "wide-named")
    lows = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "wide-lows")
    ids = materialize(named.join(small(lows), "root").select("fp", "component_id", "root"), "wide-components")
    return prints.select("doc_id", "fp").join(ids, "fp").select("doc_id", "fp", "component_id", "root")


def dedup_similar(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows of ``docs`` but one of each group of :func:`similar_groups`: that with the least doc_id.

    Texts that are null, empty or of spaces alone are copies of each other; a
    text of fewer than five words is one shingle.  Repeated ids are told apart
    by their texts, rows equal in both are copies, and null ids come last.  An
    empty table stays empty; all columns are kept, whatever their names.
    """
    slim = materialize(similar_groups(docs, reach), "wide-groups")
    return _keep_first(docs, slim, lambda rows, text, name: with_wide_print(rows, text, name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
