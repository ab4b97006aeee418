"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``; a conversation is
its turns in order, one after the other.  The loss covers the contents of
assistant turns.

A batch of turns is formatted at once: segment lengths, cumulative offsets
and scatter indices are numpy arrays, and headers, contents and footers are
copied into one preallocated buffer that becomes the Arrow column.

Escapes: in contents and roles, a mark (U+E000) goes in after the first
character of every control string, and U+E001 after every U+E000 that the
text itself holds; a newline in a role becomes the mark and ``n``.  No control
string starts inside another, so none survives, and :func:`unescape` undoes
all of it.

Defined cases: a null text or role is empty.  Turns sort by turn (null
first), then role, then text, so ties and repeated rows have one order.  Rows
with a null conv_id are one conversation.  Empty tables give empty results;
extra columns are ignored.  A conversation of any length is read as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
MARK, TWICE = "\ue000".encode(), "\ue001".encode()
_SPECIAL = re.compile(b"|".join([re.escape(c.encode()) for c in CONTROLS] + [MARK]))
_BACK = re.compile(MARK + b"(" + TWICE + b"|n)?")
#: Bytes of contents that are assembled at a time.
_PIECE = 1 << 22


def escape(text: bytes) -> bytes:
    return _SPECIAL.sub(lambda m: MARK + TWICE if m[0] == MARK else m[0][:1] + MARK + m[0][1:], text)


def escape_role(role: bytes) -> bytes:
    return escape(role).replace(b"\n", MARK + b"n")


def unescape(text: bytes) -> bytes:
    return _BACK.sub(lambda m: b"" if m[1] is None else MARK if m[1] == TWICE else b"\n", text)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column, null as empty."""
    column = column.fill_null("") if column.null_count else column
    size = 8 if pa.types.is_large_string(column.type) else 4
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if size == 8 else np.int32, len(column) + 1, column.offset * size).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return o - o[0], raw


def _inserts(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where escapes go in (before which byte), and which they are (0: the mark, 1: U+E001)."""
    at, kind = [], []
    for m in _SPECIAL.finditer(raw.tobytes()):
        own = m[0] == MARK
        if not own:  # not across two texts
            row = int(np.searchsorted(offsets, m.start(), "right"))
            if offsets[row] < m.end():
                continue
        at.append(m.end() if own else m.start() + 1)
        kind.append(int(own))
    return np.array(at, np.int64), np.array(kind, np.int64)


def _scatter(out: np.ndarray, where: np.ndarray, size: np.ndarray, start: np.ndarray, source: np.ndarray) -> None:
    """out[where[i] : where[i] + size[i]] = source[start[i] : start[i] + size[i]], for all i."""
    shift = np.repeat(where - start, size)
    pick = np.arange(len(shift)) + np.repeat(start - (np.cumsum(size) - size), size)
    out[pick + shift] = source[pick]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and the byte span (start, length) of each turn's content in its own turn."""
    n = len(texts)
    offsets, raw = _flat(texts)
    at, kind = _inserts(offsets, raw)
    # Ends of texts count inserts at their own end (U+E001 after a last U+E000), not those of the next text.
    ends_at = np.searchsorted(at, offsets, "left")
    if len(at):
        last = kind == 1
        tail = np.searchsorted(at[last], offsets, "right") - np.searchsorted(at[last], offsets, "left")
        ends_at = ends_at + tail
    extra = 3 * np.diff(ends_at)
    content = np.diff(offsets) + extra
    names: dict[str, int] = {}
    which = np.array([names.setdefault(r or "", len(names)) for r in roles.to_pylist()], np.int64)
    heads = [OPEN + escape_role(r.encode()) + b"\n" for r in names]
    head_all = np.frombuffer(b"".join(heads), np.uint8)
    head_size = np.array([len(h) for h in heads], np.int64)
    head_start = np.cumsum(head_size) - head_size
    close = np.frombuffer(CLOSE, np.uint8)
    hs = head_size[which] if n else np.empty(0, np.int64)
    total = hs + content + len(CLOSE)
    ends = np.cumsum(total)
    begin = ends - total
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    if n:
        _scatter(out, begin, hs, head_start[which], head_all)
        _scatter(out, ends - len(CLOSE), np.full(n, len(CLOSE)), np.zeros(n, np.int64), close)
        # A byte of a text moves by its turn's start and by three for each insert before it.
        base = np.repeat(begin + hs - offsets[:-1] - 3 * ends_at[:-1], np.diff(offsets))
        pos = np.arange(len(raw)) + base
        if len(at):
            pos += 3 * np.searchsorted(at, np.arange(len(raw)), "right")
        out[pos] = raw
        for i, (p, k) in enumerate(zip(at.tolist(), kind.tolist(), strict=True)):
            row = int(np.searchsorted(offsets, p, "left" if k else "right")) - 1
            put = int(begin[row] + hs[row] + p - offsets[row] + 3 * (i - ends_at[row]))
            out[put : put + 3] = np.frombuffer(TWICE if k else MARK, np.uint8)
    bounds = np.r_[0, ends].astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(out))
    return formatted, hs, content


def _ordered(turns: DataFrame) -> DataFrame:
    slim = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_bytes: turns of a conversation lie in order in one partition.

    A conversation's text is its ``formatted`` parts, joined.  The loss span is
    in bytes of the part; ``loss_bytes`` is null for roles without loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(np.diff(_flat(b.column(3))[0])) if b.num_rows else np.empty(0, np.int64)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _PIECE, "right")))
                part = b.slice(lo, hi - lo)
                formatted, start, length = assemble(part.column(2), part.column(3))
                loss = pa.array([r == LOSS_ROLE for r in part.column(2).to_pylist()])
                spans = pa.array(length, mask=~loss.to_numpy(False))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), formatted.cast(pa.string()), pa.array(start), spans], names=["conv_id", "turn", "formatted", "loss_start", "loss_bytes"])
                lo = hi

    schema = turns.select("conv_id", "turn").schema.add("formatted", "string").add("loss_start", "long").add("loss_bytes", "long")
    return _ordered(turns).mapInArrow(run, schema)


def read_turn(part: bytes) -> tuple[bytes, bytes]:
    """(role, text) of a formatted turn."""
    if not (part.startswith(OPEN) and part.endswith(CLOSE)):
        raise ValueError("not a formatted turn")
    role, content = part[len(OPEN) : -len(CLOSE)].split(b"\n", 1)
    return unescape(role), unescape(content)


def _chars(text: bytes) -> int:
    return len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)) if text else 0


def digests(formatted: DataFrame) -> DataFrame:
    """A row a conversation, read back from :func:`format_turns` (whose partitions and order it needs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, rows = None, False, []
        n = chars = loss = 0
        turns = lost = None

        def row() -> tuple:
            return now, n, turns.hexdigest(), loss, lost.hexdigest(), chars

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            parts = b.column(2).cast(pa.binary())
            for i, (conv, start, span) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if not open_ or conv != now:
                    if open_:
                        rows.append(row())
                    now, open_, n, chars, loss, turns, lost = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                part = parts[i].as_py()
                role, text = read_turn(part)
                turns.update(role + b"\n" + text + b"\n")
                n, chars = n + 1, chars + _chars(part)
                if span is not None:
                    own = unescape(part[start : start + span])
                    lost.update(own)
                    loss += _chars(own)
            if len(rows) > 1000:
                yield batch()
                rows = []
        if open_:
            rows.append(row())
        if rows:
            yield batch()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(format_turns(turns.unionByName(own)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + 24
        + length(regexp_replace(role, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|' || chr(57344) || '|\n', '\0.', 'g')) - length(role)
        + length(regexp_replace(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|' || chr(57344), '\0.', 'g')) - length(text) AS n FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
