"""Byte-level BPE by monoid tree reduction.

A text is halved down to leaves, leaves are encoded, and neighbours are joined by re-encoding a window
around their border. The window grows until what lies outside is proven stable:

* A *settled* place is one where every segmentation by the pattern has a border, whatever stands around it: a
  non-space before white space, or an ASCII letter beside an ASCII digit, or either of them before ASCII
  punctuation. No alternative of the pattern spans such a place, and the pattern never looks back, so the
  pieces left of it do not depend on what follows and those right of it not on what precedes. The window
  reaches from the last settled place of the left half to the first one of the right half.
* Inside a long run of one ASCII class the border falls into a single piece. There the window is a few
  tokens wide and doubles until the tokens at both of its edges are compatible with their outer neighbours:
  a token sequence is the encoding of its bytes exactly if each two neighbours encode to themselves.

Texts above SEGMENT characters are dealt to several tasks; their parts are joined by the same operation.
Null text is empty text, with no ids. Repeated rows give repeated results; a null id is kept. Columns other
than the two named are not read.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 4096
SEGMENT = 65536

# White_Space of Unicode, as the pattern's \s has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PUNCT = r"!-/:-@\[-`{-~"
_SETTLED = re.compile(
    rf"(?<=[^{_WS}])(?=[{_WS}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[{_PUNCT}])"
)
_RUNS = [re.compile(f"[{c}]+") for c in ("A-Za-z", "0-9", _PUNCT)]
#: Characters searched for a settled place before a run of one class is considered.
_NEAR = 256


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _last_settled(text: str, low: int, middle: int, reach: int) -> int | None:
    found = None
    for match in _SETTLED.finditer(text, max(low + 1, middle - reach), middle):
        found = match.start()
    return found


def _first_settled(text: str, middle: int, high: int, reach: int) -> int | None:
    match = _SETTLED.search(text, middle + 1, min(high, middle + reach))
    return match.start() if match and match.start() < high else None


def _join_by_tokens(encoding, text, low, middle, high, left, right):
    """Join inside one long run of a class, or None if no such run covers both sides of the border."""
    core = encoding._core_bpe
    for run in _RUNS:
        ahead = run.match(text, middle, high)
        behind = run.match(text[low:middle][::-1])
        if ahead and behind:
            break
    else:
        return None
    # A contraction may take letters at the very start of a run; keep clear of both ends of the run.
    room_left, room_right = behind.end() - 4, ahead.end() - middle - 4
    whole_left, whole_right = behind.end() == middle - low, ahead.end() == high
    width = 8
    while True:
        if width + 1 > len(left) or width + 1 > len(right):
            return None
        head, tail = core.decode_bytes(left[-width - 1 :]), core.decode_bytes(right[: width + 1])
        if len(head) > room_left or len(tail) > room_right or (whole_left and whole_right and width > 1 << 16):
            return None
        window = core.encode_single_piece(core.decode_bytes(left[-width:]) + core.decode_bytes(right[:width]))
        if _compatible(core, left[-width - 1], window[0]) and _compatible(core, window[-1], right[width]):
            return left[:-width] + window + right[width:]
        width *= 2


def _compatible(core, a: int, b: int) -> bool:
    return core.encode_single_piece(core.decode_bytes([a, b])) == [a, b]


def join(encoding, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
    """The ids of text[low:high] from those of its two parts."""
    if not left or not right:
        return left or right
    start, end = _last_settled(text, low, middle, _NEAR), _first_settled(text, middle, high, _NEAR)
    if start is None or end is None:
        joined = _join_by_tokens(encoding, text, low, middle, high, left, right)
        if joined is not None:
            return joined
    reach = _NEAR
    while start is None and reach < middle - low:
        reach *= 4
        start = _last_settled(text, low, middle, reach)
    reach = _NEAR
    while end is None and reach < high - middle:
        reach *= 4
        end = _first_settled(text, middle, high, reach)
    encode = encoding.encode_ordinary
    start, end = low if start is None else start, high if end is None else end
    kept = len(left) - len(encode(text[start:middle])) if start > low else 0
    dropped = len(encode(text[middle:end])) if end < high else len(right)
    return left[:kept] + encode(text[start:end]) + right[dropped:]


def encode_tree(encoding, text: str, low: int = 0, high: int | None = None, leaf: int = LEAF) -> list[int]:
    """Ids of text[low:high]: encode the halves, then join them."""
    high = len(text) if high is None else high
    if high - low <= leaf:
        return encoding.encode_ordinary(text[low:high])
    middle = (low + high) // 2
    left, right = encode_tree(encoding, text, low, middle, leaf), encode_tree(encoding, text, middle, high, leaf)
    return join(encoding, text, low, middle, high, left, right)


def combine(encoding, parts: list[tuple[str, list[int]]]) -> list[int]:
    """Ids of a text from the ids of its consecutive parts, pair by pair up a tree."""
    text, offsets = "".join(p for p, _ in parts), [0]
    for part, _ in parts:
        offsets.append(offsets[-1] + len(part))
    level = [(offsets[i], offsets[i + 1], ids) for i, (_, ids) in enumerate(parts)]
    while len(level) > 1:
        level = [
            (a[0], b[1], join(encoding, text, a[0], a[1], b[1], a[2], b[2]))
            for a, b in zip(level[::2], level[1::2])
        ] + level[len(level) & ~1 :]
    return level[0][2] if level else []


def decode_tree(encoding, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of a sequence of ids: the bytes of both halves, end to end."""
    if len(ids) <= leaf:
        return encoding._core_bpe.decode_bytes(ids)
    return b"".join(encoding._core_bpe.decode_bytes(ids[i : i + leaf]) for i in range(0, len(ids), leaf))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, path: str, pattern: str, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per input row: the id column, `ids` (little-endian unsigned 32-bit, end to end) and `n_tokens`."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    long = F.length("text") > SEGMENT
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        encoding = encoder(path, pattern)
        for batch in batches:
            ids = [_packed(encode_tree(encoding, text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    def cut(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [text[i : i + SEGMENT] for i in range(0, len(text), SEGMENT)]
                for first in range(0, len(parts), 64):
                    some = parts[first : first + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(some), pa.int64()),
                            pa.array([doc_id] * len(some), batch.column(1).type),
                            pa.array(range(first, first + len(some)), pa.int32()),
                            pa.array(some, pa.string()),
                        ],
                        names=["row", "doc_id", "part", "text"],
                    )

    def segments(batches):
        encoding = encoder(path, pattern)
        for batch in batches:
            ids = [_packed(encode_tree(encoding, text)) for text in batch.column(3).to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.binary()))

    def whole_text(group: pa.Table) -> pa.Table:
        encoding = encoder(path, pattern)
        group = group.sort_by("part")
        parts = [
            (text, np.frombuffer(ids, "<u4").tolist())
            for text, ids in zip(group.column("text").to_pylist(), group.column("ids").to_pylist())
        ]
        ids = _packed(combine(encoding, parts))
        return pa.table({"doc_id": group.column("doc_id")[:1], "ids": pa.array([ids], pa.binary())})

    done = rows.where(~long).mapInArrow(whole, f"doc_id {kind}, ids binary")
    # A row number keeps repeated rows apart; the scan below it is the same on every attempt.
    split = (
        rows.where(long)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(cut, f"row long, doc_id {kind}, part int, text string")
        .repartition("row", "part")
        .mapInArrow(segments, f"row long, doc_id {kind}, part int, text string, ids binary")
    )
    joined = split.groupBy("row").applyInArrow(whole_text, f"doc_id {kind}, ids binary")
    return done.union(joined).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decode(tokens: DataFrame, path: str, pattern: str, ids_column="ids") -> DataFrame:
    """The input with `bytes`: what the ids stand for. Null ids give null."""

    @F.pandas_udf("binary")
    def to_bytes(column):
        encoding = encoder(path, pattern)
        return column.map(lambda ids: None if ids is None else decode_tree(encoding, np.frombuffer(ids, "<u4").tolist()))

    return tokens.withColumn("bytes", to_bytes(F.col(ids_column)))
