"""Token ids of whole documents by a public byte-level BPE tokenizer.

Documents of up to ``leaf`` characters are encoded as they are. Longer ones are cut into leaves that are encoded in
parallel on the whole cluster. A cut goes where the tokenizer's own pattern always splits (a space after something else, or
the end of a run of letters or digits), so those leaves concatenate exactly. A run with no such place (base64,
scripts without spaces, rules of dashes) is one piece to the tokenizer: it is halved down to leaves, and the halves' ids are
joined as a tree. At each join a window of ids around it is decoded to bytes and encoded again; the window grows
until its outer ids on both sides equal those of the halves. As a sequence of BPE ids is the encoding of its
bytes exactly when every two neighbours are, the result equals that of the whole piece.

Documents are read twice, the short and the long ones each once; the parts of the long ones are shuffled once, by what they hold, so equal parts of
equal rows are counted on the map side and encoded once.

A null or empty text has the empty list. Special tokens are never produced: their strings are ordinary text. Repeated
rows are repeated in the result, also without an id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldays.session import spread

LEAF = 32_768
#: fixed value: the pattern for which the places of safe cuts are proven; another pattern is refused
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH_CHARS = 8_000_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file on this machine; the files are installed with every Python, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def codec(path: str):
    """(encoding with the public pattern, the same merges over unsplit pieces); one pair per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the tokenizer's pattern is not the one that safe cuts are known for")
    # byte-level vocabularies hold all 256 bytes, so every text has an encoding
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError(f"{path} is not a byte-level vocabulary")
    return tuple(tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("text", public_tokenizers.PATTERN), ("piece", r"(?s:.+)")))


@lru_cache(maxsize=1)
def patterns():
    import regex

    safe = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
    return safe, regex.compile(PATTERN)


def leaves_of(text: str, leaf: int) -> Iterator[tuple[int, str]]:
    """(piece, part): piece -1 stands alone, parts of one piece >= 0 are one pre-token of the pattern, cut up."""
    safe, pattern = patterns()
    at, piece = 0, 0
    while at < len(text):
        m = safe.search(text, at + leaf) if at + leaf < len(text) else None
        end = m.start() if m else len(text)
        if end - at <= 2 * leaf:
            yield -1, text[at:end]
        else:
            block, done, tail = text[at:end], 0, []
            for t in pattern.finditer(block):
                if t.end() - t.start() <= leaf:
                    tail = [*tail, t] if t.group().isspace() else []
                    continue
                rest = tail[0].start() if tail else t.start()
                if rest > done:
                    yield -1, block[done:rest]
                for space in tail:  # what the pattern does with spaces depends on what follows, so they are pieces of their own
                    yield piece, space.group()
                    piece += 1
                word = t.group()
                halves = 1 << (-(-len(word) // leaf) - 1).bit_length()
                edges = [len(word) * i // halves for i in range(halves + 1)]
                for x, y in zip(edges, edges[1:], strict=False):
                    yield piece, word[x:y]
                piece += 1
                done, tail = t.end(), []
            if done < len(block):
                yield -1, block[done:]
        at = end


def join_ids(left: list[int], right: list[int], piece, agree: int = 2) -> list[int]:
    """Ids of two neighbouring parts of one piece, joined exactly."""
    if not left or not right:
        return left + right
    w = 2 * agree
    while True:
        a, b = min(w, len(left)), min(w, len(right))
        mid = piece._encode_single_piece(piece.decode_bytes(left[-a:] + right[:b]))  # bytes, as a window may begin inside a character
        ok_left = a == len(left) or mid[:agree] == left[-a : len(left) - a + agree]
        ok_right = b == len(right) or mid[-agree:] == right[b - agree : b]
        if ok_left and ok_right:
            return left[: len(left) - a] + mid + right[b:]
        w *= 2


def join_tree(parts: list[list[int]], piece) -> list[int]:
    while len(parts) > 1:
        parts = [join_ids(parts[i], parts[i + 1], piece) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def lists(ids: list) -> pa.Array:
    """An Arrow list column of many id arrays without a Python object per id."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def chunks(batch: pa.RecordBatch, text: int, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text size, so that the ids of a batch never exceed a worker's memory."""
    n = pa.compute.coalesce(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, x in enumerate(n):
        if held and held + x > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(x)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _short(path: str, count: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = codec(path)[0]
        for whole in batches:
            for b in chunks(whole, 1):
                ids = [enc.encode_to_numpy(t, disallowed_special=()) if t else () for t in b.column(1).to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int64()) if count else lists(ids)
                yield pa.RecordBatch.from_arrays([b.column(0), out], ["id", "out"])

    return run


def _cut(leaf: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for i, text in enumerate(whole.column(2)):
                got = list(leaves_of(text.as_py(), leaf))
                at = pa.array([i] * len(got), pa.int64())
                yield pa.RecordBatch.from_arrays([whole.column(0).take(at), whole.column(1).take(at), pa.array(range(len(got)), pa.int32()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())], ["id", "hash", "leaf", "piece", "part"])

    return run


def _parts(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, piece = codec(path)
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for b in chunks(whole, 4):
                ids = [(text if p < 0 else piece).encode_to_numpy(t, disallowed_special=()) for p, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], lists(ids), b.column(5)], ["id", "hash", "leaf", "piece", "ids", "copies"])

    return run


def _join(path: str, count: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = codec(path)[1]
        for b in batches:
            for i in range(b.num_rows):
                out, held, now = [], [], -1
                for x in [*b.column(2)[i].as_py(), {"piece": -2, "ids": []}]:
                    if held and x["piece"] != now:
                        out += join_tree(held, piece)
                        held = []
                    now = x["piece"]
                    if now >= 0:
                        held.append(x["ids"])
                    else:
                        out += x["ids"]
                made = pa.array([len(out)], pa.int64()) if count else lists([out])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), made, b.column(1).slice(i, 1)], ["id", "out", "copies"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF, count: bool = False) -> DataFrame:
    """(id_col, ids) of every row, or with count (id_col, n_tokens)."""
    path, name, kind = path or tokenizer_path(), "n_tokens" if count else "ids", "bigint" if count else "array<int>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    size = F.coalesce(F.length("text"), F.lit(0))
    short = spread(rows).where(size <= leaf).mapInArrow(_short(path, count), f"id {id_type}, out {kind}")
    # long documents only: a row is known by its id and the hash of its text, and equal rows are one with a number of copies
    long = rows.where(size > leaf).select("id", F.sha2("text", 256).alias("hash"), "text")
    cut_up = long.mapInArrow(_cut(leaf), f"id {id_type}, hash string, leaf int, piece int, part string")
    parts = cut_up.groupBy("id", "hash", "leaf", "piece", "part").agg(F.count(F.lit(1)).alias("copies"))
    coded = parts.mapInArrow(_parts(path), f"id {id_type}, hash string, leaf int, piece int, ids array<int>, copies bigint")
    whole = coded.groupBy("id", "hash").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("leaf", "piece", "ids"))).alias("leaves"))
    joined = whole.select("id", "copies", "leaves").mapInArrow(_join(path, count), f"id {id_type}, out {kind}, copies bigint")
    again = joined.select("id", "out", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return short.unionByName(again.select("id", "out")).select(F.col("id").alias(id_col), F.col("out").alias(name))
