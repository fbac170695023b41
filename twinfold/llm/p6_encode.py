"""Problem 6: encoding of the whole corpus with a public tokenizer.

Texts up to LONG characters are encoded in one go, Arrow batch by Arrow batch.
A longer text is cut into pieces that are encoded in parallel by other tasks and
put together again, which needs a rule for where a cut is harmless:

* A byte-level BPE with a splitting pattern encodes each word of the pattern by
  itself. A word never goes on from a letter to a non-letter, from a digit to a
  non-digit or from a non-space to a space, so a cut at such a place changes
  nothing and the ids of both sides are simply joined.
* Text without such a place (letters, digits or signs on end) is one word of any
  length. Method: tree concatenation. Its halves are encoded apart, then a window
  of ids around each join is decoded and encoded again, and it grows until its
  first and last id are those of the two sides. Every neighbouring pair of ids is
  then one that the encoder itself produced side by side, and a sequence whose
  pairs all hold is the encoding of its text, so the result is exact.

Scale: one pass over the documents with no shuffle; only documents above LONG
characters are spread by (document, piece) and gathered by document, whose ids
have to end in one row anyway. The vocabulary (under 1 MB, a constant) is read by
the driver and broadcast; executors need no copy of the file.

Defined results: null gives null, the empty text an empty list; strings that look
like special tokens are ordinary text; repeated documents are encoded alike.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts above this many characters are encoded in pieces of at most as many.
LONG = 1 << 16
#: Ids on each side of a join that are encoded again at first.
WINDOW = 16

_SAFE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=[ \n])")
_ENCODERS: dict = {}


def load(path: str) -> tuple[bytes, str]:
    """A vocabulary file in rank form (base64 token, rank) and its splitting pattern."""
    import public_tokenizers

    with open(path, "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoder(vocabulary: tuple[bytes, str], whole: bool = False):
    """The encoder of a vocabulary; with `whole`, of texts that are one word."""
    key = (*vocabulary, whole)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary[0].splitlines() if line.strip())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str="(?s:.+)" if whole else vocabulary[1], mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def cut_text(text: str, most: int, pattern: str) -> list[tuple[str, bool]]:
    """`text` in pieces of about `most` characters or less: (piece, whether it
    starts at a harmless cut). A word without one is cut into halves."""
    pieces, start = [], 0
    while len(text) - start > most:
        at = None
        for m in _SAFE.finditer(text, start + 1, start + most + 1):
            if start < m.start() <= start + most - 1:  # the last place would not see the character behind it
                at = m.start()
        if at is None:  # no harmless cut within reach: take the whole stretch and halve it
            m = next((m for m in _SAFE.finditer(text, start + most) if m.start() > start), None)
            end = m.start() if m else len(text)
            pieces += _by_word(text[start:end], most, pattern)
            start = end
        else:
            pieces.append((text[start:at], True))
            start = at
    if start < len(text) or not pieces:
        pieces.append((text[start:], True))
    return pieces


def _by_word(stretch: str, most: int, pattern: str) -> list[tuple[str, bool]]:
    """A stretch between harmless cuts, split into the pattern's words; short
    words stay together and a word of more than `most` characters is halved."""
    out, short = [], ""
    for m in regex.finditer(pattern, stretch):
        word = m.group()
        if short and len(short) + len(word) > most:
            out.append((short, True))
            short = ""
        if len(word) > most:
            out += [(h, k == 0) for k, h in enumerate(halves(word, most))]
        else:
            short += word
    return [*out, (short, True)] if short else out


def halves(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], most) + halves(text[mid:], most)


def _text(enc, ids: list[int]) -> str | None:
    """The text of `ids`, None if it starts or ends inside a character."""
    try:
        return enc.decode_bytes(ids).decode("utf-8")
    except UnicodeDecodeError:
        return None


def join_ids(enc, a: list[int], b: list[int], window: int = WINDOW) -> list[int]:
    """The ids of the joined texts of `a` and `b`, which are one word; `enc` encodes
    words. A window starts and ends between characters."""
    x, y = min(window, len(a)), min(window, len(b))
    while a and b:
        while (left := _text(enc, a[len(a) - x :])) is None:
            x += 1
        while (right := _text(enc, b[:y])) is None:
            y += 1
        mid = enc.encode_ordinary(left + right)
        ok_left = x == len(a) or mid[0] == a[len(a) - x]
        ok_right = y == len(b) or mid[-1] == b[y - 1]
        if ok_left and ok_right:
            return a[: len(a) - x] + mid + b[y:]
        x, y = min(2 * x, len(a)), min(2 * y, len(b))
    return a + b


def tree_join(enc, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [join_ids(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def put_together(enc, pieces: list[tuple[list[int], bool]]) -> list[int]:
    """Pieces in order, (ids, starts at a harmless cut) -> the ids of the text;
    `enc` encodes words."""
    out: list[int] = []
    run: list[list[int]] = []
    for ids, safe in [*pieces, ([], True)]:
        if safe and run:
            out += tree_join(enc, run)
            run = []
        run.append(ids)
    return out


def _ids_array(lists: list[np.ndarray | None]) -> pa.ListArray:
    sizes = np.fromiter((0 if x is None else len(x) for x in lists), np.int64, len(lists))
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate([x for x in lists if x is not None and len(x)] or [np.zeros(0, np.int32)]).astype(np.int32)
    gone = np.fromiter((x is None for x in lists), bool, len(lists))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(gone))


def encode(docs: DataFrame, key: str, text: str, vocabulary: str, long: int = LONG) -> DataFrame:
    """(key, ids ARRAY<INT>) of `docs`."""
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(src.dtypes)["k"]
    schema = f"k {kind}, ids array<int>"
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            ids = [None if t is None else np.asarray(enc.encode_ordinary(t), np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _ids_array(ids)], names=["k", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                cuts = cut_text(t, long, shared.value[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()] * len(cuts), b.column(0).type), pa.array(range(len(cuts)), pa.int32()), pa.array([s for _, s in cuts]),
                        pa.array([p for p, _ in cuts], pa.string())],
                    names=["k", "n", "safe", "piece"],
                )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            ids = [np.asarray(enc.encode_ordinary(t), np.int32) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _ids_array(ids)], names=["k", "n", "safe", "ids"])

    def gather(t: pa.Table) -> pa.Table:
        enc = encoder(shared.value, whole=True)
        t = t.sort_by("n")
        ids = put_together(enc, list(zip(t.column("ids").to_pylist(), t.column("safe").to_pylist())))
        return pa.table({"k": t.column("k").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    is_long = F.coalesce(F.length("t") > long, F.lit(False))
    done = src.filter(~is_long).mapInArrow(short, schema)
    parts = (
        src.filter(is_long)
        .mapInArrow(split, f"k {kind}, n int, safe boolean, piece string")
        .repartition("k", "n")
        .mapInArrow(pieces, f"k {kind}, n int, safe boolean, ids array<int>")
        .groupBy("k")
        .applyInArrow(gather, schema)
    )
    return done.unionByName(parts).select(F.col("k").alias(key), "ids")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public vocabulary file; set TWINFOLD_TOKENIZERS to use another folder."""
    import os

    folder = os.environ.get("TWINFOLD_TOKENIZERS", "/opt/tokenizers")
    return f"{folder}/{name}"


def p6_ids(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path())


def p6_unsplit(spark, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of the letters of every document as one word without a harmless
    cut, in pieces of at most 256 characters: all rows above that come by tree
    concatenation."""
    from ..tables import table

    letters = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\P{L}+", "").alias("text"))
    return encode(letters, "doc_id", "text", vocabulary_path(), long=256)
