"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A long text is halved until its parts are leaves; leaves are encoded in batches,
and parts are joined again in pairs.  A join encodes a window of tokens around the
seam.  If the window's first tokens equal those of the left part and its last ones
those of the right part, the window's tokens replace them; otherwise the window
doubles.  A window that reaches both ends is the plain encoding.

Texts of more than SPREAD characters are halved over tasks: their parts are
encoded in parallel by all executors and joined by one task for each text.
Shorter texts are encoded within the task that reads them.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.tables import read_table

#: Characters of a leaf; longer texts are halved.
LEAF = 16_384
#: Characters above which a text's parts go to different tasks, and of such a part.
SPREAD = 524_288
#: Tokens on each side of a seam in the first window, and how many must agree.
WINDOW, AGREE = 24, 6
#: Characters that go to the library in one call.
BATCH_CHARS = 262_144

_loaded: dict[str, Codec] = {}


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, are the
    characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE tokenizer of the tokenizers library, from its file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        symbol = byte_of_symbol()
        self.piece: list[bytes] = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in parts["model"]["vocab"].items():
            self.piece[i] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
        for added in parts.get("added_tokens", []):
            self.piece[added["id"]] = added["content"].encode()
        self.width = np.array([len(p) for p in self.piece], dtype=np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        """Encodings by the library, in calls of bounded size."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            out += [e.ids for e in self.library.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def joined(self, left: list[int], right: list[int], text: bytes, seam: int) -> list[int]:
        """The encoding of text from those of text[:seam] and text[seam:] (in bytes)."""
        k = WINDOW
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            start = seam - int(self.width[left[a:]].sum())
            while a and text[start] & 0xC0 == 0x80:
                a -= 1
                start -= int(self.width[left[a]])
            end = seam + int(self.width[right[:b]].sum())
            while b < len(right) and text[end] & 0xC0 == 0x80:
                end += int(self.width[right[b]])
                b += 1
            ids = self.plain([text[start:end].decode()])[0]
            first = ids[:AGREE] == left[a : a + AGREE] and len(left) - a > AGREE
            last = ids[-AGREE:] == right[max(0, b - AGREE) : b] and b > AGREE
            if (not a or first) and (b == len(right) or last):
                return left[:a] + ids + right[b:]
            k *= 2

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[list[int]]:
        """Encodings of whole texts; those longer than a leaf by tree concatenation."""
        leaves: list[str] = []
        plans: list = []

        def halve(text: str):
            if len(text) <= leaf:
                leaves.append(text)
                return len(leaves) - 1
            half = len(text) // 2
            return halve(text[:half]), halve(text[half:]), text, half

        def join(plan) -> list[int]:
            if isinstance(plan, int):
                return done[plan]
            left, right, text, half = plan
            seam = len(text[:half].encode())
            return self.joined(join(left), join(right), text.encode(), seam)

        for text in texts:
            plans.append(halve(text))
        done = self.plain(leaves)
        return [join(p) for p in plans]

    def assembled(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        """The encoding of a text from its parts in order and their encodings, joined as a tree."""
        level = [(text.encode(), ids) for text, ids in parts]
        while len(level) > 1:
            pairs = [(level[i][0] + level[i + 1][0], self.joined(level[i][1], level[i + 1][1], level[i][0] + level[i + 1][0], len(level[i][0])))
                     for i in range(0, len(level) - 1, 2)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0][1]

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8; bytes that are none become U+FFFD, as the library does."""
        raw = b"".join(map(self.piece.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _batches(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= most):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _digest_row(use: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(use.decode(ids)).hexdigest()


def _digest_batch(doc_ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, ids_sha, text_sha = ([r[i] for r in rows] for i in range(3))
    return pa.RecordBatch.from_arrays(
        [doc_ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids_batch(doc_ids: pa.Array, rows: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _short(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """Whole texts of one task."""
    use = codec(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            own = batch.slice(at, 512)
            texts = [t or "" for t in own.column("text").to_pylist()]
            for a, b in _batches(texts):
                found = use.encode(texts[a:b])
                doc_ids = own.column("doc_id").slice(a, b - a)
                yield _digest_batch(doc_ids, [_digest_row(use, ids) for ids in found]) if digest else _ids_batch(doc_ids, found)


_PARTS = "doc_id long, copies long, print string, part int, text string"


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The parts of long texts."""
    for batch in batches:
        for i, copies, print_, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copies", "print", "text")), strict=True):
            for part, at in enumerate(range(0, len(text), size)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([copies], pa.int64()), pa.array([print_]), pa.array([part], pa.int32()), pa.array([text[at : at + size]])],
                    names=["doc_id", "copies", "print", "part", "text"])


def _encode_parts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    use = codec(path)
    for batch in batches:
        for row in range(batch.num_rows):
            own = batch.slice(row, 1)
            ids = use.encode([own.column("text")[0].as_py()])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*own.schema.names, "ids"])


def _join_parts(table: pa.Table, path: str, digest: bool) -> pa.Table:
    """One long text, as often as it stands."""
    use = codec(path)
    table = table.sort_by("part")
    ids = use.assembled(list(zip(table["text"].to_pylist(), table["ids"].to_pylist(), strict=True)))
    copies = table["copies"][0].as_py()
    doc_ids = pa.array([table["doc_id"][0].as_py()] * copies, pa.int64())
    batch = _digest_batch(doc_ids, [_digest_row(use, ids)] * copies) if digest else _ids_batch(doc_ids, [ids] * copies)
    return pa.Table.from_batches([batch])


def _encoded(docs: DataFrame, path: str, digest: bool, spread: int) -> DataFrame:
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > spread, F.lit(False))
    # rows that are equal are one text with a count
    parts = (
        texts.where(long).withColumn("print", F.sha2("text", 256)).groupBy("doc_id", "print").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        .mapInArrow(lambda b: _cut(b, spread), _PARTS).repartition("doc_id", "print", "part")
        .mapInArrow(lambda b: _encode_parts(b, path), f"{_PARTS}, ids array<int>"))
    whole = parts.groupBy("doc_id", "print").applyInArrow(lambda t: _join_parts(t, path, digest), schema)
    return texts.where(~long).mapInArrow(lambda b: _short(b, path, digest), schema).unionByName(whole)


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    use = codec(path)
    for batch in batches:
        texts = [None if ids is None else use.decode(ids).decode() for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, path: str, spread: int = SPREAD) -> DataFrame:
    """doc_id and ids (array<int>) of every text; null text is encoded as empty, with no ids.

    Rows, repeated ones too, stay as often as they stand, and null ids stay null;
    an empty table gives an empty result; columns other than doc_id and text are
    ignored.  `spread` moves work between tasks and never changes the result.
    """
    return _encoded(docs, path, False, spread)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every list of ids; null ids give null text."""
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        lambda b: _decoded(b, path), "doc_id long, text string")


def digests(docs: DataFrame, path: str, spread: int = SPREAD) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of what they decode to.

    The same rules for nulls and edge cases as `encode`.
    """
    return _encoded(docs, path, True, spread)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the 50k byte-level vocabulary."""
    return digests(read_table(spark, sf_dir, "documents"), tokenizer_path())
