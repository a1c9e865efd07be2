"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can end its encoding.  An automaton over the vocabulary
lists the tokens that are suffixes of the prefix; a token is the one if the last token of what stands before it
stays beside it when both are merged afresh (the pair test).  Back-pointers from the whole piece give the ids,
the same as merging by rank does, in time linear in the piece.

The vocabulary file's path is a parameter.  The driver reads it once (its size is the vocabulary's, not the
data's) and tasks get its content.

Edge cases: null counts as empty text and gives no ids.  Strings of special tokens in a text become their ids.
Very long texts and pieces are encoded whole.  Rows are independent: repeated rows, repeated or null ids and other
columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.text import lists
from sieveline.session import ship

#: Letters of all pieces whose ids a task remembers before it starts afresh (Python takes about 25 bytes for each), and pairs whose test it remembers.
CACHE, PAIRS = 4 << 20, 1_000_000
#: Longer pieces aren't remembered.
LONG = 256
#: Fixed value: Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how byte-level BPE cuts text into pieces.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def read_vocabulary(path: str) -> dict:
    """Tokens as bytes by id, merges as id pairs in rank order, special tokens, from a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    ids = said["model"]["vocab"]
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for word, i in ids.items():
        tokens[i] = word.encode() if word in special else bytes(byte_of[c] for c in word)
    for word, i in special.items():
        tokens[i] = word.encode()
    pairs = (x if isinstance(x, list) else x.split(" ") for x in said["model"]["merges"])
    return {"tokens": tokens, "merges": [(ids[a], ids[b], ids[a + b]) for a, b in pairs], "special": special}


class Encoder:
    """Encodes texts as the merges in rank order would."""

    def __init__(self, vocabulary: dict) -> None:
        self.tokens, self.special = vocabulary["tokens"], vocabulary["special"]
        self.made = {(a, b): rank for rank, (a, b, _) in enumerate(vocabulary["merges"])}
        self.parts = {whole: (a, b, rank) for rank, (a, b, whole) in reversed([*enumerate(vocabulary["merges"])])}
        self.never = len(vocabulary["merges"])
        self.suffixes = ahocorasick.Automaton()
        special = set(self.special.values())
        for i, word in enumerate(self.tokens):
            if word and i not in special and (len(word) == 1 or i in self.parts):
                self.suffixes.add_word(word.decode("latin-1"), (len(word), i))
        self.suffixes.make_automaton()
        self.stays: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.find = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and the parts of it at one border, each with the rank of the merge that swallows it."""
        out, until = [(token, self.never)], self.never
        while (made := self.parts.get(token)) is not None:
            token, until = made[side], made[2]
            out.append((token, until))
        return out

    def beside(self, left: int, right: int) -> bool:
        """Whether the border between two tokens outlives a fresh merge of their bytes.

        It does not if some part at the left of it and some part at the right exist together when their own
        merge is due; of merges of one rank the leftmost comes first.
        """
        found = self.stays.get((left, right))
        if found is None:
            heads = self.spine(right, 0)
            found = self.stays[left, right] = not any(
                (rank := self.made.get((x, y), self.never)) < until_x and rank <= until_y and rank < self.never for x, until_x in self.spine(left, 1) for y, until_y in heads
            )
        return found

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(data)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        stays = self.stays
        if len(stays) > PAIRS:
            stays.clear()
        for at, (length, token) in self.suffixes.iter(data.decode("latin-1")):
            end = at + 1
            if size[end]:  # the one last token of this prefix is known
                continue
            if length < end:
                before = last[end - length]
                if before < 0:
                    continue
                fits = stays.get((before, token))
                if fits is None:
                    fits = self.beside(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        ids = []
        while n:
            if not size[n]:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.cut(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            pieces = self.find(part)
            known = self.known
            try:
                out.append(b"".join(map(known.__getitem__, pieces)))
            except KeyError:
                here = {}
                for p in set(pieces):
                    if (made := known.get(p)) is None:
                        made = np.array(self.piece(p.encode()), "<u4").tobytes()
                        if len(p) <= LONG:
                            self.held += len(p)
                            known[p] = made
                    here[p] = made
                out.append(b"".join(map(here.__getitem__, pieces)))
                if self.held > CACHE:
                    known.clear()
                    self.held = 0
        return b"".join(out)


def decode_ids(tokens: list[bytes], ids: list[int]) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with its texts' ids as ``ids`` array<int>."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            made = [encoder.encode(x.as_py() or "") for x in batch.column(at)]
            column = lists(np.frombuffer(b"".join(made), "<u4").astype(np.int32), np.array([len(x) // 4 for x in made], np.int64), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    named = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField(f"c{len(docs.columns)}", T.ArrayType(T.IntegerType()))])
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, named).toDF(*docs.columns, ids)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, hash of the ids and hash of the text decoded from them, of (doc_id, token_ids)."""
    import hashlib

    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path)["tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            counts, hashes, texts = [], [], []
            column = batch.column(1)
            flat, at = column.values.to_numpy().astype("<u4", copy=False), column.offsets.to_numpy()
            for a, b in zip(at[:-1], at[1:], strict=True):
                part = flat[a:b]
                counts.append(b - a)
                hashes.append(hashlib.sha256(part.tobytes()).hexdigest())
                texts.append(hashlib.sha256(decode_ids(tokens, part.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as ``text``; null ids give null."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path)["tokens"])

    @F.pandas_udf("string")
    def run(column):  # noqa: ANN001, ANN202
        return column.map(lambda x: None if x is None else decode_ids(shared.value, list(x)))

    return encoded.withColumn(text, run(F.col(ids)))
