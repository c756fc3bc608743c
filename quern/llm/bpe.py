"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The last token of the encoding of every prefix determines that encoding: the
prefix's last token is the one suffix token that BPE would not have merged
differently with the last token of what stands before it. The distinct pieces of
a batch form a trie; walking it depth first (sorted order is that walk) keeps the
last tokens along the path, so prefixes that pieces share are computed once. A
piece's ids are read off by stepping back from its end. The vocabulary, of fixed
size, is the only thing that is broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .held import only
from .storage import small_batches

#: Fixed value: the pattern that byte-level pre-tokenizers split by.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Distinct pieces that are remembered between batches, and borders of tokens.
REMEMBERED = 400_000


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {chr(b): b for b in plain}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in names.values())}


class Codec:
    """Encoder and decoder of one vocabulary file's JSON text."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self._added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = _byte_names()
        as_bytes = lambda s: bytes(names[c] for c in s)
        ids = {as_bytes(s): i for s, i in model["vocab"].items() if all(c in names for c in s)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Tokens are numbered by the order in which merges make them: the 256 bytes first.
        number = {bytes([b]): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.made: dict[int, int] = {}
        for left, right in merges:
            a, b = as_bytes(left), as_bytes(right)
            if a in number and b in number and a + b not in number:
                number[a + b] = len(self.parts)
                self.parts.append((number[a], number[b]))
                self.made[number[a] << 32 | number[b]] = number[a + b]
        self.number = number
        self.id_list = [ids[t] for t in number]
        self.lengths = [len(t) for t in number]
        # The longest token that ends with each three bytes.
        self.longest: dict[bytes, int] = {}
        for t in number:
            if len(t) > 2:
                self.longest[t[-3:]] = max(self.longest.get(t[-3:], 0), len(t))
        top = max([*ids.values(), *self.added.values()]) + 1
        words = [b""] * top
        for t, i in ids.items():
            words[i] = t
        for t, i in self.added.items():
            words[i] = t.encode()
        self.words = words
        self.decimals = [str(i) for i in range(top)]
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def _stands(self, first: int, second: int) -> bool:
        """Whether BPE keeps the border between two tokens, undoing their merges from the latest."""
        known = self._fits.get(first << 32 | second)
        if known is not None:
            return known
        if len(self._fits) > REMEMBERED:
            self._fits.clear()
        key, limit, answer = first << 32 | second, 1 << 40, None
        while answer is None:
            made = self.made.get(first << 32 | second)
            if made is not None and made < limit:
                answer = False
            elif first > second:
                if first >= 256:
                    limit, first = first, self.parts[first][1]
                else:
                    answer = True
            elif second >= 256:
                limit, second = second + 1, self.parts[second][0]
            elif first >= 256:
                limit, first = first, self.parts[first][1]
            else:
                answer = True
        self._fits[key] = answer
        return answer

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that are not remembered, in one walk over their trie."""
        words = sorted((p.encode(), p) for p in pieces)
        token_of, longest, lengths, fits, stands, ids, known = self.number.get, self.longest.get, self.lengths, self._fits.get, self._stands, self.id_list, self._pieces
        last = [0]
        before = b""
        for word, piece in words:
            shared = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                most = longest(word[end - 3 : end], 2) if end > 2 else end
                for start in range(end - most if most < end else 0, end):
                    token = token_of(word[start:end])
                    if token is not None:
                        if start:
                            ok = fits(last[start] << 32 | token)
                            if not (stands(last[start], token) if ok is None else ok):
                                continue
                        last.append(token)
                        break
            before, at, out = word, len(word), []
            while at:
                token = last[at]
                out.append(ids[token])
                at -= lengths[token]
            out.reverse()
            known[piece] = tuple(out)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; of a null one none."""
        split = [self._added_split.split(t) if self._added_split and t else [t or ""] for t in texts]
        found = [[PIECES.findall(part) for part in parts[::2]] for parts in split]
        known = self._pieces
        pieces = set(chain.from_iterable(chain.from_iterable(found)))
        new = pieces.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = pieces
        self.learn(new)
        ids_of = known.__getitem__
        out = []
        for parts, runs in zip(split, found, strict=True):
            ids: list[int] = []
            for k, run in enumerate(runs):
                if k:
                    ids.append(self.added[parts[2 * k - 1]])
                ids.extend(chain.from_iterable(map(ids_of, run)))
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        words = self.words
        return b"".join([words[i] for i in ids]).decode("utf-8", "replace")


def _codec(spec: str) -> Codec:
    """The codec of a vocabulary, made once in each Python worker."""
    return only(("bpe", hash(spec)), lambda: Codec(spec))


def _runs(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices whose last column has at most ``most`` bytes or ids, one row at least, with that column's values."""
    for batch in batches:
        last = batch.column(batch.num_columns - 1)
        sizes = pc.list_value_length(last) if pa.types.is_list(last.type) else pc.binary_length(last)
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(sizes, 0).to_numpy().astype(np.int64))))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            yield part, part.column(part.num_columns - 1).to_pylist()
            lo = hi


def _spec(docs: DataFrame, path: str):
    """The vocabulary as a broadcast variable; read where the driver runs."""
    with open(path, encoding="utf-8") as f:
        return small_batches(docs).sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; ``docs`` has doc_id and text, a null text counts as empty.

    As the tokenizers library encodes with add_special_tokens=False, without
    truncation or padding; strings of added tokens in a text become their ids.
    """
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for part, texts in _runs(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.encode_batch(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of a table with doc_id and ids; null ids give the empty text."""
    spec = _spec(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for part, ids in _runs(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(i or ()) for i in ids], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and decoded_sha256 of every row: the ids, and the digest of the text they decode to."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for part, texts in _runs(batches):
            encoded = codec.encode_batch(texts)
            digests = [hashlib.sha256(codec.decode(ids).encode()).hexdigest() for ids in encoded]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoded, pa.list_(pa.int32())), pa.array([len(i) for i in encoded], pa.int64()), pa.array(digests, pa.string())], ["doc_id", "ids", "n_tokens", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids, in one pass."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        sha, decimals = hashlib.sha256, codec.decimals
        for part, texts in _runs(batches):
            encoded = codec.encode_batch(texts)
            columns = [
                [len(ids) for ids in encoded],
                [sha(",".join([decimals[i] for i in ids]).encode()).hexdigest() for ids in encoded],
                [sha(codec.decode(ids).encode()).hexdigest() for ids in encoded],
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
