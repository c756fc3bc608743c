"""Substring dedup by repeated-phrase automata.

A word goes if some window of ``size`` words that covers it also starts in a
document with a smaller doc_id.

1. Sieve. A window's minimizer is the least hash of its 6-word phrases; equal
   windows have equal minimizers. Phrases that are minimizers in two documents or
   more are kept, each with its owner, the smallest such document. One row in
   four or five words is shuffled, pre-aggregated.
2. Confirm. All documents are cut into segments, the runs of windows whose kept
   minimizers have one owner; windows without a kept minimizer occur in one
   document only and need no look-up. Of the segments' windows, those that occur
   in two documents are confirmed, each with the first document it occurs in,
   whose words give the passage.
3. Compile and stream. Owners are dealt over shards of bounded size; each shard's
   passages become one Aho-Corasick automaton over word numbers, through which
   the shard's segments stream, whole copies included. Owners with many segments
   are salted, their passages copied to every salt; owners with long passages are
   sliced, their segments sent to every slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, small_batches
from .wordhash import Words, byte_chunks, span_hashes

PHRASE = 6
#: Words of passages in a shard's automaton, about (an owner with more is sliced); segments of an owner in a salt, about.
SHARD_WORDS, SALT_ROWS = 25_000, 50_000
_PHRASE_K = 0xD6E8FEB86659FD93


def _minimizers(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, row, minimizer) of every window."""
    hashes = words.hashes()
    at, row, _ = words.windows(hashes, size)
    if not len(at):
        return at, row, np.zeros(0, np.uint64)
    i = np.arange(len(hashes) - PHRASE + 1)
    least = span_hashes(hashes, i, i + PHRASE, _PHRASE_K)
    span, width = size - PHRASE + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return at, row, least[at]


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def phrase_rows(docs: DataFrame, size: int) -> DataFrame:
    """h and doc_id: the minimizers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, data, offsets in byte_chunks(batch.column(1)):
                _, row, least = _minimizers(Words(data, offsets), size)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                yield _batch(h=_ints(least[new]), doc_id=_ints(ids[lo + row[new]]))

    return docs.mapInArrow(run, "h long, doc_id long")


def segments(docs: DataFrame, size: int) -> DataFrame:
    """owner, doc_id, start (word) and text of the runs of windows whose minimizers have one owner; ``docs`` has doc_id, text and kept (array of h and owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, data, offsets in byte_chunks(batch.column(1)):
                words = Words(data, offsets)
                at, row, least = _minimizers(words, size)
                own = np.full(len(at), -1, np.int64)
                some = np.zeros(len(at), bool)
                border = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    pairs = kept[lo + i].values
                    h, o = (pairs.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(h)
                    h, o = h[order], o[order]
                    part = slice(border[i], border[i + 1])
                    want = least[part].view(np.int64)
                    found = np.minimum(np.searchsorted(h, want), len(h) - 1)
                    some[part] = h[found] == want
                    own[part] = np.where(some[part], o[found], 0)
                new = np.ones(len(at), bool)
                new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (some[1:] != some[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                first, last = (x[some[first]] for x in (first, last)) if len(first) else (first, first)
                begin, end = words.starts[at[first]], words.ends[at[last] + size - 1]
                texts = [data[a:z].tobytes().decode() for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
                yield _batch(owner=_ints(own[first]), doc_id=_ints(ids[lo + row[first]]), start=_ints(at[first] - words.first[row[first]]), text=pa.array(texts, pa.string()))

    return docs.select("doc_id", "text", "kept").mapInArrow(run, "owner long, doc_id long, start long, text string")


def confirmed(parts: DataFrame, size: int) -> DataFrame:
    """owner, doc_id and windows (array of hashes): the windows of segments that occur in two documents, by the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in byte_chunks(batch.column(2)):
                words = Words(data, offsets)
                _, row, value = words.windows(words.hashes(), size)
                if len(value):
                    order = np.lexsort((ids[lo + row], value))
                    value, row = value[order], row[order] + lo
                    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                    last = np.append(first[1:], len(value)) - 1
                    yield _batch(w=_ints(value[first]), owner=_ints(owner[row[first]]), low=_ints(ids[row[first]]), high=_ints(ids[row[last]]))

    rows = parts.select("owner", "doc_id", "text").mapInArrow(run, "w long, owner long, low long, high long")
    twice = rows.groupBy("w").agg(F.min("owner").alias("owner"), F.min("low").alias("doc_id"), F.max("high").alias("last")).where("doc_id < last")
    return twice.groupBy("owner", "doc_id").agg(F.collect_list("w").alias("windows"))


def passages(parts: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """owner, doc_id, start, text and n (words): the runs of confirmed windows in the first documents that hold them, in pieces of a quarter shard."""
    piece = max(1, SHARD_WORDS // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ids, starts = (batch.column(i).to_numpy() for i in range(3))
            for lo, hi, data, offsets in byte_chunks(batch.column(3)):
                words = Words(data, offsets)
                at, row, value = words.windows(words.hashes(), size)
                border = np.searchsorted(row, np.arange(hi - lo + 1))
                good = np.zeros(len(at), bool)
                for i in range(hi - lo):
                    part = slice(border[i], border[i + 1])
                    good[part] = np.isin(value[part].view(np.int64), batch.column(4)[lo + i].values.to_numpy())
                new = np.ones(len(at), bool)
                new[1:] = (good[1:] != good[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                first, last = (x[good[first]] for x in (first, last)) if len(first) else (first, first)
                # Long runs in pieces that share the words of a window but one.
                pieces = -(-(last - first + 1) // piece)
                number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first, last = np.repeat(first, pieces) + number * piece, np.repeat(last, pieces)
                last = np.minimum(last, first + piece - 1)
                begin, end = words.starts[at[first]], words.ends[at[last] + size - 1]
                texts = [data[a:z].tobytes().decode() for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
                r = row[first]
                yield _batch(owner=_ints(owner[lo + r]), doc_id=_ints(ids[lo + r]), start=_ints(starts[lo + r] + at[first] - words.first[r]), text=pa.array(texts, pa.string()), n=_ints(at[last] - at[first] + size))

    rows = parts.join(windows, ["owner", "doc_id"]).select("owner", "doc_id", "start", "text", "windows")
    return rows.mapInArrow(run, "owner long, doc_id long, start long, text string, n long")


class Automaton:
    """All windows of a shard's passages, each with the first document that holds it, over word numbers."""

    def __init__(self, size: int):
        self.size, self.numbers = size, {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.ready = False

    def add(self, text: bytes, doc_id: int) -> None:
        numbers = self.numbers
        line = tuple([numbers.setdefault(w, len(numbers) + 1) for w in text.split()])
        for i in range(len(line) - self.size + 1):
            self.trie.add_word(line[i : i + self.size], doc_id)

    def hits(self, text: bytes) -> list[tuple[int, int]]:
        """(last word, first document) of every window that the text shares."""
        if not self.ready:
            self.trie.make_automaton()
            self.ready = True
        get = self.numbers.get
        return list(self.trie.iter(tuple([get(w, 0) for w in text.split()])))

    def covered(self, hits: list[tuple[int, int]], doc_id: int) -> list[list[int]]:
        """Merged word ranges covered by windows that start in an earlier document."""
        out: list[list[int]] = []
        for end, first in hits:
            if first < doc_id:
                if out and end - self.size + 1 <= out[-1][1]:
                    out[-1][1] = end + 1
                else:
                    out.append([end - self.size + 1, end + 1])
        return out


def occurrences(parts: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """doc_id and ranges (array of begin and end words) that the automata locate in the segments."""
    total = found.agg(F.sum("n")).first()[0] or 0
    shards = 1 + total // SHARD_WORDS
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard")
    # A table of its own, so that the joins with it can be split at hot owners.
    lots = lambda df, size, most, name: df.groupBy("owner").agg(size.alias("size")).where(F.col("size") > most).select("owner", F.ceil(F.col("size") / most).cast("int").alias(name))
    hot = materialize(lots(parts, F.count(F.lit(1)), SALT_ROWS, "salts").join(lots(found, F.sum("n"), SHARD_WORDS, "slices"), "owner", "full"), "hot")
    dealt = lambda df: df.join(hot, "owner", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("slices", F.coalesce("slices", F.lit(1)))
    each, of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    laid = dealt(found).select(shard, each("salts").alias("salt"), of("slices", "doc_id", "start").alias("slice"), F.lit(0).alias("kind"), "doc_id", "start", "text")
    sent = dealt(parts).select(shard, of("salts", "doc_id").alias("salt"), each("slices").alias("slice"), F.lit(1).alias("kind"), "doc_id", "start", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, before, hits = None, None, None, []
        for batch in batches:
            ids, ranges = [], []
            for s, salt, piece, kind, doc_id, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, salt, piece) != now:
                    now, automaton, before = (s, salt, piece), Automaton(size), None
                if kind == 0:
                    automaton.add(text.encode(), doc_id)
                elif automaton.numbers:
                    # Equal texts follow each other: copies are streamed, and looked up once.
                    if text != before:
                        before, hits = text, automaton.hits(text.encode())
                    if found := automaton.covered(hits, doc_id):
                        ids.append(doc_id)
                        ranges.append([start + x for r in found for x in r])
            if ids:
                yield _batch(doc_id=pa.array(ids, pa.int64()), ranges=pa.array(ranges, pa.list_(pa.int64())))

    streams = laid.union(sent).repartition("shard", "salt", "slice").sortWithinPartitions("shard", "salt", "slice", "kind", "text")
    rows = streams.mapInArrow(run, "doc_id long, ranges array<long>")
    return rows.groupBy("doc_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def repeated_ranges(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id and ranges (array of begin and end words) of the documents that lose words."""
    if size <= PHRASE:
        raise ValueError(f"windows have more than {PHRASE} words")
    known = small_batches(docs).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    rows = materialize(phrase_rows(known, size), "phrases")
    owners = rows.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("h", "owner")
    owners = materialize(owners, "owners")
    kept = materialize(rows.join(owners, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "owner")).alias("kept")), "kept")
    discard(rows, owners)
    parts = materialize(segments(known.join(kept, "doc_id"), size), "segments")
    discard(kept)
    found = materialize(passages(parts, confirmed(parts, size), size), "passages")
    out = materialize(occurrences(parts, found, size), "ranges")
    discard(parts, found)
    return out


def _removed(n: int, ranges: list[int] | None) -> np.ndarray:
    out = np.zeros(n + 1, np.int64)
    if ranges:
        # Rows that share a doc_id may be shorter than the one a range was found in.
        at = np.minimum(ranges, n)
        np.add.at(out, at[::2], 1)
        np.add.at(out, at[1::2], -1)
    return np.cumsum(out)[:n] > 0


def dedup_substrings(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    A null text has no words. Rows with a null doc_id come before no other and
    keep all words. Rows that share a doc_id count as one document: word places that go
    from one go from all; they come back as often. Texts shorter than a window keep all
    words. Other columns are ignored; an empty table gives an empty result.
    """
    ranges = repeated_ranges(docs, size)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(ranges, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = _removed(len(words), spans)
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words).decode())
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
            yield _batch(doc_id=batch.column(0), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), kept=pa.array(kept, pa.string()))

    return rows.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


