"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased, every run of non-letters becomes one space. 5-gram counts of
all training rows are made in the tasks and summed by a shuffle. Continuation
counts, discounts and the interpolated probabilities of all orders are Spark
tables made from all counts; the driver sees no n-gram, only how many of each
order and language occur once and twice. The tables lie in the shared folder,
where each Python worker reads them once. There each order is a sorted array of
n-gram hashes with one row of log probabilities per n-gram, found through an
index of the leading hash bits; n-grams without a row back off. A document's
language is the one with the lowest cross-entropy per character.

Training rows that counts did not use calibrate two things: the score (share of
right answers at such a lead over the second language) and the rejection limit
(cross-entropy per language and length that all but one in 10,000 of the rightly
judged rows keep, and a quarter of a nat).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .held import nothing, only
from .storage import discard, materialize, small_batches
from .wordhash import mix

ORDER = 5
#: Steps in a nat, for calibration.
STEPS = 100
UNKNOWN = "und"
_K = 0x9E3779B97F4A7C15
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each led by ORDER - 1 spaces and closed by one, and where each begins (n + 1)."""
    low = [t.lower() for t in texts]
    lead = " " * (ORDER - 1)
    raw = np.frombuffer((lead + (" " + lead).join(low) + " ").encode("utf-32-le"), np.uint32)
    begin = np.concatenate(([0], np.cumsum([len(t) + ORDER for t in low])))
    letter = _is_letter()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    head = (begin[:-1][:, None] + np.arange(ORDER - 1)).ravel()
    keep[head] = True
    out = np.where(letter, raw, np.uint32(32))[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[begin]


def gram_hashes(chars: np.ndarray) -> list[np.ndarray]:
    """For n from 0 to ORDER, hashes of the n characters that end at each place."""
    c = chars.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(c), np.uint64)
    out = [mix(total)]
    factor = 1
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(c), np.uint64)
        shifted[n - 1 :] = c[: max(0, len(c) - n + 1)]
        total = total + shifted * np.uint64(factor)
        factor = factor * _K & ((1 << 64) - 1)
        out.append(mix(total + np.uint64(n * 0xD6E8FEB86659FD93 & ((1 << 64) - 1))))
    return out


def _places(begin: np.ndarray) -> np.ndarray:
    """True at characters to predict: all but each text's lead."""
    real = np.ones(int(begin[-1]), bool)
    real[(begin[:-1][:, None] + np.arange(ORDER - 1)).ravel()] = False
    return real


@dataclass
class Hashed:
    """Rows of values by hash: sorted keys, an index of their leading bits."""

    keys: np.ndarray
    rows: np.ndarray
    shift: int = 0
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Hashed:
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        bits = max(1, len(keys).bit_length())
        shift = 64 - bits
        index = np.searchsorted(keys >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(keys, rows, shift, index)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        at = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return at
        lead = (hashes >> np.uint64(self.shift)).astype(np.int64)
        low, high = self.index[lead], self.index[lead + 1]
        open_ = np.flatnonzero(low < high)
        low, high, want = low[open_], high[open_], hashes[open_]
        while len(open_):
            hit = self.keys[low] == want
            at[open_[hit]] = low[hit]
            go = ~hit & (low + 1 < high)
            open_, low, high, want = open_[go], low[go] + 1, high[go], want[go]
        return at


@dataclass
class Model:
    """languages; per order the log probabilities of n-grams and log back-off weights of contexts, or the tables that hold them; limits and scores when calibrated."""

    languages: list[str]
    grams: list[Hashed]
    contexts: list[Hashed]
    unseen: float
    limits: dict[tuple[str, int], float] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tables: list[tuple[str, str]] = field(default_factory=list)

    def loaded(self) -> Model:
        """The model with its arrays; a process keeps those of one model."""
        if self.tables:
            self.grams, self.contexts = only(("language", self.tables[0][0]), self._all)
        return self

    def _all(self) -> tuple[list[Hashed], list[Hashed]]:
        none = self._read("")
        return [none, *(self._read(g) for g, _ in self.tables)], [none, *(self._read(c) for _, c in self.tables)]

    def _read(self, uri: str) -> Hashed:
        if not uri:
            return Hashed.of(np.zeros(0, np.uint64), np.zeros((0, len(self.languages)), np.float32))
        store, path = FileSystem.from_uri(uri)
        table = pq.read_table(path, columns=["hash", "row"], filesystem=store)
        rows = table["row"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return Hashed.of(table["hash"].to_numpy().view(np.uint64), rows.reshape(-1, len(self.languages)))

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character for each text and language, number of letters)."""
        chars, begin = codes(texts)
        hashes = gram_hashes(chars)
        place = np.flatnonzero(_places(begin))
        sums = np.zeros((len(chars) + 1, len(self.languages)), np.float32)
        todo = place
        for n in range(ORDER, 0, -1):
            at = self.grams[n].find(hashes[n][todo])
            hit = at >= 0
            sums[todo[hit] + 1] += self.grams[n].rows[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            at = self.contexts[n].find(hashes[n - 1][todo - 1])
            hit = at >= 0
            sums[todo[hit] + 1] += self.contexts[n].rows[at[hit]]
        sums[todo + 1] += np.float32(self.unseen)
        filled = begin[1:] > begin[:-1]
        total = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            total[filled, k] = np.add.reduceat(sums[1:, k].astype(np.float64), begin[:-1][filled])
        letters = np.concatenate(([0], np.cumsum(chars != 32)))
        letters = letters[begin[1:]] - letters[begin[:-1]]
        size = np.maximum(1, begin[1:] - begin[:-1] - (ORDER - 1))
        return -total / size[:, None], letters

    def judge(self, texts: list[str]) -> pd.DataFrame:
        """lang_pred, entropy (of that language), lead (nats over the second language, all characters), letters, score and rejected."""
        if not self.languages:
            n = len(texts)
            return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "entropy": 0.0, "lead": 0.0, "letters": 0, "score": 0.0, "rejected": True})
        entropy, letters = self.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        ordered = np.sort(entropy, axis=1)
        lead = (ordered[:, 1] - ordered[:, 0]) * (letters + 1) if len(self.languages) > 1 else letters * 1.0
        known = letters > 0
        names = np.array(self.languages, object)[best]
        least = ordered[:, 0]
        scores = self.scores[np.minimum(lead_bin(lead), len(self.scores) - 1)] if len(self.scores) else np.ones(len(texts))
        limit = np.array([self.limits.get((n, b), np.inf) for n, b in zip(names, length_bin(letters), strict=True)])
        return pd.DataFrame({
            "lang_pred": np.where(known, names, UNKNOWN), "entropy": least, "lead": lead, "letters": letters,
            "score": np.where(known, scores, 0.0), "rejected": ~known | (least > limit),
        })


def lead_bin(lead: np.ndarray) -> np.ndarray:
    return np.minimum(31, np.floor(np.log2(1 + np.maximum(lead, 0)) * 3)).astype(int)


def length_bin(letters: np.ndarray) -> list[int]:
    """Short texts vary more: powers of two up to 2**12."""
    return np.minimum(12, np.floor(np.log2(np.maximum(letters, 1)))).astype(int).tolist()


def estimate(counts: pd.DataFrame) -> Model:
    """The model of a local table with lang, gram (ORDER characters) and n; every pair of lang and gram once. build() makes the same in Spark."""
    languages = sorted(counts["lang"].unique())
    if not languages:
        return Model([], [], [], 0.0)
    table = counts.pivot_table(index="gram", columns="lang", values="n", aggfunc="sum", fill_value=0)[languages]
    grams, values = [""] * (ORDER + 1), [np.zeros(0)] * (ORDER + 1)
    grams[ORDER], values[ORDER] = np.array(table.index, object), table.to_numpy(np.float64)
    for n in range(ORDER - 1, 0, -1):
        ends = pd.Index([g[1:] for g in grams[n + 1]])
        code, names = ends.factorize()
        grams[n] = np.array(names, object)
        values[n] = np.zeros((len(names), len(languages)))
        np.add.at(values[n], code, values[n + 1] > 0)
    unseen = 1.0 / (len(grams[1]) + 1)
    lower = np.full((1, len(languages)), unseen)
    tables, contexts = [Hashed.of(np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32))], [None]
    for n in range(1, ORDER + 1):
        c = values[n]
        ones, twos = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2.0 * twos, 1), 0.5)
        context, names = pd.Index([g[:-1] for g in grams[n]]).factorize()
        total, kinds = np.zeros((len(names), len(languages))), np.zeros((len(names), len(languages)))
        np.add.at(total, context, c)
        np.add.at(kinds, context, c > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        weight = np.maximum(weight, 1e-6)
        below = lower[pd.Index(grams[n - 1]).get_indexer([g[1:] for g in grams[n]])] if n > 1 else np.repeat(lower, len(grams[1]), axis=0)
        lower = np.maximum(c - discount, 0) / np.maximum(total[context], 1) + weight[context] * below
        tables.append(Hashed.of(_hash_of(grams[n], n), np.log(lower).astype(np.float32)))
        contexts.append(Hashed.of(_hash_of(names, n - 1), np.log(weight).astype(np.float32)))
    return Model(languages, tables, contexts, float(np.log(unseen)))


def _hash_of(strings: np.ndarray | pd.Index, n: int) -> np.ndarray:
    """Hashes of strings of n characters, as gram_hashes has them."""
    if n == 0:
        return mix(np.zeros(len(strings), np.uint64))
    chars = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    return gram_hashes(chars)[n][n - 1 :: n]


def _rows(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` characters, one row at least; the text is the last column."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.utf8_length(text), 0).to_numpy().astype(np.int64))))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, gram and n over all rows with lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing()
        for part in _rows(batches):
            langs = np.array(part.column(0).to_pylist(), object)
            texts = part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                chars, begin = codes([texts[i] for i in np.flatnonzero(langs == lang)])
                grams, n = distinct_grams(chars, np.flatnonzero(_places(begin)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n)], ["lang", "gram", "n"])

    rows = small_batches(labelled).where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def distinct_grams(chars: np.ndarray, place: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct ORDER characters that end at the places, and how often each occurs.

    Characters are numbered within this call, so that an n-gram packs into 64
    bits and one sort of integers counts; alphabets too large for that are split
    by the n-grams' first character.
    """
    present = np.zeros(0x110000, bool)
    present[chars] = True
    alphabet = np.flatnonzero(present).astype(np.uint32)
    index = np.zeros(0x110000, np.int32)
    index[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    number = index[chars].astype(np.int64)
    if len(alphabet) > 6000:
        lead = number[place - ORDER + 1]
        parts = [distinct_grams_of(alphabet, number, place[lead == c], ORDER - 1) for c in np.unique(lead)]
        heads = np.unique(lead)
        return [chr(alphabet[h]) + g for h, (gs, _) in zip(heads, parts, strict=True) for g in gs], np.concatenate([n for _, n in parts])
    return distinct_grams_of(alphabet, number, place, ORDER)


def distinct_grams_of(alphabet: np.ndarray, number: np.ndarray, place: np.ndarray, order: int) -> tuple[list[str], np.ndarray]:
    base = len(alphabet) + 1
    packed = np.zeros(len(place), np.int64)
    for k in range(order - 1, -1, -1):
        packed = packed * base + number[place - k]
    packed.sort()
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
    value, n = packed[first], np.diff(np.append(first, len(packed)))
    letters = np.empty((len(value), order), np.uint32)
    for k in range(order - 1, -1, -1):
        letters[:, k] = alphabet[value % base]
        value = value // base
    text = letters.tobytes().decode("utf-32-le")
    return [text[i : i + order] for i in range(0, len(text), order)], n.astype(np.int64)


def build(counts: DataFrame) -> Model:
    """The model of a table with lang, gram (ORDER characters) and n, all of it, as tables of hash and row by order."""
    counts = materialize(counts, "grams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        discard(counts)
        return Model([], [], [], 0.0)
    each = range(len(languages))
    values = {ORDER: counts.groupBy("gram").agg(F.array(*(F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)) for name in languages)).alias("c"))}
    kinds = F.array(*(F.sum((F.col("c")[k] > 0).cast("long")) for k in each))
    for n in range(ORDER, 0, -1):
        values[n] = materialize(values[n], f"counts{n}")
        values[n - 1] = values[n].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(kinds.alias("c"))
    once = [F.array(*(F.sum((F.col("c")[k] == times).cast("long")) for k in each)).alias(f"n{times}") for times in (1, 2)]
    seen = {n: values[n].agg(F.count(F.lit(1)).alias("n"), *once).first() for n in range(1, ORDER + 1)}
    unseen = 1.0 / (seen[1]["n"] + 1)
    below = F.array(*(F.lit(unseen) for _ in each))
    lower, tables, made = None, [], [counts]
    for n in range(1, ORDER + 1):
        discount = [ones / (ones + 2.0 * twos) if ones else 0.5 for ones, twos in zip(seen[n]["n1"], seen[n]["n2"], strict=True)]
        total = F.array(*(F.sum(F.col("c")[k]) for k in each))
        sums = values[n].groupBy(F.expr(f"substring(gram, 1, {n - 1})").alias("context")).agg(total.alias("total"), kinds.alias("kinds"))
        weight = F.array(*(F.when(F.col("total")[k] > 0, F.greatest(F.lit(discount[k]) * F.col("kinds")[k] / F.col("total")[k], F.lit(1e-6))).otherwise(1.0) for k in each))
        sums = sums.select("context", "total", weight.alias("weight"))
        contexts = materialize(_hashed(sums.select("*", _logs("weight", each)), n - 1), f"contexts{n}")
        rows = values[n].withColumn("context", F.expr(f"substring(gram, 1, {n - 1})")).join(contexts.select("context", "total", "weight"), "context")
        rows = rows.withColumn("below", below) if lower is None else rows.withColumn("rest", F.expr("substring(gram, 2)")).join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("below")), "rest")
        chance = F.array(*(F.greatest(F.col("c")[k] - discount[k], F.lit(0.0)) / F.greatest(F.col("total")[k], F.lit(1)) + F.col("weight")[k] * F.col("below")[k] for k in each))
        lower = materialize(_hashed(rows.select("gram", chance.alias("p")).select("*", _logs("p", each)), n), f"grams{n}")
        tables.append((_uri(lower), _uri(contexts)))
        made.append(values[n])
    discard(*made)
    return Model(languages, [], [], float(np.log(unseen)), tables=tables)


def _logs(column: str, each: range) -> Column:
    return F.array(*(F.log(F.col(column)[k]).cast("float") for k in each)).alias("row")


def _hashed(df: DataFrame, n: int) -> DataFrame:
    """The hash of the first column, strings of n characters, before the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = _hash_of(np.array(batch.column(0).to_pylist(), object), n).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), *batch.columns], ["hash", *batch.schema.names])

    return df.mapInArrow(run, "hash long, " + ", ".join(f"{c} {t}" for c, t in df.dtypes))


def _uri(df: DataFrame) -> str:
    """Where materialize wrote df, with its file system named."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.quern_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString().replace("s3a:", "s3:")


def _judge(docs: DataFrame, model: Broadcast) -> DataFrame:
    """doc_id, its other columns before text, and the model's judgement of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pickle.loads(model.value).loaded()
        for part in _rows(batches):
            said = at.judge([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
            own = [part.column(i) for i in range(part.num_columns - 1)]
            types = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(said[c], t) for c, t in zip(said.columns, types, strict=True))], [*part.schema.names[:-1], *said.columns])

    own = ", ".join(f"{c} {t}" for c, t in docs.dtypes[:-1])
    return docs.mapInArrow(run, f"{own}, lang_pred string, entropy double, lead double, letters long, score double, rejected boolean")


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def train(labelled: DataFrame) -> Model:
    """Counts on the rows of folds 0 and 1, calibration on those of fold 3; fold 2 is never read.

    Without fold 3, limits stay infinite and the score is 1. Rows with a null
    lang or text teach nothing. Every n-gram counts.
    """
    model = build(count_grams(labelled.where(fold(F.col("doc_id")) < 2)))
    if not model.languages:
        return model
    shipped = labelled.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rest = labelled.where((fold(F.col("doc_id")) == 3) & F.col("lang").isNotNull()).select(F.col("lang").alias("truth"), "text")
    judged = _judge(rest, shipped).where("letters > 0").select("lang_pred", "letters", "lead", "entropy", (F.col("truth") == F.col("lang_pred")).alias("right"))
    judged = materialize(judged, "judged")
    bins = F.least(F.lit(31), F.floor(F.log2(1 + F.greatest("lead", F.lit(0.0))) * 3)).alias("bin")
    leads = judged.groupBy(bins).agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right")).toPandas()
    length = F.least(F.lit(12), F.floor(F.log2("letters")))
    spread = judged.where("right").groupBy("lang_pred", length.alias("length"), F.floor(F.col("entropy") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    discard(judged)
    model.limits = _limits(spread)
    model.scores = _monotone(leads.set_index("bin"))
    return model


def _limits(spread: pd.DataFrame, rate: float = 1e-4, slack: float = 0.25) -> dict[tuple[str, int], float]:
    """Per language and length: ``slack`` nats above what all but a share ``rate`` of the rightly judged calibration rows have; shorter texts never have a lower limit.

    ``spread`` has lang_pred, length, step (of entropy, STEPS a nat) and n. The
    share, not the largest value, decides: odd rows among many lift no limit.
    """
    out = {}
    for lang, part in spread.groupby("lang_pred"):
        low = 0.0
        for length in range(12, -1, -1):
            rows = part[part["length"] == length].sort_values("step")
            if len(rows):
                most = rows["n"].cumsum() >= (1 - rate) * rows["n"].sum()
                low = max(low, (rows["step"][most].iloc[0] + 1) / STEPS + slack)
            out[lang, length] = low if low else np.inf
        for length in range(12, -1, -1):
            if np.isfinite(out[lang, length]):
                break
            out[lang, length] = low or np.inf
    return out


def _monotone(bins: pd.DataFrame) -> np.ndarray:
    """Share of right answers for each bin of the lead, made non-decreasing by pooling neighbours."""
    blocks: list[list[float]] = []
    for b in range(32):
        n, right = (float(bins.loc[b, c]) if b in bins.index else 0.0 for c in ("n", "right"))
        blocks.append([right + 0.5, n + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), min(1.0, r / n)) for r, n, k in blocks])


def identify(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text, lang) and judge all its rows.

    doc_id, held_out (fold 2), lang_pred (a learned lang, or ``und`` for a null
    text or one without letters), score (0 to 1), rejected, entropy and letters of
    every row. Repeated rows come back as often, other columns are ignored, an
    empty table gives an empty result; where no row has a lang all are ``und``.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(docs)))
    judged = _judge(docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 2).alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy", "letters")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns.

    A text is judged where it stands: no join, so repeated and null doc_ids are no matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(docs)))
    names = [f"__{i}" for i in range(len(docs.columns))]
    judged = _judge(docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col("text").alias("__text")), model)
    return judged.where("not rejected").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
