"""Language ID: each document's language proportions by expectation-maximisation.

Words are the observations. A word's likelihood in a language is the product of the
probabilities of its byte trigrams (white space stands around it), hashed into a fixed
number of buckets and learned from labelled rows. Expectation-maximisation over all
languages gives proportions; their order nests the candidate sets, and the set kept is the
one with the largest log-likelihood less a penalty for each further language, which grows
with the logarithm of the number of words. Only documents whose likelihood leaves room for
a second language go through the larger sets.

The model may be fitted on a sample: per_language bounds the expected number of labelled
documents of each language, taken whole and chosen by a hash of the id. Its size is the
number of languages times the buckets, whatever the input; more languages than most_languages
are an error before anything is learned. Prediction reads whole texts; likelihoods beyond a
bound are computed again, slice by slice, so memory does not grow with words times languages.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every
text if nothing could be learned; rows without a language teach nothing; of languages with
equal proportions the first by name counts; repeated rows get equal results; an empty table
gives an empty table; a very long text is read whole by one task; input columns named as
results are replaced, the others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import released, text_slices

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: A model of that many languages has 64 MB, which is all that is broadcast.
MOST_LANGUAGES = 256
#: Likelihoods (words x languages) of a slice, and those that a task holds at once.
SLICE, HELD = 1 << 20, 1 << 25


def _folded() -> np.ndarray:
    """Bytes as the trigrams see them: letters lower-cased, what lies outside ASCII as it is, the rest white space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for b in range(ord("a"), ord("z") + 1):
        table[b] = table[b - 32] = b
    return table


FOLDED = _folded()


@dataclass(frozen=True)
class Words:
    """The words of some texts: trigram codes by position, where words begin among them, and each word's text."""

    codes: np.ndarray
    first: np.ndarray
    text: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    data = np.full(sum(map(len, texts)) + len(texts) + 1, 32, np.uint8)
    at, begins = 1, np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        begins[i] = at
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += len(t) + 1
    data = FOLDED[data]
    inside = data != 32
    where = np.flatnonzero(inside)
    wide = data.astype(np.uint32)
    codes = ((wide[where - 1] << 16 | wide[where] << 8 | wide[where + 1]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int32) if len(where) else np.empty(0, np.int32)
    first = np.flatnonzero(~inside[where - 1]) if len(where) else np.empty(0, np.int64)
    return Words(codes, first, np.searchsorted(begins, where[first], "right") - 1)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logp: np.ndarray  # languages x buckets, float32


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 2000, most_languages: int = MOST_LANGUAGES) -> Model:
    """Learns from the rows whose text and language are not null. Each of most_languages takes 256 KB of driver and task."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col)).alias("draw"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()}
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(totals)
    if not languages:
        return Model([], np.empty((0, BUCKETS), np.float32))
    steps = 1 << 20
    chosen: Column = F.lit(False)
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("draw", F.lit(steps)) < max(1, per_language * steps // totals[lang])))
    sample = rows.where(chosen) if any(n > per_language for n in totals.values()) else rows
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part, some in text_slices(batch, "text"):
                for lang in {langs[i] for i in part}:
                    sums[index[lang]] += np.bincount(words_of([t for i, t in zip(part, some, strict=True) if langs[i] == lang]).codes, minlength=BUCKETS)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(sums[lang, bucket], pa.int64())})

    counted = sample.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(languages), BUCKETS))
    sums[counted["lang"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return Model(languages, np.log((sums + 0.05) / (sums.sum(axis=1, keepdims=True) + 0.05 * BUCKETS)).astype(np.float32))


class Likelihoods:
    """What each word says of each language, scaled word by word; held at once or, where that is too much, computed again slice by slice."""

    def __init__(self, words: Words, model: Model) -> None:
        self.words, self.logp = words, model.logp
        languages = len(model.logp)
        self.step = max(1, SLICE // languages)
        present, self.count = np.unique(words.text, return_counts=True)
        self.present, self.owner = present, np.repeat(np.arange(len(present)), self.count)
        self.held = [self._slice(at) for at in self._starts()] if len(words.first) * languages <= HELD else None

    def _starts(self) -> range:
        return range(0, len(self.words.first), self.step)

    def _slice(self, at: int) -> np.ndarray:
        first = self.words.first[at : at + self.step + 1]
        codes = self.words.codes[first[0] : first[-1] if len(first) > self.step else None]
        log = np.stack([np.add.reduceat(row[codes], first[: self.step] - first[0]) for row in self.logp], axis=1).astype(np.float64)
        log -= log.max(axis=1, keepdims=True)
        return np.exp(np.maximum(log, -60))

    def slices(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in some, likelihoods) of the words of some texts (numbers in order)."""
        place = np.full(len(self.present), -1)
        place[some] = np.arange(len(some))
        for i, at in enumerate(self._starts()):
            owner = place[self.owner[at : at + self.step]]
            mine = owner >= 0
            if mine.any():
                lik = self._slice(at) if self.held is None else self.held[i]
                yield (owner, lik) if mine.all() else (owner[mine], lik[mine])


def _add(sums: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    """Adds the values of rows to their owners' sums; rows of an owner stand together."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sums[owner[first]] += np.add.reduceat(values, first, axis=0)


def _maximised(liks: Likelihoods, some: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (some texts x languages) and the logarithm of the scaled likelihood under them."""
    for _ in range(rounds):
        sums = np.zeros(share.shape)
        for owner, lik in liks.slices(some):
            joint = lik * share[owner]
            joint /= joint.sum(axis=1, keepdims=True)
            _add(sums, owner, joint)
        share = np.maximum(sums / liks.count[some, None], 1e-9) * (share > 0)
        share /= share.sum(axis=1, keepdims=True)
    value = np.zeros(len(some))
    for owner, lik in liks.slices(some):
        _add(value, owner, np.log((lik * share[owner]).sum(axis=1)))
    return share, value


def proportions(texts: list[bytes], model: Model, penalty: float = 3.0, rounds: int = 12) -> np.ndarray:
    """texts x languages; a row of zeros for a text without words."""
    n = len(model.languages)
    out = np.zeros((len(texts), n))
    words = words_of(texts)
    if not n or not len(words.first):
        return out
    liks = Likelihoods(words, model)
    everyone = np.arange(len(liks.present))
    share, best = _maximised(liks, everyone, np.full((len(everyone), n), 1 / n), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    value = np.zeros(len(everyone))
    for owner, lik in liks.slices(everyone):
        _add(value, owner, np.log(lik[np.arange(len(owner)), order[owner, 0]]))
    cost = penalty * np.log(liks.count + 1)
    kept = np.zeros((len(everyone), n))
    kept[everyone, order[:, 0]] = 1
    for k in range(2, n + 1):
        some = np.flatnonzero(best - cost * (k - 1) > value)
        if not len(some):
            break
        inside = np.zeros((len(some), n))
        np.put_along_axis(inside, order[some, :k], 1 / k, axis=1)
        got, log_lik = _maximised(liks, some, inside, rounds)
        better = log_lik - cost[some] * (k - 1) > value[some]
        kept[some[better]], value[some[better]] = got[better], (log_lik - cost[some] * (k - 1))[better]
    out[liks.present] = kept
    return out


def _has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] | None = None, penalty: float = 3.0) -> DataFrame:
    """The columns to keep (all by default), lang_pred, score (its proportion) and n_languages (of the set kept)."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "n_languages": T.LongType()}
    kept = [docs.schema[c] for c in (docs.columns if keep is None else keep) if c not in added]
    schema = T.StructType(kept + [T.StructField(k, t) for k, t in added.items()])
    languages, most = np.array([*model.languages, UNDETERMINED], dtype=object), max(1 << 16, (4 << 20) // max(4, len(model.languages)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, some in text_slices(batch, text_col, most):
                part = batch.slice(rows.start, len(rows))
                share = proportions(some, shared.value, penalty)
                known = np.array([_has_letter(t) for t in some], bool) & (share.sum(axis=1) > 0) if share.shape[1] else np.zeros(len(some), bool)
                top = np.where(known, share.argmax(axis=1) if share.shape[1] else -1, -1)
                score = np.where(known, share.max(axis=1, initial=0), 0.0).clip(0, 1)
                columns = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                columns |= {"lang_pred": pa.array(languages[top], pa.string()), "score": pa.array(score), "n_languages": pa.array(np.where(known, (share > 0).sum(axis=1), 0), pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(*dict.fromkeys([f.name for f in kept] + [text_col])).mapInArrow(lambda batches: released(run(batches)), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A third of all ids, by CRC-32 of the id as text; a null id is not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
