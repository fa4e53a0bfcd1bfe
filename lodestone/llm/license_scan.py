"""License scans: an exact set-similarity join of text blocks (lines) with license templates.

Words are runs of ASCII letters (lower-cased), digits and bytes outside ASCII. A stretch is
words in a row, at most STRETCH times as many as a template has; it meets the template if it
holds at least the threshold's share of its distinct words, and a block does if a stretch of
it does, so words that are scattered over a long line are no match. One pass over all blocks counts how many hold each word of the templates; ordered from the
rarest, a block that meets a template must share one of the template's first words (prefix
filter), have enough distinct words (length filter), and have enough of them left, on both
sides, from the first one shared (positional filter). What passes is verified exactly: in a
block longer than a stretch, a window slides over the places of the template's words.

Notices are usually wrapped, so a template is also met by a stretch across line ends. The same
join finds the templates that a whole text meets; only for those a window slides over it.

The templates are a parameter, by default one-line notices and the texts of license_texts.txt;
their distinct words, which is all that is ever gathered or sent to the executors, are checked
against a bound.

Besides, the places of fixed phrases are found word by word.

Defined results: a null or empty text has no words and no labels; repeated rows get equal
results; an empty table gives an empty table; a very long text is scanned whole by one task in
linear time; input columns named as results are replaced, others with any name stay, also null
ones; a template without words is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import texts_of

#: The phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by which licenses are usually declared, and their labels.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "GNU General Public License, version 2": "gpl-2.0",
    "GNU General Public License, version 3": "gpl-3.0",
    "GNU Lesser General Public License": "lgpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
    "Released under the MIT License": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit-grant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "This is free and unencumbered software released into the public domain": "unlicense",
}
TEXTS = Path(__file__).with_name("license_texts.txt")
MOST_TEMPLATE_WORDS = 100_000
#: Words of a stretch for each word of the template; more than one, for comment marks and small additions.
STRETCH = 2

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def read_templates(path: str | Path) -> dict[str, str]:
    """The templates of a file: each text stands under a line with == and its label."""
    parts = re.split(r"^== *(\S+) *$", Path(path).read_text(encoding="utf-8"), flags=re.M)
    return {text.strip(): label for label, text in zip(parts[1::2], parts[2::2], strict=True)}


def all_templates() -> dict[str, str]:
    return TEMPLATES | read_templates(TEXTS)


class TemplateIndex:
    """Templates with their words from the rarest in the corpus, and the inverted index of their prefixes."""

    def __init__(self, templates: Mapping[str, str], frequency: Mapping[bytes, int], threshold: float) -> None:
        self.rank = {w: i for i, (_, w) in enumerate(sorted((frequency.get(w, 0), w) for w in template_words(templates)))}
        self.labels, self.words, self.need, self.longest = [], [], [], []
        self.prefix: dict[bytes, list[int]] = {}
        for text, label in templates.items():
            own = words_of(text.encode())
            ordered = sorted(set(own), key=self.rank.__getitem__)
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            for w in ordered[: len(ordered) - need + 1]:
                self.prefix.setdefault(w, []).append(len(self.labels))
            self.labels.append(label)
            self.words.append({w: i for i, w in enumerate(ordered)})
            self.need.append(need)
            self.longest.append(STRETCH * len(own))
        self.keys = frozenset(self.prefix)

    def matches(self, block: list[bytes]) -> Iterator[tuple[int, float]]:
        """(number, share of its words) of each template that the block meets with its best stretch."""
        for k, share in self.joined(block):
            if len(block) <= self.longest[k]:
                yield k, share
            elif best := self.stretch(block, k):
                yield k, best[2]

    def joined(self, block: list[bytes]) -> Iterator[tuple[int, float]]:
        """(number, share of its words) of each template of whose words the whole block holds enough."""
        if self.keys.isdisjoint(block):
            return
        held = set(block)
        mine = sorted(held & self.rank.keys(), key=self.rank.__getitem__)
        seen = set()
        for j, w in enumerate(mine):
            for k in self.prefix.get(w, ()):
                words, need = self.words[k], self.need[k]
                if k in seen or len(held) < need:
                    continue
                seen.add(k)
                if min(len(words) - words[w], len(mine) - j) < need:
                    continue
                if (n := sum(x in held for x in words)) >= need:
                    yield k, n / len(words)

    def stretch(self, words: list[bytes], k: int, line: list[int] | None = None) -> tuple[int, int, float] | None:
        """(first word, last word, share) of the first of the stretches that meet template k best; of those across line ends if the words' lines are given."""
        own, longest = self.words[k], self.longest[k]
        places = [i for i, w in enumerate(words) if w in own]
        held: Counter[bytes] = Counter()
        best, most, left = None, self.need[k] - 1, 0
        for right in places:
            held[words[right]] += 1
            while right - places[left] >= longest or held[words[places[left]]] > 1:  # what stands again later is not needed
                w = words[places[left]]
                held[w] -= 1
                if not held[w]:
                    del held[w]
                left += 1
            if len(held) > most and (line is None or line[places[left]] != line[right]):
                best, most = (places[left], right, len(held) / len(own)), len(held)
        return best


def template_words(templates: Mapping[str, str]) -> set[bytes]:
    found = [set(words_of(t.encode())) for t in templates]
    if not all(found):
        raise ValueError("a template has no words")
    words = set().union(*found)
    if len(words) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} distinct words")
    return words


def block_frequencies(docs: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of all texts each of the words stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch, text_col):
                for line in text.split(b"\n"):
                    counts.update(words.intersection(words_of(line)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def phrase_places(words: list[bytes], phrases: Mapping[bytes, str]) -> list[tuple[int, str]]:
    """(first word from 0, label) of every place of the phrases."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        at, before, word = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", before, at)  # counted on from the place before
            found.append((word, label))
            at, before = joined.find(phrase, at + 1), at
    return found


def scan_licenses(docs: DataFrame, *, templates: Mapping[str, str] | None = None, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.9, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns to keep (all by default), n_words, n_base, first_word, last_word, base_labels, labels, score, matches and wrapped.

    matches: (block from 0, label, share of its best stretch) of every block that meets a template; wrapped: (first
    line, last line, label, share) of the best stretch across line ends of every template that
    one meets better than any block. score is the largest share, 1 where a phrase stands.
    """
    match = T.StructType([T.StructField("block", T.LongType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())])
    stretch = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())])
    added = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "matches": T.ArrayType(match), "wrapped": T.ArrayType(stretch)}
    arrow = {T.LongType: pa.int64(), T.StringType: pa.string(), T.DoubleType: pa.float64()}
    lists = {"matches": pa.list_(pa.struct({"block": pa.int64(), "label": pa.string(), "share": pa.float64()})), "wrapped": pa.list_(pa.struct({"first": pa.int64(), "last": pa.int64(), "label": pa.string(), "share": pa.float64()}))}
    kept = [docs.schema[c] for c in (docs.columns if keep is None else keep) if c not in added]
    schema = T.StructType(kept + [T.StructField(k, t) for k, t in added.items()])
    templates = all_templates() if templates is None else templates
    index = TemplateIndex(templates, block_frequencies(docs, template_words(templates), text_col), threshold)
    spaced = {b" " + b" ".join(words_of(p.encode())) + b" ": label for p, label in phrases.items()}

    def of(text: bytes) -> tuple:
        words = words_of(text)
        base = phrase_places(words, spaced)
        met, wrapped = [], []
        if whole := [k for k, _ in index.joined(words)]:
            lines = [words_of(x) for x in text.split(b"\n")]
            met = [(i, k, share) for i, x in enumerate(lines) for k, share in index.matches(x)]
            line = [i for i, x in enumerate(lines) for _ in x]
            for k in whole:
                best = index.stretch(words, k, line)
                if best and best[2] > max((share for _, j, share in met if j == k), default=0.0):
                    wrapped.append((k, line[best[0]], line[best[1]], best[2]))
        places, own = [p for p, _ in base], {label for _, label in base}
        return (
            len(words),
            len(base),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(own)),
            ",".join(sorted(own | {index.labels[k] for _, k, _ in met} | {index.labels[k] for k, *_ in wrapped})),
            1.0 if base else max((x[-1] for x in (*met, *wrapped)), default=0.0),
            [{"block": b, "label": index.labels[k], "share": share} for b, k, share in met],
            [{"first": a, "last": b, "label": index.labels[k], "share": share} for k, a, b, share in wrapped],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(t) for t in texts_of(batch, text_col)]
            columns = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept}
            for k, (name, kind) in enumerate(added.items()):
                columns[name] = pa.array([x[k] for x in found], lists.get(name) or arrow[type(kind)])
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(*dict.fromkeys([f.name for f in kept] + [text_col])).mapInArrow(run, schema)
