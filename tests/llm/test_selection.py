"""Filter audit, sharding and importance resampling, against plain forms."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, resampling, sharding
from lodestone.llm.queries import OP11_SQL, OP13_SQL, op11_filter_audit, op12_sharding, op13_resampling
from tests.compare import same
from tests.llm import plain

LABEL = "doc_id long, quality int, toxic int"


# --- filter audit ---


def plain_audit(docs, labels):
    """Every order applied to every document, left to right."""
    labels = {i: (q == 1, t == 1) for i, q, t in labels}
    text = lambda t: t or ""
    rank = lambda i: math.inf if i is None else i

    def failed(i, t):
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": any(text(u) == t and rank(j) < rank(i) for j, u, _ in docs),
        }

    parts = defaultdict(list)
    for i, t, s in docs:
        parts[s or ""].append((failed(i, text(t)), *labels.get(i, (False, False))))
    out, removed_by = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                removed_by[part, f] += len(gone)
                out[part, order, step] = [
                    len(kept), len(gone), sum(r[0][f] for r in rows) - len(gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)
                ]
                left = kept
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_orders_are_visited_once():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.adjacent_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_audit(spark):
    rng = random.Random(3)
    pool = ["one", "two", "Three", "FOUR", "a#b", "x|y", "  ", "\n", "fünf", "​", " "]
    texts = [" ".join(rng.choices(pool, k=rng.choice([3, 150, 450]))) for _ in range(30)] + [" ".join(f"w{k}" for k in range(n)) for n in (199, 200, 5000)] + [None, "", "Ab", "A" + "b" * 49, "A" + "b" * 48]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "hot", "hot", "s"])) for i in range(150)]
    docs += [(7, docs[7][1], "s"), (7, docs[7][1], "s"), (None, texts[0], "s"), (None, texts[0], "hot"), (500, "only here", "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 140, 2)]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in docs], "doc_id long, text string, source string, mask int, part int")
    rows = filter_audit.audit_filters(df, spark.createDataFrame([*labels, (None, 1, 1)], LABEL)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows} == plain_audit(docs, labels)
    assert len(rows) == 600 * 4


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(i, "t" if i < 3 else str(i), i % 4) for i in range(12)], "doc_id long, text string, kind int")
    labels = spark.createDataFrame([], LABEL)
    rows = filter_audit.audit_filters(docs, labels, failures={"X": F.col("kind") == 0, "Y": F.col("doc_id") > 7}, copies="Z", part_col="kind").collect()
    assert len(rows) == 4 * 6 * 3
    assert {(r["part"], r["filter_order"]): r["removed"] for r in rows if r["step"] == 1 and r["part"] == "0"} == {("0", "XYZ"): 3, ("0", "XZY"): 3, ("0", "YXZ"): 1, ("0", "YZX"): 1, ("0", "ZXY"): 0, ("0", "ZYX"): 0}
    assert filter_audit.audit_filters(docs.limit(0), labels, part_col="kind").count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, labels, copies="A")


def test_audit_and_its_sql(spark, sf):
    same(op11_filter_audit(spark, sf), OP11_SQL, sf)


# --- sharding ---


def test_draws_have_their_probabilities():
    rng = np.random.default_rng(1)
    for good, bad, draws in [(3, 4, 2), (5, 5, 5), (1, 9, 3), (40, 25, 30), (7, 0, 3), (0, 7, 3), (4, 4, 8), (4, 4, 0)]:
        found = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000))
        fit = 0.0
        for k in range(max(0, draws - bad), min(draws, good) + 1):
            expected = 4000 * math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            fit += (found.pop(k, 0) - expected) ** 2 / max(expected, 1)
        assert not found
        assert fit < 45
    large = [sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**10) for _ in range(200)]
    deviation = (10**10 * 0.25 * 0.75 * 0.975) ** 0.5
    assert abs(np.mean(large) - 2.5e9) < 5 * deviation / 200**0.5
    assert 0.8 < np.std(large) / deviation < 1.25


def test_matrix_has_its_sums_and_probabilities():
    m = sharding.CommunicationMatrix([5, 0, 900, 17, 33_000], sharding.even_sizes(33_922, 7), 3)
    table = np.array([m.row(b) for b in range(5)])
    assert table.sum(axis=0).tolist() == m.shard_sizes
    assert table.sum(axis=1).tolist() == [5, 0, 900, 17, 33_000]
    # every deal of five rows, two of one block and three of two others, to shards of three and two is equally likely
    seen = Counter(tuple(map(tuple, (sharding.CommunicationMatrix([2, 2, 1], [3, 2], seed).row(b) for b in range(3)))) for seed in range(5000))
    ways = Counter()
    for first in itertools.combinations(range(5), 3):
        a = [sum(x in first for x in b) for b in ((0, 1), (2, 3), (4,))]
        ways[tuple((n, size - n) for n, size in zip(a, (2, 2, 1), strict=True))] += 1
    assert set(seen) == set(ways)
    assert sum((seen[k] - 500 * w) ** 2 / (500 * w) for k, w in ways.items()) < 30


def check_shards(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert set(slots) <= set(range(shards))


def test_shards(spark, sf):
    rows = op12_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_shards(rows, 24)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_shuffle_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 512)  # several buckets in a shard
    n, shards = 24_000, 6
    docs = spark.range(0, n, 1, 5).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("slot"), F.lit(2).alias("row"))
    df = sharding.shard_rows(docs, shards=shards)
    assert df.columns == ["doc_id", "text", "row", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = df.collect()
    check_shards(rows, shards)
    place = {r["doc_id"]: r["shard"] * (n // shards) + r["slot"] for r in rows}
    table = Counter((i * 20 // n, p * 20 // n) for i, p in place.items())
    assert sum((table[a, b] - 60) ** 2 / 60 for a in range(20) for b in range(20)) < 361 + 5 * 27
    # neighbours are not left beside one another
    assert sum(abs(place[i + 1] - place[i]) == 1 for i in range(n - 1)) < 20


def test_odd_rows_and_no_rows_in_shards(spark):
    rows = [(None, None), (None, "x"), (1, "é"), (1, "é"), (2, "")] * 3
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    check_shards(got, 4)
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in got) == Counter((i, t, len((t or "").encode()) + 8) for i, t in rows)
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- importance resampling ---


def plain_features(text, runs):
    words = plain.words(text or "")
    return [b" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)], len(words)


def plain_resample(docs, targets, runs=1, buckets=10_000, percent=10, min_words=20):
    at = lambda f: zlib.crc32(f) % buckets
    s, t = (Counter(at(f) for x in texts for f in plain_features(x, runs)[0]) for texts in ([x for _, x in docs], targets))
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, drawable = [], []
    for k, (i, text) in enumerate(docs):
        features, n_words = plain_features(text, runs)
        weight = sum(gain(at(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= min_words:
            drawable.append(k)
    drawn = sorted(drawable, key=lambda k: (-out[k][3], math.inf if out[k][0] is None else out[k][0]))[: percent * len(drawable) // 100]
    for rank, k in enumerate(drawn, 1):
        out[k][4] = rank
    return Counter(map(tuple, out))


def odd_docs(rng):
    pool = ["a", "Bc", "déjà", "x-y", "中文", "12", "🙂 z", "İ", " ", "@", "word" * 100, "Ω"]
    texts = [" ".join(rng.choices(pool, k=rng.choice([0, 5, 25, 60]))) for _ in range(200)]
    return [*enumerate(texts), (900, None), (901, ""), (902, "!!"), (903, "b" * 70_000 + " c " * 40_000)]


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling(spark, runs, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 3000)
    docs = [*odd_docs(random.Random(5)), (None, "one two " * 15)]
    targets = ["déjà vu a 12 12 12", None, "中文 word"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, block int").repartition(3)
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in targets], "text string"), runs=runs, percent=30)
    assert got.columns == ["doc_id", "text", "block", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.drop("text", "block", "n_words").collect())) == plain_resample(docs, targets, runs, percent=30)


def test_words_by_automaton():
    texts = [*(t for _, t in odd_docs(random.Random(9))), "ends", "begins", "", "é", "x" * 255, "y" * 256, "z" * 257]
    for texts_type in (pa.string(), pa.large_string()):
        column = pa.array(["skipped", *texts], texts_type).slice(1)
        found = []
        for data, offsets in resampling.slices(column):
            for size, (buckets, before) in enumerate(resampling.run_buckets(data, offsets, 2, 1 << 31), 1):
                if size == 2:
                    found += [buckets[a:b].tolist() for a, b in itertools.pairwise(before)]
        runs_of_two = [plain_features(t, 2)[0][plain_features(t, 2)[1] :] for t in texts]
        assert found == [[zlib.crc32(f) % (1 << 31) for f in x] for x in runs_of_two]


def test_resampling_of_ties_and_nothing(spark):
    docs = [(1, "w " * 20)] * 4 + [(2, "w " * 20)] * 4 + [(None, "w " * 20)] * 2
    empty = spark.createDataFrame([], "text string")
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), empty, percent=50)
    assert Counter(map(tuple, got.drop("text", "n_words").collect())) == plain_resample(docs, [], percent=50)
    none = resampling.resampled(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert none.count() == 0
    assert none.columns == ["doc_id", "text", "n_words", "n_features", "weight", "score", "rank"]
    short = resampling.resampled(spark.createDataFrame([(1, "few words")], "doc_id long, text string"), empty).collect()
    assert [(r["n_words"], r["rank"]) for r in short] == [(2, None)]


def test_resampling_and_its_sql(spark, sf):
    same(op13_resampling(spark, sf), OP13_SQL, sf)
