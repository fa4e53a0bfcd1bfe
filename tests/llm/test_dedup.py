import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bag_minhash, components, hnsw, line_dedup, queries, suffix_dedup
from tests.compare import same
from tests.llm import plain


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], plain.TEXT)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_agrees_with_its_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


# --- lines ---

LINES = ["a common line of text", "A COMMON line of text \t", "short", "straße und Ä äöü", "straße und ä äöü", "", "  ", "unique {}"]


def test_lines(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(LINES).format(i) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "\n"), (93, "a common line of text\n" * 3000 + "end")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs(spark, rows).repartition(3)).collect()}
    assert got == plain.line_dedup(rows)


def test_lines_of_repeated_rows_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "same old line\nx", 7, "a"), (1, "same old line\nx", 7, "a"), (None, "same old line\ny", 8, None), (2, "same old line", 9, "b")], "doc_id long, text string, n_dropped int, pos string")
    got = sorted((str(r["doc_id"]), r["text"], r["n_dropped"], str(r["pos"])) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("1", "same old line\nx", 0, "a"), ("1", "same old line\nx", 0, "a"), ("2", "", 1, "b"), ("None", "y", 1, "None")]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_lines_of_a_very_long_text_take_linear_time(spark):
    rows = [(1, "the common line\n" + "\n".join(f"line number {i} of one text" for i in range(200_000))), (0, "the common line\nline number 77 of one text")]
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    took = time.perf_counter() - began
    assert (got[1]["n_lines"], got[1]["n_dropped"]) == (200_001, 2)
    assert got[1]["text"] == "\n".join(f"line number {i} of one text" for i in range(200_000) if i != 77)
    assert took < 15  # seconds; each doubling cost almost four times as much before


def test_lines_of_more_documents(spark):
    rows = [(i, "held by four or two\n" + ("held by just two" if i < 2 else "zz")) for i in range(4)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs(spark, rows), min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


# --- suffixes ---


def passages(rng):
    pool = ["".join(rng.choice("abcd éß") for _ in range(rng.randint(30, 120))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(pool), "".join(rng.choice("abcdefgh\n") for _ in range(rng.randint(1, 90)))]) for _ in range(rng.randint(0, 8)))) for i in range(50)]
    return [*rows, (60, rows[3][1]), (61, "a" * 150), (62, "ab" * 90), (63, None), (64, "")]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("length", "hot"), [(20, 4000), (40, 1)])
def test_suffixes(spark, monkeypatch, length, hot, keep_first):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    rows = passages(random.Random(length))
    out = suffix_dedup.remove_repeats(docs(spark, rows).repartition(3), length=length, keep_first=keep_first)
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in out.collect()}
    assert got == plain.suffix_dedup(rows, length, keep_first)


def test_suffixes_of_repeated_rows_and_empty_tables(spark):
    text = "".join(random.Random(0).choices("abcdef", k=300))
    df = docs(spark, [(1, text), (1, text), (None, text)])
    first = suffix_dedup.remove_repeats(df, keep_first=True).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in first) == [("1", 0), ("1", 0), ("None", 300)]
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(df, keep_first=False).collect()] == [300] * 3
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("keep_first", [True, False])
def test_repeated_rows_beside_a_text_that_shares_a_part(spark, keep_first):
    rng = random.Random(2)
    part = lambda n: "".join(rng.choices("abcdef", k=n))
    shared, other = part(400), part(300)
    one, two, three = part(300) + shared + part(300), part(250) + shared + part(250), other + part(50) + shared[100:]
    rows = [(1, one), (2, two), (3, three), (4, part(50) + other)]
    got = suffix_dedup.remove_repeats(docs(spark, [rows[0]] * 5 + [rows[1]] * 3 + rows[2:]).repartition(4), keep_first=keep_first).collect()
    if keep_first:
        assert {(r["doc_id"], bytes(r["kept"])) for r in got} == {(i, kept) for i, (kept, _, _) in plain.suffix_dedup(rows, 200, True).items()}
        assert {r["n_removed"] for r in got if r["doc_id"] == 1} == {0}
    else:
        assert {r["doc_id"]: r["n_removed"] for r in got} == {1: len(one), 2: len(two), 3: 600, 4: 300}


def test_cut_characters_go_from_texts(spark):
    text = "é" * 10 + "".join(random.Random(1).choices("abcdef", k=250))
    df = docs(spark, [(1, text), (2, "é" + text[10:])])
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(df, keep_first=True, as_text=True).collect()}
    assert got[1] == text
    assert got[2] == ""


def random_snippets(rng):
    pool = [bytes(rng.choices(b"ab\0\xff", k=rng.randint(1, 60))) for _ in range(4)]
    return [b"".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))]


@pytest.mark.parametrize("snippets", [[b"a"], [b"aaaa"], [b"abracadabra"], [b"mississippi", b"miss", b"issi"], [b"x" * 3000, b"x" * 2000], *(random_snippets(random.Random(k)) for k in range(30))])
def test_suffix_order_and_longest_previous_factors(snippets):
    """Order, neighbours and factors against their definitions; no suffix reaches into the next snippet."""
    data, ends = b"".join(snippets), [e for s, e in zip(snippets, itertools.accumulate(map(len, snippets)), strict=True) for _ in s]
    suffix = [data[i : ends[i]] for i in range(len(data))]
    found = suffix_dedup.Suffixes(snippets)
    order = sorted(range(len(data)), key=lambda i: (suffix[i], i))
    assert found.order.tolist() == order
    if len(data) > 800:  # the definition takes quadratic time
        return
    before, after, *lengths = (x.tolist() for x in found.longest_previous_factors(np.arange(len(data))))
    place = {p: r for r, p in enumerate(order)}
    common = lambda i, j: len(os.path.commonprefix([suffix[i], suffix[j]]))
    for i in range(len(data)):
        assert before[i] == next((j for j in order[: place[i]][::-1] if j < i), -1)
        assert after[i] == next((j for j in order[place[i] :] if j < i), -1)
        assert max(lengths[0][i], lengths[1][i]) == max((common(i, j) for j in range(i)), default=0)


# --- near copies ---


def edited(rng, words, share):
    return [rng.choice("uvwxyz") * 5 if rng.random() < share else w for w in words]


def family(rng, n, words, share, start):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    return [(start + i, " ".join(edited(rng, base, share) if i else base)) for i in range(n)]


@pytest.mark.parametrize("few", [12, 1])
def test_near_classes(spark, monkeypatch, few):
    monkeypatch.setattr(bag_minhash, "FEW", few)
    monkeypatch.setattr(bag_minhash, "BLOCK", 8)
    rng = random.Random(few)
    rows = family(rng, 25, 120, 0.02, 0) + family(rng, 25, 60, 0.03, 100) + family(rng, 10, 300, 0.2, 200)
    rows += [(300, None), (301, None), (302, ""), (303, ""), (304, "!!"), (305, "one two"), (306, "One, two."), (307, "one three"), (308, " ".join(["la"] * 50)), (309, " ".join(["la"] * 45)), (310, " ".join(["la"] * 30)), (311, rows[0][1])]
    got = bag_minhash.near_classes(docs(spark, rows).repartition(3))
    expected = plain.near_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == expected
    sizes = {c: list(expected.values()).count(c) for c in set(expected.values())}
    for r in got.collect():
        assert r["class_size"] == sizes[r["class_id"]]
        assert r["kept"] == (r["class_id"] == r["doc_id"])


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(bag_minhash, "_node", lambda c: F.length(c).cast("long") % 3)
    rng = random.Random(3)
    rows = family(rng, 6, 60, 0.02, 0) + family(rng, 6, 40, 0.3, 100) + [(200, None), (201, ""), (202, ""), (203, "abc"), (204, "abd"), (205, "abd")]
    got = bag_minhash.near_classes(docs(spark, rows))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == plain.near_classes(rows)


def test_near_classes_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "p q r s t u", "x"), (5, "p q r s t u", "y"), (5, "p q r s t u", "y"), (None, None, None)], "doc_id long, text string, node string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"], str(r["node"])) for r in bag_minhash.near_classes(df).collect())
    assert got == [("5", "5", 3, "y"), ("5", "5", 3, "y"), ("None", "5", 3, "x"), ("None", "None", 1, "None")]
    assert bag_minhash.near_classes(docs(spark, [])).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    error = []
    for _ in range(20):
        n = int(rng.integers(3, 300))
        e = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        a = rng.integers(0, 6, len(e))
        b = np.where(rng.random(len(e)) < 0.7, a, rng.integers(0, 9, len(e)))
        ia, ib = np.flatnonzero(a), np.flatnonzero(b)
        if len(ia) and len(ib):
            s = bag_minhash.signatures(np.repeat([0, 1], [len(ia), len(ib)]), np.concatenate([e[ia], e[ib]]), np.concatenate([a[ia], b[ib]]), 2, 2048)
            error.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.01


def test_signatures_do_not_depend_on_what_else_is_in_a_batch():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "e"], n)).encode() for n in (1, 2, 7, 60, 900, 8000)]
    together = bag_minhash.signatures(*bag_minhash.shingles_of(texts, 5), len(texts), 160)
    for i, t in enumerate(texts):
        assert (bag_minhash.signatures(*bag_minhash.shingles_of([t], 5), 1, 160)[0] == together[i]).all()


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(500, 501 + i) for i in range(30)]
    parent = list(range(600))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in {x for a, b in edges if a != b for x in (a, b)}}


# --- vectors ---

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_links(rows, least=0.98):
    good = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: 0 for k in range(len(rows))}
    parent = {k: k for k in links}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, (k, _, u, lu) in enumerate(good):
        for m, _, v, lv in good[x + 1 :]:
            if lu == lv and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                links[k] += 1
                links[m] += 1
                parent[root(m)] = root(k)
    groups = {}
    for k in links:
        groups.setdefault(root(k), []).append(rows[k][0])
    return sorted((rows[k][0], links[k], min(groups[root(k)])) for k in links)


@pytest.mark.parametrize("shard", [4096, 40])
def test_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "BLOCK", 2)
    monkeypatch.setattr(hnsw.linked, "__defaults__", (shard,))
    rng = np.random.default_rng(shard)
    f32 = lambda v: [float(x) for x in np.float32(v)]
    rows = [(i, f32(rng.normal(size=16)), i % 3) for i in range(150)]
    base = rng.normal(size=16)
    rows += [(200 + i, f32(base + rng.normal(size=16) * 0.1), 1) for i in range(60)]
    rows += [(300, f32(base), 1), (301, f32(base), 1), (302, f32(base), None), (303, None, 1), (304, [0.0] * 16, 1), (305, [float("nan")] * 16, 1), (306, [1.0, 2.0], 1), (307, [1.0, None] * 8, 1), (308, f32(base), 2), (309, [float("inf")] * 16, 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == plain_links(rows)


def test_no_vectors(spark):
    assert hnsw.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert [r["n_links"] for r in hnsw.near_vectors(spark.createDataFrame([(1, None, None)], VECTORS)).collect()] == [0]


def test_recall_in_a_graph_of_loose_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = hnsw.SmallWorld(x).within(x, 0.5)
    truth = int((x @ x.T >= 0.5).sum())
    assert found.recall >= 0.9
    assert len(found.query) >= 0.9 * truth


def rare_links():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[600:630] = x[:30] + rng.normal(size=(30, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    truth = x @ x.T >= 0.98
    np.fill_diagonal(truth, False)
    return x, set(zip(*(k.tolist() for k in np.nonzero(truth)), strict=True))


def pairs_of(found):
    return {(a, b) for a, b in zip(found.query.tolist(), found.node.tolist(), strict=True) if a != b}


def test_rare_links_are_found_by_the_graph(monkeypatch):
    x, truth = rare_links()
    searched = []
    beams = hnsw.SmallWorld._beams
    monkeypatch.setattr(hnsw.SmallWorld, "_beams", lambda self, near, width, least: searched.append((len(near), width)) or beams(self, near, width, least))
    found = hnsw.SmallWorld(x).within(x, 0.98, np.arange(len(x)))
    assert len(truth) >= 60
    assert pairs_of(found) == truth
    assert found.width == hnsw.BEAM
    assert searched == [(1200, hnsw.BEAM)]  # every query in the graph


def test_audits_tell_a_broken_graph(monkeypatch):
    """A graph that finds nothing but each query itself: the audit says so, and beams widen until they see all."""
    x, truth = rare_links()
    monkeypatch.setattr(hnsw, "AUDIT_SHARE", 1)
    monkeypatch.setattr(hnsw.SmallWorld, "_search", lambda self, q, layer, width, at: (np.argmax(q @ self.near.T, axis=1)[:, None].astype(np.int32), np.ones((len(q), 1), np.float32) * 0.5))
    graph = hnsw.SmallWorld.__new__(hnsw.SmallWorld)
    graph.exact, graph.near, graph.beam, graph.top, graph.entry = x, x.astype(np.float32), 48, 0, 0
    found = graph.within(x, 0.98, np.arange(len(x)))
    assert (found.audited, found.first_hit, found.first_recall) == (len(truth), 0, 0.0)
    assert (found.width, found.recall) == (1200, 1.0)
    assert pairs_of(found) == truth


def test_audits_links_are_no_result(monkeypatch):
    x, truth = rare_links()
    monkeypatch.setattr(hnsw.SmallWorld, "_audit", lambda self, queries, *_: (np.arange(0), np.zeros((0, len(self.exact)), bool)))
    found = hnsw.SmallWorld(x).within(x, 0.98, np.arange(len(x)))
    assert pairs_of(found) == truth
    assert found.audited == 0


def test_shards_without_links_keep_narrow_beams():
    rng = np.random.default_rng(6)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(3000, 32)), rng.normal(size=(2500, 32))))
    found = hnsw.SmallWorld(x).within(y, 0.98)
    assert (len(found.query), found.audited, found.recall, found.width) == (0, 0, 1.0, hnsw.BEAM)


def test_dense_groups_are_found_with_narrow_beams(monkeypatch):
    """a beam as wide as a dense group costs the square of its size for each query."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1600, 32))
    x[:500] = x[0] + rng.normal(size=(500, 32)) * 0.03
    x /= np.linalg.norm(x, axis=1)[:, None]
    widths = set()
    search = hnsw.SmallWorld._search
    monkeypatch.setattr(hnsw.SmallWorld, "_search", lambda self, q, layer, width, at: widths.add(width) or search(self, q, layer, width, at))
    found = hnsw.SmallWorld(x).within(x, 0.98, np.arange(len(x)))
    truth = x @ x.T >= 0.98
    np.fill_diagonal(truth, False)
    assert truth.sum() > 200_000
    assert pairs_of(found) == set(zip(*(k.tolist() for k in np.nonzero(truth)), strict=True))
    assert max(widths) == hnsw.BEAM


def test_groups_around_a_centre_lose_no_vector(monkeypatch):
    """All of such a group are closer to its centre than to each other, so some drop out of all lists of edges; then audits widened the beams of all queries."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    x[1:500] = x[0] + rng.normal(size=(499, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.SmallWorld(x)
    reached, open_ = {graph.entry}, [graph.entry]
    while open_:
        new = set(graph.layers[0][open_.pop()].tolist()) - reached - {-1}
        reached |= new
        open_ += new
    assert len(reached) == len(x)
    widths = []
    beams = hnsw.SmallWorld._beams
    monkeypatch.setattr(hnsw.SmallWorld, "_beams", lambda self, near, width, least: widths.append(width) or beams(self, near, width, least))
    found = graph.within(x, 0.98, np.arange(len(x)))
    truth = x @ x.T >= 0.98
    np.fill_diagonal(truth, False)
    assert truth.sum() > 200_000
    assert pairs_of(found) == set(zip(*(k.tolist() for k in np.nonzero(truth)), strict=True))
    assert widths == [hnsw.BEAM]
    assert found.first_hit == found.audited > 0


def test_beams_do_not_widen_beyond_what_all_vectors_cost(monkeypatch):
    """A beam follows many edges for each place of it: one of 3072 in a graph of 8000 takes far longer than all 8000."""
    x = np.tile([1.0, 0.0], (8000, 1))
    widths = []
    none = np.arange(0)
    monkeypatch.setattr(hnsw.SmallWorld, "_beams", lambda self, near, width, least: widths.append(width) or ((none, none) if width < len(x) else (np.zeros(8000, int), np.arange(8000))))
    graph = hnsw.SmallWorld.__new__(hnsw.SmallWorld)
    graph.exact, graph.beam = x, hnsw.BEAM
    found = graph.within(x[:1], 0.98)
    assert widths == [48, 96, 8000]
    assert (found.first_hit, found.hit, found.audited) == (0, 8000, 8000)


def test_recall_of_a_label_of_several_shards(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(900, 24))
    x = np.concatenate([base, base[:450] + rng.normal(size=(450, 24)) * 0.1, rng.normal(size=(450, 24))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, "l", v.tolist(), 1) for i, v in enumerate(x)], "node long, label string, vector array<double>, weight long")
    links = hnsw.linked(nodes, 0.98, 600).cache()
    truth = int((x @ x.T >= 0.98).sum()) - len(x)
    assert links.agg(F.sum("links")).first()[0] >= 0.9 * truth
    recall = hnsw.audited_recall(links).first()
    assert 0 < recall["audited"] < truth
    assert recall["first_recall"] >= 0.9
    assert recall["recall"] == 1
    blocks = links.where("audited > 0 OR links > 0")
    assert blocks.count() > 0


def test_documents_of_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op4_suffix_dedup(spark, sf)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in out.collect()}
    assert got == {i: x[1:] for i, x in plain.suffix_dedup(rows, 200, False).items()}
    assert out.where(F.col("n_removed") > F.col("n_bytes")).count() == 0
