import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import identifier, identity_key, longest_common_run, tokens
from lodestone.operators.identity import AmbiguousNames, group_references, named, nodes_of, resolution, shared_by_two


def groups(spark, stems):
    refs = spark.createDataFrame([(f"d/{i:02d} {s}.jpg", s) for i, s in enumerate(stems)], "path string, stem string")
    out: dict[str, set[str]] = {}
    for r in group_references(refs).join(refs, "path").collect():
        out.setdefault(r["entity_id"], set()).add(r["stem"])
    return out


@pytest.mark.parametrize(
    ("stems", "entities"),
    [
        (["712 Kot Nik", "709 Kot Nik"], {"Kot Nik"}),
        (["A Kot Nik", "B Kot Nik"], {"Kot Nik"}),
        (["Kot", "Kot Nik"], {"Kot"}),
        (["Kot Nik portrait", "Kot Nik street", "Kot Nik standing"], {"Kot Nik"}),
        (["Kot Nik", "Kot Ser"], {"Kot Nik", "Kot Ser"}),
        (["712 A Kot"], {"A Kot"}),
        (["712"], {"712"}),
    ],
)
def test_truth_table(spark, stems, entities):
    found = groups(spark, stems)
    assert set(found) == entities
    assert set().union(*found.values()) == set(stems)


def test_one_word_of_three_names_is_an_error(spark):
    with pytest.raises(AmbiguousNames) as e:
        groups(spark, ["Kot", "Kot Nik", "Kot Ser"])
    assert e.value.kind == "short"
    assert e.value.names == ["Kot", "Kot Nik", "Kot Ser"]


def test_two_equally_long_identities_are_an_error(spark):
    with pytest.raises(AmbiguousNames) as e:
        groups(spark, ["Kot Nik Lev Ros", "Kot Nik x", "Lev Ros y"])
    assert e.value.kind == "several"


def test_a_wide_identity_does_not_swallow_a_closer_one(spark):
    found = groups(spark, ["Kot Nik", "Kot Nik Lev", "Kot Nik Lev x"])
    assert found == {"Kot Nik": {"Kot Nik"}, "Kot Nik Lev": {"Kot Nik Lev", "Kot Nik Lev x"}}


def test_a_file_without_a_name_is_an_error(spark):
    with pytest.raises(ValueError, match="no name"):
        groups(spark, ["  "])


def test_no_references(spark):
    refs = spark.createDataFrame([], "path string, stem string")
    assert group_references(refs).collect() == []


def test_names(spark):
    df = spark.createDataFrame([("ﬁn Ёж",), ("12  X  Straße",), ("Q ",), (None,)], "s string")
    got = df.select(identifier(F.col("s")).alias("d"), identity_key(identifier(F.col("s"))).alias("k")).collect()
    assert [tuple(r) for r in got] == [("fin Ёж", "fin еж"), ("X Straße", "x strasse"), ("Q", "q"), (None, None)]


def test_longest_run_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a b c d", "c d a b"), ("x", "y"), ("", "y")], "a string, b string")
    got = df.select(longest_common_run(tokens(F.col("a")), tokens(F.col("b"))).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in got] == [(2, -1), None, None]


#: Stems of reference files and the entity that each belongs to.
NAMED = [
    ("a/712 Kot Nik.jpg", "712 Kot Nik", "Kot Nik"),
    ("b/709 Kot Nik.jpg", "709 Kot Nik", "Kot Nik"),
    ("a/A Ber Tom.jpg", "A Ber Tom", "Ber Tom"),
    ("a/B Ber Tom.jpg", "B Ber Tom", "Ber Tom"),
    ("a/Lis.jpg", "Lis", "Lis"),
    ("a/Lis Ann.jpg", "Lis Ann", "Lis"),
    ("a/Volk Ian portrait.jpg", "Volk Ian portrait", "Volk Ian"),
    ("a/Volk Ian standing.jpg", "Volk Ian standing", "Volk Ian"),
    ("a/Volk Ian street.jpg", "Volk Ian street", "Volk Ian"),
    ("a/Lev Ros.jpg", "Lev Ros", "Lev Ros"),
    ("a/Lev Max.jpg", "Lev Max", "Lev Max"),
    ("a/712 A Sova.jpg", "712 A Sova", "A Sova"),
    ("a/713.jpg", "713", "713"),
    ("a/Пётр Ёж.jpg", "Пётр Ёж", "Пётр Ёж"),
    ("b/12 петр еж.jpg", "12 петр еж", "Пётр Ёж"),
]


def test_groups_of_known_names(spark):
    refs = spark.createDataFrame([(p, s) for p, s, _ in NAMED], "path string, stem string")
    assert {r["path"]: r["entity_id"] for r in group_references(refs).collect()} == {p: e for p, _, e in NAMED}


def plain_resolution(names):
    """Entity of each name and the names in doubt, by comparing all pairs. names: different, as words of lower case."""
    words = {n: n.split(" ") for n in names}
    holds = lambda n, run: f" {run} " in f" {n} "
    candidates = set()
    order = sorted(names)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            w = words[a]
            runs = [(k, -s, " ".join(w[s : s + k])) for s in range(len(w)) for k in range(1, len(w) - s + 1)]
            common = [r for r in runs if holds(b, r[2])]
            if common and (max(common)[0] > 1 or 1 in (len(w), len(words[b]))):
                candidates.add(max(common, key=lambda r: r[:2])[2])
    members = {c: {n for n in names if holds(n, c)} for c in candidates}
    short = {c for c, m in members.items() if " " not in c and len(m) > 2}
    doubt = set().union(*(members[c] for c in short))
    choice = {}
    for n in names:
        own = [c for c in members if c not in short and n in members[c]]
        longest = [c for c in own if len(c.split(" ")) == max(len(x.split(" ")) for x in own)]
        if len(longest) > 1:
            doubt.add(n)
        elif longest:
            choice[n] = longest[0]
    return {n: choice[n] if n in choice and all(choice.get(m) == choice[n] for m in members[choice[n]]) else n for n in names}, doubt


def test_candidates_by_counting_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    wanted, doubted, rows = {}, set(), []
    for trial in range(150):
        pool = [f"t{trial}{c}" for c in "abcdefgh"[: rng.choice([3, 5, 8])]]
        names = {" ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 4, 6]))) for _ in range(rng.choice([2, 4, 7]))}
        entities, doubt = plain_resolution(names)
        wanted.update(entities)
        doubted |= doubt
        rows += [(f"{n}.jpg", n) for n in names]
    groups, problems = resolution(spark.createDataFrame(rows, "path string, stem string"))
    assert {r["path"][:-4]: r["entity_id"] for r in groups.collect()} == wanted
    assert {r["name"] for r in problems.collect()} == doubted


def test_one_run_in_very_many_names_makes_no_pairs(spark):
    many = 200_000
    names = spark.range(many).select(F.concat(F.lit("d/"), "id").alias("path"), F.concat(F.lit("Kot Nik x"), "id").alias("stem"))
    twice = spark.range(many).select(F.concat(F.lit("e/"), "id").alias("path"), F.concat(F.lit("Lev Ros Max Ian y"), "id", F.lit(" Lis Ann Ber Tom")).alias("stem"))
    nodes = nodes_of(named(twice))
    held = nodes.select(F.lit("lev ros max ian").alias("candidate"), "key").unionByName(nodes.select(F.lit("lis ann ber tom").alias("candidate"), "key"))
    assert [(r["candidate"], r["first"]) for r in shared_by_two(nodes, held).collect()] == [("lev ros max ian", "lev ros max ian y0 lis ann ber tom")]
    found = group_references(names).groupBy("entity_id").count().collect()
    assert [tuple(r) for r in found] == [("Kot Nik", many)]
