"""Entities from the names of reference files.

Equal names are one node. Different ones may share an identity: a run of two words or more,
or one word if either name is just that word. Candidates are counted, not found by pairs: all
runs that several names have, and all words that are a name of their own. Two names share the
first of their longest common runs only, which matters where a name has several longest ones;
for those alone names are compared, and then by what of them other names have too: names that
differ only in words of their own are one form, so a run in very many of them makes no pairs.
What stays ambiguous is an error, not a guess.

references: path, stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import casefold, identifier, identity_key, longest_common_run, tokens
from lodestone.storage import written


#: Names that an error tells.
MOST_TOLD = 1000


class AmbiguousNames(ValueError):
    """Names that could belong to several entities; names has them."""

    def __init__(self, kind: str, names: list[str]) -> None:
        super().__init__(f"{kind}: {', '.join(names)}")
        self.kind, self.names = kind, names


#: Stand for words that no other name has, in the first and in the second of two names. Keys are case-folded, so neither is a word of one.
GAP, OTHER_GAP = "GAP", "OTHER"


def named(references: DataFrame) -> DataFrame:
    """path, display and key of each file."""
    return references.select("path", identifier(F.col("stem")).alias("display")).withColumn("key", identity_key(F.col("display")))


def nodes_of(files: DataFrame) -> DataFrame:
    """files: named. key, display (of the first path), cf (its order) and words of each different name."""
    grouped = files.groupBy("key").agg(F.min_by("display", F.struct(F.lower("path"), "path")).alias("display"))
    return grouped.withColumns({"cf": casefold(F.col("display")), "words": tokens(F.col("key"))})


def runs_of(words: Column, longest: Column) -> Column:
    """The different runs of two words up to longest; there must be two words."""
    n = F.size(words)
    at = lambda i: F.transform(F.sequence(F.lit(2), F.least(longest, n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), at)))


def holders(nodes: DataFrame) -> DataFrame:
    """candidate, key: the runs of each name, and of its words those that are another's whole name."""
    long = nodes.where(F.size("words") > 1)
    whole = nodes.where(F.size("words") == 1).select(F.col("key").alias("candidate"), "key")
    runs = long.select(F.explode(runs_of(F.col("words"), F.size("words"))).alias("candidate"), "key")
    words = long.select(F.explode(F.array_distinct("words")).alias("candidate"), "key").join(whole.select("candidate"), "candidate", "left_semi")
    return runs.unionByName(whole).unionByName(words)


def forms(nodes: DataFrame) -> DataFrame:
    """key, cf and form: the words of each name, with gaps for those outside all pairs of neighbours that another name has too."""
    long = nodes.where(F.size("words") > 1)
    twos = long.select("key", F.explode(runs_of(F.col("words"), F.lit(2))).alias("two"))
    common = twos.groupBy("two").agg(F.count("*").alias("names")).where("names > 1").select("two")
    shared = twos.join(common, "two", "left_semi").groupBy("key").agg(F.collect_set("two").alias("twos"))  # of one name's
    joined = lambda i: F.array_contains("twos", F.array_join(F.slice("words", i, 2), " "))
    kept = lambda w, i: F.when((i > 0) & joined(F.greatest(i, F.lit(1))), F.array(w)).when(joined(i + 1), F.array(F.lit(GAP), w)).otherwise(F.slice(F.array(w), 1, 0))
    return long.join(shared, "key").select("key", "cf", F.flatten(F.transform("words", kept)).alias("form"))


def shared_by_two(nodes: DataFrame, held: DataFrame) -> DataFrame:
    """held: candidate, key of runs in doubt. candidate and first: those that are the first longest run of two names, and the first name that has it so."""
    place = F.struct("cf", "key")
    groups = written(held.join(forms(nodes), "key").groupBy("candidate", "form").agg(F.min(place).alias("low"), F.max(place).alias("high")), "forms", narrow=True)
    other = groups.select("candidate", F.transform("form", lambda w: F.when(w == GAP, OTHER_GAP).otherwise(w)).alias("other"), F.col("high").alias("end"))
    run = longest_common_run(F.col("form"), F.col("other"))
    two = groups.join(other, "candidate").where("low < end").withColumn("run", run)
    first = two.where(F.array_join(F.slice("form", -F.col("run.neg_start"), F.col("run.len")), " ") == F.col("candidate"))
    return first.groupBy("candidate").agg(F.min("low").getField("key").alias("first"))


def memberships(nodes: DataFrame) -> DataFrame:
    """candidate, shown, size (in words), key, members: for each name its longest candidates and those of one word. members tells how many names hold a candidate.

    A run that is no name's longest decides nothing. One that is a name's only longest is what
    that name shares with any other holder; only where there are several, pairs tell which
    of them are shared.
    """
    held = holders(nodes)
    known = written(held.groupBy("candidate").agg(F.count("*").alias("members")).where("members > 1"), "candidates", narrow=True)
    sized = held.join(known, "candidate").withColumn("size", F.size(tokens(F.col("candidate"))))
    held = written(sized, "holders", narrow=True)
    most = held.groupBy("key").agg(F.max("size").alias("longest"), F.max(F.struct("size", "candidate")).alias("last"), F.min(F.struct(-F.col("size"), F.col("candidate"))).alias("first"))
    doubted = most.where((F.col("longest") > 1) & (F.col("last.candidate") != F.col("first.candidate"))).select("key", "longest")
    doubt = written(held.join(doubted, "key").where("size = longest").select("candidate").distinct(), "doubtful", narrow=True)
    in_doubt = not doubt.isEmpty()
    sure = held.join(doubt, "candidate", "left_anti") if in_doubt else held
    top = sure.join(most.select("key", "longest"), "key").where("size = 1 OR size = longest").drop("longest")
    firsts = sure.join(nodes.select("key", "cf"), "key").groupBy("candidate").agg(F.min(F.struct("cf", "key")).getField("key").alias("first"))
    if in_doubt:
        doubtful = held.join(doubt, "candidate", "left_semi")
        top = top.unionByName(doubtful)
        firsts = firsts.unionByName(shared_by_two(nodes, doubtful.select("candidate", "key")))
    n = F.size(tokens(F.col("candidate")))
    start = F.get(F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_join(F.slice("words", i, n), " ") == F.col("candidate")), 0)
    names = nodes.select(F.col("key").alias("first"), "words", "display")
    shown = firsts.join(names, "first").select("candidate", F.array_join(F.slice(tokens(F.col("display")), start, n), " ").alias("shown"))
    return top.join(shown, "candidate").select("candidate", "shown", "size", "key", "members")


def resolution(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, problems). groups: entity_id, path. problems: kind, name - empty if the groups hold."""
    files = written(named(references), "files")
    nodes = written(nodes_of(files), "names", narrow=True)  # all that follows reads them again and again
    members = written(memberships(nodes), "members", narrow=True)
    short = (F.col("size") == 1) & (F.col("members") > 2)
    displays = nodes.select("key", "display")
    too_short = members.where(short).join(displays, "key").select(F.lit("short").alias("kind"), F.col("display").alias("name"))
    rest = members.where(~short)
    longest = rest.withColumn("longest", F.max("size").over(Window.partitionBy("key"))).where("size = longest")
    choices = longest.withColumn("choices", F.count("*").over(Window.partitionBy("key")))
    several = choices.where("choices > 1").select("key").distinct().join(displays, "key").select(F.lit("several").alias("kind"), F.col("display").alias("name"))
    chosen = choices.where("choices = 1").withColumn("chosen", F.count("*").over(Window.partitionBy("candidate"))).where("chosen = members")
    entities = nodes.join(chosen.select("key", "shown"), "key", "left").select("key", F.coalesce("shown", "display").alias("entity_id"))
    return files.join(entities, "key").select("entity_id", "path"), too_short.unionByName(several).distinct()


def group_references(references: DataFrame) -> DataFrame:
    """entity_id, path; raises AmbiguousNames, for short identities before equally long ones, and ValueError for a file without a name."""
    blank = references.where(F.coalesce(identifier(F.col("stem")), F.lit("")) == "").select("path").limit(1).collect()
    if blank:
        raise ValueError(f"no name in {blank[0]['path']}")
    groups, problems = resolution(references)
    problems = written(problems, "ambiguous-names", narrow=True)
    for kind in ("short", "several"):
        # names that the user must change; the error tells the first of them
        if names := [r["name"] for r in problems.where(F.col("kind") == kind).select("name", casefold(F.col("name")).alias("cf")).sort("cf", "name").limit(MOST_TOLD).collect()]:
            raise AmbiguousNames(kind, names)
    return groups
