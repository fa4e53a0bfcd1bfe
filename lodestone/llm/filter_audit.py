"""Filter interaction audit: what each of several filters does in every order of all of them.

A document fails a set of filters, which is a mask of bits; of a part (a source, say) only the
counts for each mask are kept, combined on the map side, so a part may hold any share of the
rows. The orders of the filters are then visited by plain changes: each differs from the one
before by one swap of two neighbours, so only these two steps are counted anew from the
mask cells. The sums of what each filter removes over all orders, n! times its Shapley value,
accumulate along the walk. Parts are walked side by side in numpy, a slice of parts at a time.

Defined results: a null or empty text has no words; a null part is the part of the empty
name; a null id comes after all others and has no labels; documents that repeat an id are not
copies of one another, and each row counts; of several labels of an id any good and any toxic
one counts; whether a text repeats another's is decided by two 64-bit hashes; an empty table
has no parts and no rows; columns of the input beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ordered_id, text_or_empty, written

#: Fixed value: what parts words.
SPACE = r"[\x20\x09-\x0D]+"
RESULTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Parts that are walked together.
SLICE = 64
MOST_FILTERS = 8


def text_failures(text_col: str = "text", *, min_words: int = 200, min_distinct_percent: int = 50, max_capital_percent: int = 2, symbols: str = "#$%&*|") -> dict[str, Column]:
    """The failure conditions A to D of one text."""
    text = text_or_empty(text_col)
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < min_words,
        "B": 100 * distinct < min_distinct_percent * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > max_capital_percent * F.char_length(text),
        "D": reduce(or_, [F.contains(text, F.lit(s)) for s in symbols], F.lit(False)),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], *, copies: str, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of the mask; bits follow the names' order."""
    names = sorted([*failures, copies])
    bit = {f: 1 << k for k, f in enumerate(names)}
    text = text_or_empty(text_col)
    mask = sum((F.when(c, F.lit(bit[f])).otherwise(F.lit(0)) for f, c in failures.items()), F.lit(0))
    digests = docs.select(
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), ordered_id(id_col).alias("doc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"), mask.alias("mask")
    )
    digests = written(digests, "failures")  # in the tasks that read the texts
    repeated = digests.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    # under complements, so that Spark deals both sides anew and can split a text that very many documents have
    firsts = repeated.select(F.bitwise_not("h1").alias("n1"), F.bitwise_not("h2").alias("n2"), "first")
    with_firsts = digests.join(firsts, (F.col("h1") == F.bitwise_not("n1")) & (F.col("h2") == F.bitwise_not("n2")), "left")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = with_firsts.join(marks, "doc", "left")
    copy = F.when(F.col("doc") > F.col("first"), F.lit(bit[copies])).otherwise(F.lit(0))
    return marked.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places i: swapping i and i + 1 one after the other visits every order of n things once."""
    if n < 2:
        return
    ahead, at_end = list(range(n - 1)), True
    for inner in chain(adjacent_swaps(n - 1), [None]):
        yield from reversed(ahead) if at_end else ahead
        if inner is not None:
            yield inner + at_end  # the last thing stands in front now, or behind
        at_end = not at_end


def step_counts(cells: np.ndarray, before: int, letter: int) -> np.ndarray:
    """cells: parts x masks x (rows, good, toxic). What a filter does after those of the bits before: parts x COUNTS."""
    masks = np.arange(cells.shape[1])
    fails, earlier = (masks >> letter & 1).astype(bool), (masks & before) != 0
    removed = cells[:, fails & ~earlier].sum(axis=1)
    kept, redundant = cells[:, ~fails & ~earlier, 0].sum(axis=1), cells[:, fails & earlier, 0].sum(axis=1)
    return np.column_stack([kept, removed[:, 0], redundant, removed[:, 1], removed[:, 2]])


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of n filters, the counts of their steps (orders x steps x parts x COUNTS), and what each filter removes over all orders (filters x parts)."""
    order, now, orders, counts = list(range(n)), np.zeros((n, len(cells), len(COUNTS)), np.int64), [], []
    shapley = np.zeros((n, len(cells)), np.int64)

    def count(step: int) -> None:
        now[step] = step_counts(cells, sum(1 << f for f in order[:step]), order[step])

    for step in range(n):
        count(step)
    for swap in chain([None], adjacent_swaps(n)):
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            count(swap)
            count(swap + 1)
        shapley[order] += now[:, :, 1]
        orders.append(tuple(order))
        counts.append(now.copy())
    return orders, np.stack(counts), shapley


def audit_filters(
    docs: DataFrame, labels: DataFrame, *, failures: Mapping[str, Column] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included.

    failures: a condition on a row for each filter's letter; copies: the letter of the filter
    that removes a text which a smaller id has in the whole table, removed or not. The steps
    count documents of the part: kept after the step, removed by it, redundant (they fail its
    filter but went before), unique_fails (they fail its filter only), good_lost and
    toxic_lost (removed here, with that label); shapley is what the filter removes in all
    orders together.
    """
    failures = text_failures(text_col) if failures is None else failures
    names = sorted([*failures, copies])
    if len(set(names)) < len(names) or any(len(f) != 1 for f in names) or len(names) > MOST_FILTERS:
        raise ValueError(f"up to {MOST_FILTERS} filters with letters of their own are needed, not {names}")
    cells = failure_cells(docs, labels, failures, copies=copies, id_col=id_col, text_col=text_col, part_col=part_col)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** filters of a part at most

    def tables(names_of: pa.Array, counted: pa.ListArray) -> Iterator[pa.RecordBatch]:
        n, flat = len(names), counted.flatten()
        table = np.zeros((len(names_of), 1 << n, 3), np.int64)
        row = np.repeat(np.arange(len(names_of)), counted.value_lengths().to_numpy())
        table[row, flat.field("mask").to_numpy()] = np.column_stack([flat.field(c).to_numpy() for c in ("n", "good", "toxic")])
        orders, counts, shapley = walk(table, n)
        letters = np.array(orders)
        shape = (len(names_of), *letters.shape)
        unique = table[:, 1 << np.arange(n), 0]
        out = {c: counts[..., k].transpose(2, 0, 1) for k, c in enumerate(COUNTS)} | {"unique_fails": unique[:, letters], "shapley": shapley.T[:, letters]}
        texts = pa.array(["".join(names[f] for f in order) for order in orders])
        yield pa.RecordBatch.from_pydict(
            {
                "part": names_of.take(pa.array(np.repeat(np.arange(shape[0]), shape[1] * n))),
                "filter_order": texts.take(pa.array(np.tile(np.repeat(np.arange(shape[1]), n), shape[0]))),
                "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), shape[0] * shape[1])),
            }
            | {c: pa.array(np.ascontiguousarray(v).reshape(-1)) for c, v in out.items()}
        ).select(["part", "filter_order", "step", *RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield from tables(part.column(0), part.column(1))

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in RESULTS))

