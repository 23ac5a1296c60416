"""Line-item matching (greedy, one-to-one) within a row."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MONEY_TOLERANCE
from .text import plain_numbers, score_number

FEW_PAIRS = 256  # up to so many pairs of items a plain fold is cheapest; the results are the same


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a lambda's own variable is not computed again for each use."""
    return F.transform(F.array(value), body)[0]


def _items(items: Column, side: int, quantity: Callable[[Column], Column], amount: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x, i: F.struct(quantity(x).alias("q"), amount(x).alias("a"), F.lit(side).alias("side"), i.alias("i")))


def _comparable(truth_items: Column, pred_items: Column) -> tuple[Column, Column]:
    """Both lists with quantity and amount as numbers (predictions parsed once); what lacks one matches nothing."""
    def known(items: Column) -> Column:
        return F.filter(items, lambda x: x["q"].isNotNull() & x["a"].isNotNull())
    t = _items(F.coalesce(truth_items, F.array()), 0, lambda x: x["quantity"] + F.lit(0.0), lambda x: x["amount"])
    p = _items(F.coalesce(pred_items, F.array()), 1, lambda x: score_number(x["quantity"]) + F.lit(0.0), lambda x: score_number(x["amount"]))
    return known(t), known(p)


def _fold(truth: Column, pred: Column) -> Column:
    """In truth order, each takes the first remaining prediction that fits; a matched one is used up."""
    def fits(t: Column) -> Callable[[Column], Column]:
        return lambda p: (F.abs(p["a"] - t["a"]) < MONEY_TOLERANCE) & (p["q"] == t["q"])

    def step(acc: Column, t: Column) -> Column:
        return let(F.array_position(F.transform(acc["rem"], fits(t)), True), lambda pos: F.when(
            pos > 0, F.struct((acc["m"] + 1).alias("m"), F.filter(acc["rem"], lambda x, i: i != pos - 1).alias("rem"))).otherwise(acc))

    return F.aggregate(truth, F.struct(F.lit(0).alias("m"), pred.alias("rem")), step, lambda acc: acc["m"])


def _fold_rest(truth: Column, pred: Column) -> Column:
    """The fold's result where the lists begin alike: while each truth fits the prediction at its own place, that one is the
    first that remains, so the fold takes just these pairs, and only the rest of both lists is folded."""
    n = F.least(F.size(truth), F.size(pred))
    alike = F.array_position(F.zip_with(truth, pred, lambda t, p: (F.abs(p["a"] - t["a"]) < MONEY_TOLERANCE) & (p["q"] == t["q"])), False)
    return let(alike, lambda at: F.when(at == 0, n).otherwise(
        (at - 1).cast("int") + _fold(*[F.slice(items, at.cast("int"), F.size(items)) for items in (truth, pred)])))


def _sweep(truth: Column, pred: Column) -> Column:
    """The fold's result from sorted lists. Sorted by quantity and amount, items fall into islands: equal quantity and
    steps below the tolerance. Items of different islands cannot match, so the fold is done for each island
    alone; where all amounts of an island lie within the tolerance, everything in it matches and counts
    decide. n log n, but for islands that are long chains of amounts a cent apart."""
    def island(items: Column) -> Column:
        def by_side(side: int) -> Column:
            return F.array_sort(F.transform(F.filter(items, lambda x: x["side"] == side), lambda x: F.struct(x["i"].alias("i"), x["q"].alias("q"), x["a"].alias("a"))))
        span = F.element_at(items, -1)["a"] - items[0]["a"]
        return let(by_side(0), lambda t: let(by_side(1), lambda p: F.when((F.size(t) == 0) | (F.size(p) == 0), F.lit(0))
                                             .when(span < MONEY_TOLERANCE, F.least(F.size(t), F.size(p))).otherwise(_fold(t, p))))

    def swept(items: Column) -> Column:
        def begins(x: Column, i: Column) -> Column:
            before = F.get(items, i - 1)
            return F.when((i == 0) | (before["q"] != x["q"]) | (x["a"] - before["a"] >= MONEY_TOLERANCE), i)
        starts = F.filter(F.transform(items, begins), lambda i: i.isNotNull())
        return let(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).alias("j"), F.lit(0).alias("m")), lambda acc, at: F.struct(
            (acc["j"] + 1).alias("j"), (acc["m"] + let(F.slice(items, at + 1, F.coalesce(F.get(s, acc["j"] + 1), F.size(items)) - at), island)).alias("m")),
            lambda acc: acc["m"]))

    return let(F.array_sort(F.concat(truth, pred)), swept)


def _all_alike(truth_items: Column, pred_items: Column) -> Column:
    """Both lists have as many items and each true item fits the prediction at its own place: then the fold takes just these
    pairs. Seen from the lists as they are, without the lists of numbers that the fold needs."""
    def fits(p: Column, i: Column) -> Column:
        t = F.get(truth_items, i)
        return F.coalesce((score_number(p["quantity"]) + F.lit(0.0) == t["quantity"] + F.lit(0.0))
                          & (F.abs(score_number(p["amount"]) - t["amount"]) < MONEY_TOLERANCE), F.lit(False))
    return (F.size(truth_items) == F.size(pred_items)) & ~F.array_contains(F.transform(pred_items, fits), False)


def _equal_items(truth_items: Column, pred_items: Column) -> Column:
    """Both lists hold the same numbers, plainly written, either place by place or, if no quantity comes twice, in any order:
    then each true item meets its like and all are matched. Lists of columns are compared, which Spark compiles, no lambdas."""
    plain, (q, a) = plain_numbers(pred_items["quantity"], pred_items["amount"])
    t_q, t_a = truth_items["quantity"], truth_items["amount"]
    known = [~F.array_contains(c, F.lit(float("nan"))) for c in (t_q, t_a)]

    def in_order(*columns: Column) -> Column:
        return F.sort_array(F.arrays_zip(*columns).cast("array<struct<q:double,a:double>>"))
    same = ((t_q == q) & (t_a == a)) | ((F.size(F.array_distinct(q)) == F.size(q)) & (in_order(t_q, t_a) == in_order(q, a)))
    return (F.size(truth_items) == F.size(pred_items)) & plain & reduce(and_, known) & same


def matched_items(truth_items: Column, pred_items: Column) -> Column:
    """Number of true items matched, in truth order, each to the first remaining predicted item
    with the same quantity and an amount within the money tolerance; a matched item is used up."""
    t, p = _comparable(truth_items, pred_items)
    none = F.coalesce(F.size(pred_items), F.lit(0)) == 0
    alike = _equal_items(truth_items, pred_items) | _all_alike(truth_items, pred_items)
    return F.when(none, F.lit(0)).when(alike, F.size(truth_items)).otherwise(let(t, lambda t: let(p, lambda p: F.when(F.size(t) * F.size(p) <= FEW_PAIRS, _fold_rest(t, p)).otherwise(_sweep(t, p)))))


def line_items_score(truth_items: Column, pred_items: Column) -> Column:
    """matched / max(#truth, #pred); with no true items: 1.0 when nothing was predicted, else 0.0."""
    n_t = F.coalesce(F.size(truth_items), F.lit(0))
    n_p = F.coalesce(F.size(pred_items), F.lit(0))
    return F.when(n_t == 0, F.when(n_p == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
        .otherwise(matched_items(truth_items, pred_items).cast("double") / F.greatest(n_t, n_p))
