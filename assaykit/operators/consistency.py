"""Checks across tables: orphans, agreement of matched values, reconciliation of totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalar import NORMAL
from assaykit.sources.relations import checkpointed


def _on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool = False) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) if null_safe else left[x] == right[y] for x, y in pairs])


def orphans(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """Rows of child without a parent; a NULL key has none."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(child_keys)])
    return child.join(keys, on, "left_anti")


def orphan(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str], null_key: str = "fail") -> DataFrame:
    """rows_scanned and violation_count; ``null_key`` 'fail' counts rows with a NULL key part, 'ignore' leaves them out."""
    if null_key not in ("fail", "ignore"):
        raise ValueError(null_key)
    if null_key == "ignore":
        child = child.dropna(subset=list(child_keys))
    bad = orphans(child, child_keys, parent, parent_keys).agg(F.count("*").alias("violation_count"))
    return child.agg(F.count("*").alias("rows_scanned")).crossJoin(bad)  # one row each


@dataclass(frozen=True)
class Hop:
    """An inner join from the rows so far to ``table`` on pairs of columns."""

    table: DataFrame
    on: tuple[tuple[str, str], ...]


def matched(left: DataFrame, hops: Sequence[Hop]) -> DataFrame:
    out = left
    for hop in hops:
        out = out.join(hop.table, _on(out, hop.table, hop.on))
    return out


def differs(left: Column, right: Column, compare: str = "exact", tolerance: float | None = None) -> Column:
    """Null-safe: true where the normalised values differ, one side empty included."""
    l, r = NORMAL[compare](left), NORMAL[compare](right)
    if compare == "number" and tolerance is not None:
        return F.coalesce(F.abs(l - r) > F.lit(tolerance), ~l.eqNullSafe(r))
    return ~l.eqNullSafe(r)


def agreement(pairs: DataFrame, left: Column, right: Column, compare: str = "exact", empty_one_side: str = "fail", tolerance: float | None = None) -> DataFrame:
    """Over matched rows; ``empty_one_side`` 'skip' scopes out rows of which one side alone is empty."""
    normal = NORMAL[compare]
    inside = F.lit(True) if empty_one_side == "fail" else normal(left).isNull() == normal(right).isNull()
    return pairs.agg(F.count_if(inside).alias("rows_scanned"), F.count_if(inside & differs(left, right, compare, tolerance)).alias("violation_count"))


def mismatches(pairs: DataFrame, left: Column, right: Column, compare: str = "exact") -> DataFrame:
    """The failing pairs with both values, the reason, and where they part after a shared beginning of three characters or more."""
    l, r = NORMAL[compare](left), NORMAL[compare](right)
    a, b = left.cast("string"), right.cast("string")
    short = F.least(F.length(a), F.length(b))
    # how far beginnings are equal, by halving: the next 2**k characters are taken if they are the same on both sides; of 31 steps few compare much
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    same = F.aggregate(powers, F.lit(0), lambda n, k: F.when((k <= short - n) & (F.substring(a, n + 1, k) == F.substring(b, n + 1, k)), n + k).otherwise(n))
    rest = lambda c: F.when(F.col("shared") >= 3, c.substr(F.col("shared") + 1, F.length(c))).otherwise(c)
    reason = F.when(l.isNull() != r.isNull(), "One side empty").otherwise("Different")
    found = pairs.where(differs(left, right, compare)).withColumns({"left_value": a, "right_value": b, "reason": reason, "shared": F.coalesce(same, F.lit(0))})
    return found.withColumns({"left_rest": rest(F.col("left_value")), "right_rest": rest(F.col("right_value"))})


AGGREGATES = {"count": lambda c: F.count(F.lit(1)), "count_distinct": F.countDistinct, "sum": F.sum}


def reconcile(left: DataFrame, left_value: tuple[str, str | None], right: DataFrame, right_value: tuple[str, str | None], on: Sequence[tuple[str, str]] = (), absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """Groups: k0.., left_value, right_value, violates. A group on one side alone violates; else the difference must be within the larger allowance."""
    l = left.groupBy(*[F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(on)]).agg(AGGREGATES[left_value[0]](left_value[1]).alias("left_value"), F.lit(True).alias("_l"))
    r = right.groupBy(*[F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(on)]).agg(AGGREGATES[right_value[0]](right_value[1]).alias("right_value"), F.lit(True).alias("_r"))
    keys = [f"k{i}" for i in range(len(on))]
    if not keys:
        both = l.crossJoin(r)  # one row each
    else:
        both = l.join(r, _on(l, r, [(k, k) for k in keys], null_safe=True), "full_outer").select(*[F.coalesce(l[k], r[k]).alias(k) for k in keys], "left_value", "right_value", "_l", "_r")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    allowed = F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * F.abs(F.col("right_value")))
    one_side = F.col("_l").isNull() | F.col("_r").isNull()
    return both.withColumn("violates", one_side | F.coalesce(gap > allowed, ~F.col("left_value").eqNullSafe(F.col("right_value")))).drop("_l", "_r")


def join_test(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """rows, matched, match_pct of the driving side, and how many parent keys occur more than once."""
    keys = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_key")).agg(F.count("*").alias("_n"))
    rows = left.join(keys, F.col(left_key) == F.col("_key"), "left").agg(F.count("*").alias("rows"), F.count("_n").alias("matched"))
    repeated = keys.agg(F.count_if(F.col("_n") > 1).alias("repeated_keys"))
    return rows.crossJoin(repeated).withColumn("match_pct", F.when(F.col("rows") > 0, F.round(F.col("matched").cast("double") * 100.0 / F.col("rows"), 4)))


def hop_tests(left: DataFrame, hops: Sequence[Hop]) -> DataFrame:
    """C8 over several hops: hop, rows and matched (distinct keys of the far side), match_pct and fanout (far keys that occur more than once) of each; each hop starts from the rows that matched before."""
    out, now = None, left
    for number, hop in enumerate(hops):
        far = [b for _, b in hop.on]
        keys = hop.table.where(reduce(lambda x, y: x & y, [F.col(b).isNotNull() for b in far])).groupBy(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(far)]).agg(F.count("*").alias("_n"))
        met = now.join(keys, reduce(lambda x, y: x & y, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(hop.on)]), "left")
        one = met.agg(F.count("*").alias("rows"), F.count("_n").alias("matched")).crossJoin(keys.agg(F.count_if(F.col("_n") > 1).alias("fanout")))  # one row each
        one = one.select(F.lit(number).alias("hop"), "rows", "matched", F.when(F.col("rows") > 0, F.col("matched") * 100.0 / F.col("rows")).alias("match_pct"), "fanout")
        out = one if out is None else out.unionByName(one)
        now = now.join(hop.table, _on(now, hop.table, hop.on))
    return out


def hop_summary(tests: DataFrame) -> DataFrame:
    """The least match rate of all hops, and their fanouts together."""
    return tests.agg(F.round(F.min("match_pct"), 1).alias("match_pct"), F.sum("fanout").alias("fanout"))


def join_type_check(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str, bool]]:
    """(left column, right column, their types, equal?)."""
    out = []
    for a, b in pairs:
        x, y = left.schema[a].dataType.simpleString(), right.schema[b].dataType.simpleString()
        out.append((a, b, x, y, x == y))
    return out


#: Buckets of the levels of ``differing``'s tree.
LEVELS = (1 << 10, 1 << 16)


def _digested(df: DataFrame, keys: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """df with hashes of its key (_place) and of each whole row (_h1 to _h3). That a value is NULL is hashed too, else it could change its column."""
    cells = [x for c in (*keys, *shared) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    place = [x for c in keys for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return df.withColumns({"_place": F.xxhash64(*place), "_h1": F.xxhash64(F.lit(1), *cells), "_h2": F.xxhash64(F.lit(2), *cells), "_h3": F.hash(F.lit(3), *cells).cast("long")})


def differing(left: DataFrame, right: DataFrame, keys: Sequence[str], shared: Sequence[str], levels: Sequence[int] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in key buckets whose contents differ: all that a comparison needs.

    A hash tree: each level sums rows up to a digest for each bucket (two xors of 64 bits, a sum, a count, all made map-side), compares the sides bucket by bucket, and only what is in
    a bucket that differs goes on to the next, finer level. What is broadcast is a list of at most a level's buckets. Equal tables are never joined.
    """
    sides = [_digested(left, keys, shared), _digested(right, keys, shared)]
    for width in levels:
        sums = [side.groupBy(F.pmod("_place", F.lit(width)).alias("_b")).agg(F.bit_xor("_h1").alias("x"), F.bit_xor("_h2").alias("y"), F.sum("_h3").alias("s"), F.count("*").alias("n")) for side in sides]
        both = sums[0].alias("l").join(sums[1].alias("r"), "_b", "full_outer")
        equal = F.lit(True)
        for c in "xysn":
            equal = equal & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        odd = checkpointed(both.where(~equal).select("_b"))
        sides = [side.join(F.broadcast(odd), F.pmod("_place", F.lit(width)) == F.col("_b"), "left_semi") for side in sides]
    return tuple(side.drop("_place", "_h1", "_h2", "_h3") for side in sides)


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], ignore: Sequence[str] = (), rewrite: Mapping[str, tuple[str, str]] | None = None, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Item, n: rows on one side alone and, for each shared column, keys whose values differ; columns on one side alone count as -1.

    rewrite: name -> (pattern, replacement) for strings of both sides before they are compared. For each of them, rewritten_<name> counts the columns that are
    equal with it in force and whose right side it changed.
    """
    rules = dict(rewrite or {})
    shared = [c for c in left.columns if c in right.columns and c not in keys and c not in ignore]
    strings = [c for c in shared if left.schema[c].dataType.simpleString() == right.schema[c].dataType.simpleString() == "string"]

    def canonical(df: DataFrame) -> DataFrame:
        cells = {}
        for c in strings:
            out = F.col(f"`{c}`")
            for pattern, new in rules.values():
                out = F.regexp_replace(out, pattern, new)
            cells[c] = out
        return df.select(*[F.col(f"`{c}`") for c in (*keys, *shared)]).withColumns(cells) if rules else df.select(*[F.col(f"`{c}`") for c in (*keys, *shared)])

    l, r = differing(canonical(left), canonical(right), keys, shared, levels)
    l, r = l.withColumn("_l", F.lit(True)), r.withColumn("_r", F.lit(True))
    both = l.join(r, _on(l, r, [(k, k) for k in keys], null_safe=True), "full_outer")
    paired = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    counts = [F.count_if(F.col("_r").isNull()).alias("rows_left_only"), F.count_if(F.col("_l").isNull()).alias("rows_right_only")]
    counts += [F.count_if(paired & ~l[c].eqNullSafe(r[c])).alias(f"column_{c}") for c in shared]
    wide = both.agg(*counts)
    alone = [(f"{side}_only_column_{c}", -1) for side, a, b in (("left", left, right), ("right", right, left)) for c in a.columns if c not in b.columns and c not in ignore]
    cells = [F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").alias("n")) for c in wide.columns] + [F.struct(F.lit(c).alias("item"), F.lit(n).cast("long").alias("n")) for c, n in alone]
    if rules:
        touched = right.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`") != F.regexp_replace(F.col(f"`{c}`"), *pair)), F.lit(False)).alias(f"_{name}_{c}") for name, pair in rules.items() for c in strings])
        wide = wide.crossJoin(touched)  # one row each
        for name in rules:
            held = [F.when((F.col(f"column_{c}") == 0) & F.col(f"_{name}_{c}"), 1).otherwise(0) for c in strings]
            cells.append(F.struct(F.lit(f"rewritten_{name}").alias("item"), reduce(lambda a, b: a + b, held, F.lit(0)).cast("long").alias("n")))
    return wide.select(F.inline(F.array(*cells)))
