"""Time-ordered target encoding: how often earlier lines of other folds, alike in a column, had the flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import shuffle_parts, table, written

#: Folds of the contract, prior of all history and weight of a prior, in millionths and rows.
FOLDS, PRIOR, WEIGHT = 5, 500_000, 50
#: Time chunks (and at most as many hot keys) for every partition of a shuffle.
CHUNKS = 4


def fold_of(name: str, folds: int) -> Column:
    """Unsigned crc32 of the id's decimal digits, modulo ``folds``."""
    return (F.crc32(F.col(name).cast("string").cast("binary")) % folds).cast("int")


def micros(time: Column) -> Column:
    """A time without a zone as microseconds since 1970, whatever the session's zone."""
    seconds = F.unix_date(F.to_date(time)) * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def time_bounds(df: DataFrame, time: str, chunks: int) -> Column | None:
    """``chunks - 1`` ascending times that cut the rows into about equal parts, as an array literal; None without rows. Only these reach the driver."""
    found = df.agg(F.percentile_approx(time, [i / chunks for i in range(1, chunks)], 20 * chunks)).first()[0]
    return F.array(*[F.lit(x).cast("long") for x in sorted(set(found))]) if found else None


def chunk_of(time: Column, bounds: Column, chunks: int) -> Column:
    """How many of the bounds are not after ``time``, by halving."""
    steps = [1 << i for i in reversed(range(chunks.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, step: F.when(F.get(bounds, lo + step - 1) <= time, lo + step).otherwise(lo))


def events(lines: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``(*keys, time, fold, n, s, asked)``: one row per key, time and fold of ``lines`` with ``(*keys, time, fold, n, s)``.

    Union of history, shifted by ``gap`` seconds, with the rows that ask; without a gap the two of a line coincide, so one row is both. Equal rows are added up before and
    after the shuffle, so neither repeated rows nor very common times make a group of many rows.
    """
    if gap:
        blank = F.lit(0).cast("long")
        ask = F.struct(F.col("time"), blank.alias("n"), blank.alias("s"), F.lit(True).alias("asked"))
        past = F.struct((F.col("time") + int(gap * 1_000_000)).alias("time"), F.col("n"), F.col("s"), F.lit(False).alias("asked"))
        both = lines.select(*keys, "fold", F.inline(F.array(ask, past)))
    else:
        both = lines.withColumn("asked", F.lit(True))
    return added_up(both, keys)


def added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events of the keys, from events of the columns that determine them or from single rows."""
    return rows.groupBy(*keys, "time", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("asked").alias("asked"))


def hot_keys(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Keys with more than 1/``most`` of all rows: fewer than ``most``, whatever the size, so they can be broadcast."""
    limit = rows.count() // most
    return rows.groupBy(key).count().where(F.col("count") > limit).select(F.col(key).alias("hot_key"), F.lit(True).alias("hot"))


def earlier(rows: DataFrame, keys: list[str], folds: int, bounds: Column, chunks: int, hot: DataFrame | None = None) -> DataFrame:
    """``(*keys, time, fold, n, s)``: for every asking key, time and fold the sums of strictly earlier events of the key in other folds.

    A key's events are cut into time chunks (only those of ``hot`` keys, if given). Running sums of each fold of a key, and so of the key, are taken within a chunk; the totals
    of the chunks before it, a row per key and chunk, are running sums themselves and are added. Events of an asking row's own time don't count: who asks comes first on ties.
    """
    chunk = chunk_of(F.col("time"), bounds, chunks)
    if hot is None:
        cut = written(rows.withColumn("chunk", chunk))
    else:
        cut = rows.join(F.broadcast(hot), rows[keys[0]].eqNullSafe(hot["hot_key"]), "left").withColumn("chunk", F.when(F.col("hot"), chunk).otherwise(F.lit(-1))).drop("hot_key", "hot")
    sums = {f"{v}{i}": F.sum(F.when(F.col("fold") == i, F.col(v)).otherwise(0)) for v in "ns" for i in range(folds)}
    before = Window.partitionBy(*keys, "chunk").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    local = cut.select(*keys, "chunk", "time", "fold", "asked", *[F.coalesce(x.over(before), F.lit(0)).alias(c) for c, x in sums.items()])
    many = cut if hot is None else cut.where(F.col("chunk") >= 0)
    totals = many.groupBy(*keys, "chunk").agg(*[x.alias(c) for c, x in sums.items()])
    chunks_before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "chunk", *[F.sum(c).over(chunks_before).alias(f"c_{c}") for c in sums])
    summed = _met(local.where("asked"), carried, [*keys, "chunk"], keys, "left")

    def others(v: str) -> Column:
        each = [F.when(F.col("fold") != i, F.col(f"{v}{i}") + F.coalesce(F.col(f"c_{v}{i}"), F.lit(0))).otherwise(0) for i in range(folds)]
        return reduce(Column.__add__, each).alias(v)

    return summed.select(*keys, "time", "fold", others("n"), others("s"))


def _rate(prior: Column, weight: int) -> Column:
    hits = F.lit(1_000_000) * F.col("s") + F.lit(weight) * prior
    return F.when(F.col("n") < 1, prior).otherwise(F.floor(F.call_function("div", hits, F.col("n") + F.lit(weight)))).cast("long")


def _met(left: DataFrame, right: DataFrame, keys: list[str], nullable: list[str], kind: str = "inner") -> DataFrame:
    """A join on keys that ``right`` has once each, so that its partitions, which are hashed, are even; of those that are ``nullable`` null is one value."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k in nullable else F.col(k) == F.col(f"_{k}") for k in keys]
    return left.join(renamed.hint("shuffle_hash"), reduce(Column.__and__, same), kind).drop(*[f"_{k}" for k in keys])


def encode(lines: DataFrame, columns: dict[str, DataFrame | None], folds: int = FOLDS, gap: int = 0, prior: int = PRIOR, weight: int = WEIGHT) -> DataFrame:
    """``lines`` with ``<column>_n`` and ``<column>_rate``: count and smoothed rate (in millionths) of earlier lines of other folds alike in the column.

    ``lines`` has ``(time, fold, n, s)``, a time in microseconds (:func:`micros`) and n lines of which s have the flag, and the named columns; null is one of a column's values. A column's table, if there is one, gives the value
    of its ``parent`` by ``key``: the rate of that is the prior where the column's history is thin, and the rate of all history is the parent's. Keys that the table lacks share the null parent;
    of rows that repeat a key the least parent holds. Lines without time or fold are the caller's to drop; without lines the result is empty.

    Equal (key, time, fold) events are one row before any window, hot keys are cut by time, joins are on keys with the time, so no task holds a key, a sale or an instant
    as a whole. The driver gets the chunk bounds and counts, a broadcast fewer than ``4 * partitions`` keys.
    """
    chunks = CHUNKS * shuffle_parts(lines)
    bounds = time_bounds(lines, "time", chunks)
    if bounds is None:
        return lines.withColumns({f"{c}_{v}": F.lit(None).cast("long") for c in columns for v in ("n", "rate")})
    base, out = None, lines
    for column, parents in columns.items():
        rows = events(lines, [column], gap)
        if parents is None:
            rows = rows.withColumn("parent", F.lit(None).cast("string"))
        else:
            known = written(parents.groupBy("key").agg(F.min("parent").alias("parent")))  # as a table, so that partitions of a hot key can be split in the join
            rows = rows.join(known.hint("shuffle_hash"), F.col(column) == F.col("key"), "left").drop("key")
        rows = written(rows)
        if base is None:
            all_rows = added_up(rows.withColumn("all", F.lit(0)), ["all"])
            base = written(earlier(all_rows, ["all"], folds, bounds, chunks).select("time", "fold", _rate(F.lit(prior).cast("long"), weight).alias("base")))
        above = earlier(added_up(rows, ["parent"]), ["parent"], folds, bounds, chunks)
        above = _met(above, base, ["time", "fold"], []).select("parent", "time", "fold", _rate(F.col("base"), weight).alias("above"))
        own = earlier(rows, [column, "parent"], folds, bounds, chunks, hot_keys(rows, column, chunks))
        own = _met(own, above, ["parent", "time", "fold"], ["parent"]).select(column, "time", "fold", F.col("n").alias(f"{column}_n"), _rate(F.col("above"), weight).alias(f"{column}_rate"))
        out = _met(out, own, [column, "time", "fold"], [column])
    return out


def sale_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sale_id, item_id, vendor_id, client_id, time, fold, n, s)``: lines of known sales that have a time, added up per sale, item and vendor.

    Of rows that repeat a sale the earliest time and the least client hold. Null items and clients are -1, a null vendor stays null.
    """
    lines = table(spark, sf_dir, "sale_lines").where("sale_id is not null")
    lines = lines.groupBy("sale_id", F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), "vendor_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("flag") == "returned", 1)).alias("s"))
    sales = table(spark, sf_dir, "sales").where("sale_id is not null and sold_at is not null")
    sales = sales.groupBy("sale_id").agg(F.min(micros(F.col("sold_at"))).alias("time"), F.min(F.coalesce("client_id", F.lit(-1)).cast("long")).alias("client_id"))
    known = written(sales.withColumn("fold", fold_of("sale_id", FOLDS)))  # as a table, so that partitions of a sale of many lines can be split in the join
    return lines.join(known.hint("shuffle_hash"), "sale_id").select("sale_id", "item_id", "vendor_id", "client_id", "time", "fold", "n", "s")


def op12_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of items, vendors and clients for every sale, item and vendor; see :func:`encode` and :func:`sale_groups` for nulls and repeats."""
    parents = {
        "client_id": table(spark, sf_dir, "clients").select(F.col("client_id").alias("key"), F.col("segment").alias("parent")),
        "item_id": table(spark, sf_dir, "items").select(F.col("item_id").alias("key"), F.col("kind").alias("parent")),
        "vendor_id": table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("key"), F.col("nation_id").alias("parent")),
    }
    found = encode(written(sale_groups(spark, sf_dir)), parents)
    out = {"n": "n_lines", "s": "n_returned"} | {f"{c}_id_{v}": f"{c}_{v}" for c in ("item", "vendor", "client") for v in ("n", "rate")}
    return found.select("sale_id", "item_id", "vendor_id", *[F.col(k).alias(v) for k, v in out.items()])


def _sql_rate(n: str, s: str, prior: str) -> str:
    return f"CASE WHEN {n} < 1 THEN {prior} ELSE (1000000 * {s} + 50 * {prior}) // ({n} + 50) END"


_SQL_COLUMNS = {"al": "0", "kind": "kind", "nation": "nation", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
_SQL_SUMS = ", ".join(
    f"coalesce(sum({v}) OVER (PARTITION BY {c} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)"
    f" - coalesce(sum({v}) OVER (PARTITION BY {c}, fold ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS {name}_{v}"
    for name, c in _SQL_COLUMNS.items() for v in "ns"
)
OP12_SQL = f"""
WITH g AS (
  SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n, count(*) FILTER (WHERE flag = 'returned') AS s FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY ALL),
sold AS (SELECT sale_id, sold_at AS t, coalesce(client_id, -1) AS client_id,
  xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [i::UBIGINT for i in range(8)], lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT) % 5 AS fold
  FROM sales WHERE sale_id IS NOT NULL AND sold_at IS NOT NULL),
x AS (SELECT g.*, t, sold.client_id, fold, kind, v.nation_id AS nation, segment FROM g JOIN sold USING (sale_id)
  LEFT JOIN items i ON i.item_id = g.item_id LEFT JOIN vendors v ON v.vendor_id = g.vendor_id LEFT JOIN clients c ON c.client_id = sold.client_id),
h AS (SELECT sale_id, item_id, vendor_id, n, s, {_SQL_SUMS} FROM x),
a AS (SELECT *, {_sql_rate("al_n", "al_s", "500000")} AS p FROM h),
b AS (SELECT *, {", ".join(f"{_sql_rate(f'{c}_n', f'{c}_s', 'p')} AS {c}_p" for c in ("kind", "nation", "segment"))} FROM a)
SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned, {", ".join(f"{c}_n::BIGINT AS {c}_n, ({_sql_rate(f'{c}_n', f'{c}_s', f'{p}_p')})::BIGINT AS {c}_rate" for c, p in (("item", "kind"), ("vendor", "nation"), ("client", "segment")))} FROM b"""
