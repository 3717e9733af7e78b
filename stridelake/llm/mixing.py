"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import id_of, is_null, order_id, table, written

#: Weights of the sources in code point order, repeating; the mix's size as a share of all words; the most a document is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Fractional documents that one step of the reduction tree folds into a single residual (about).
FAN = 64
SEED = 20
#: Equal rows that one array numbers.
CHUNK = 4096
_OWN = ("id", "none", "row", "copy", "size")
_DONE = "array<struct<id:bigint,none:boolean,row:bigint,copy:bigint,size:bigint,add:int>>"
_UNIT = "struct<id:bigint,none:boolean,row:bigint,copy:bigint,size:bigint,x:double>"


def word_count(text: Column) -> Column:
    """The number of runs without ASCII white space; null texts have none."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(words, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, n, target)``: words to take of each source, from ``per(source, source_size, n)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words; none gets more than ``most`` times its own,
    the excess goes to the others by weight. The level of words per weight is found in closed form: with sources in order of cap per
    weight, it is the first at which what the capped ones leave, spread over the others' weight, stays below the next one's cap.
    The sorted windows hold one row for each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    capped = per.withColumn("place", place).withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = capped.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    ratio = (F.col("cap") / F.col("w")).alias("ratio")
    common = F.min(F.when(F.col("fits"), F.struct(ratio, F.col("place"), F.col("level")))).over(whole)["level"]
    return levelled.withColumn("common", common).select(
        "source", "source_size", "n", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("w"))).alias("target")
    )


def _duel(state: Column, unit: Column, level: int, seed: int) -> Column:
    """Two fractional units meet: mass (words) moves from one to the other until one is integral; which way, a hash decides.

    The chances are such that both keep their expected number of copies, and the words of the two together stay the same.
    """
    i, j = state["cur"], unit
    si, sj, xi, xj = i["size"], j["size"], i["x"], j["x"]
    up, down = F.least((1 - xi) * si, xj * sj), F.least(xi * si, (1 - xj) * sj)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), i["id"], i["row"], i["copy"], j["id"], j["row"], j["copy"]), 11) / F.lit(float(1 << 53))
    i_full, i_empty, rises = (1 - xi) * si <= xj * sj, xi * si <= (1 - xj) * sj, draw * (up + down) < down
    new_i = F.when(rises, F.when(i_full, F.lit(1.0)).otherwise(xi + up / si)).otherwise(F.when(i_empty, F.lit(0.0)).otherwise(xi - down / si))
    new_j = F.when(rises, F.when(i_full, xj - up / sj).otherwise(F.lit(0.0))).otherwise(F.when(i_empty, xj + down / sj).otherwise(F.lit(1.0)))

    def settled(x: Column) -> Column:
        return (x < 1e-12) | (x > 1 - 1e-12)

    def entry(u: Column, x: Column) -> Column:
        return F.struct(*(u[c].alias(c) for c in _OWN), F.round(x).cast("int").alias("add"))

    def rest(u: Column, x: Column) -> Column:
        return F.struct(*(u[c].alias(c) for c in _OWN), x.alias("x"))

    def after(new: Column) -> Column:
        x, y = new["x"], new["y"]
        cur = F.when(~settled(x), rest(i, x)).when(~settled(y), rest(j, y)).otherwise(F.lit(None).cast(_UNIT))
        done = F.concat(state["done"], F.when(settled(x), F.array(entry(i, x))).otherwise(F.array().cast(_DONE)), F.when(settled(y), F.array(entry(j, y))).otherwise(F.array().cast(_DONE)))
        return F.struct(cur.alias("cur"), done.alias("done"))

    return F.transform(F.array(F.struct(new_i.alias("x"), new_j.alias("y"))), after)[0]


def _folded(units: Column, level: int, seed: int) -> Column:
    start = F.struct(F.lit(None).cast(_UNIT).alias("cur"), F.array().cast(_DONE).alias("done"))

    def step(state: Column, unit: Column) -> Column:
        first = F.struct(unit.alias("cur"), state["done"].alias("done"))
        return F.when(state["cur"].isNull(), first).otherwise(_duel(state, unit, level, seed))

    return F.aggregate(units, start, step)


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """A hash of the columns; nulls count, and maps by their JSON."""
    kinds = dict(df.dtypes)
    value = lambda c: F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] else F.col(f"`{c}`")
    return F.xxhash64(*(x for c in columns for x in (F.col(f"`{c}`").isNull(), value(c))))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, told_by: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, row, copy, size, source_size, target, copies, taken)`` per row: how often the mix takes it and the words that makes.

    A source's rows are taken ``target / source_size`` times on average: the integral part each, the fraction by dependent rounding over
    all its rows, which keeps the source's words at the target up to the last residual, a fraction of one document. ``row`` is a hash of the text (of the columns
    ``told_by`` if there are any), and ``copy`` counts the rows of equal id, hash and source.
    Null texts and texts without words have size 0 and take no part (no copies); null ids and repeated rows are rows like
    others; null is a source. Long texts count whole. Reruns agree: blocks, order and draws are hashes of ids, texts and counts.

    Rows are dealt to blocks of about ``FAN`` by hash, so neither a source nor equal rows of any share meet in one task. Each block folds its units to decisions
    and one residual at most; residuals of ``FAN`` neighbouring blocks meet on the next level, until each source has one, which goes to the
    nearer side: a source misses its target by half a document at most. Levels grow with the logarithm of the rows; each is a written table.
    """
    row = row_hash(df, [*(told_by or (text_col,))])
    sizes = written(df.select(
        order_id(id_col).alias("id"), is_null(id_col).alias("none"), row.alias("row"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"),
    ).groupBy("id", "none", "row", "source", "size").agg(F.count("*").alias("equal")))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.sum("equal").alias("n"))
    targets = written(source_targets(totals, weights, share, most).withColumn("key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets.withColumn("base", F.floor(rate + 1e-12).cast("int")).withColumn("x", F.greatest(F.lit(0.0), rate - F.col("base")))
    groups = sizes.join(known.withColumnRenamed("source", "known_source"), F.col("source").eqNullSafe(F.col("known_source"))).drop("known_source")
    chunks = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("equal") - 1) / CHUNK))))
    inside = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("equal")) - 1)
    rows = chunks.withColumn("copy", F.explode(inside)).drop("chunk", "equal")
    loose = (F.col("size") > 0) & (F.col("x") > 1e-12)
    blocks = F.ceil(F.col("n") / FAN)
    unit = F.struct(F.xxhash64(F.lit(seed + 1), "id", "row", "copy").alias("at"), *_OWN, "x").alias("unit")
    level = rows.where(loose).select("key", F.pmod(F.xxhash64(F.lit(seed), "id", "row", "copy"), blocks).alias("block"), unit)
    largest = targets.agg(F.max("n")).first()[0] or 0
    decided, depth, left = None, 0, -(-largest // FAN)
    while True:
        bare = F.transform(F.array_sort(F.collect_list("unit")), lambda u: F.struct(*(u[c].alias(c) for c in (*_OWN, "x"))))
        folded = written(level.groupBy("key", "block").agg(bare.alias("units")).select("key", "block", _folded(F.col("units"), depth, seed).alias("state")))
        done = folded.select("key", F.explode("state.done").alias("d")).select("key", "d.*")
        decided = done if decided is None else decided.unionByName(done)
        rest = folded.where("state.cur IS NOT NULL").select("key", F.floor(F.col("block") / FAN).alias("block"), "state.cur.*")
        if left <= 1:
            break
        level = rest.select("key", "block", unit)
        depth, left = depth + 1, -(-left // FAN)
    decided = decided.unionByName(rest.select("key", *_OWN, F.round("x").cast("int").alias("add")))
    settled = rows.where(~loose).select("key", *_OWN, F.lit(0).alias("add"))
    taken = decided.unionByName(settled).join(known.select("key", "source_size", "target", "base"), "key")
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("add")).otherwise(F.lit(0))
    return taken.select(id_of("id", "none").alias("id"), "row", "copy", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """``df`` with each row as often as :func:`mix` takes it.

    Rows that are equal in all columns are one row with the sum of their copies: they are brought together by a pre-aggregated first, so
    a group of copies of any size is one row per task, and what differs in some column is dealt its own copies at every run.
    """
    taken = mix(df, id_col, text_col, source_col, told_by=tuple(df.columns), **parameters)
    by = ["__mx_id", "__mx_none", "__mx_row"]
    taken = taken.select(order_id("id").alias(by[0]), F.col("id").isNull().alias(by[1]), F.col("row").alias(by[2]), "copies")
    total = taken.groupBy(*by).agg(F.sum("copies").alias("__mx_n")).where("__mx_n > 0")
    rows = df.select(order_id(id_col).alias(by[0]), is_null(id_col).alias(by[1]), row_hash(df, df.columns).alias(by[2]), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__mx"))
    one = rows.groupBy(*by).agg(F.first("__mx").alias("__mx")).join(total, by)
    chunks = one.select("__mx", "__mx_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__mx_n") - 1) / CHUNK))).alias("__mx_chunk"))
    inside = F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("__mx_n") - F.col("__mx_chunk") * CHUNK))
    return chunks.select("__mx", F.explode(inside)).select("__mx.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document; see :func:`mix` for nulls, empty texts, ties and repeats."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
