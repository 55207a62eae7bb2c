"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from collections.abc import Callable
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.session import WRITTEN, checkpoint_dir

#: White space of the word contracts: space and U+0009..U+000D. Java's ``\s`` is the same set.
WS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between white space, as an array; empty for null, empty and blank texts."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hash60(*parts: Column, seed: int = 0) -> Column:
    """60 uniform bits from md5 of the parts; the same value in any SQL engine with md5.

    Nulls count as a fixed mark, so rows that differ only in a null differ here too.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return os.path.join(checkpoint_dir(spark), f"wardlens-{name}-{uuid.uuid4().hex}")


#: With it, a query's shuffle files go when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, files: int | None = None, path: str | None = None, clean: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and outlives a lost executor.

    ``files``: at most so many, for tables known to be small. ``session.release`` removes the table; ``path``, from ``scratch``,
    lets ``session.discard`` do so earlier. ``clean``: the shuffle files of the writing go with its end.
    """
    spark, path = df.sparkSession, path or scratch(df.sparkSession, name)
    WRITTEN.append(path)
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(files) if files else df).write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def other_columns_aside(*made: str, of: tuple[str, ...] = ("key", "text", "source")) -> Callable:
    """Decorator of operators ``f(df, ...)`` that keep the columns they do not read.

    Those are named out of the way while the operator runs, so that no column it makes inside can meet one of them, and named back in
    its result. ``made`` are result columns, which replace existing ones (case-insensitive); ``of`` are the parameters that name read columns.
    """
    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(df: DataFrame, *args, **kw) -> DataFrame:
            call = signature(f).bind(df, *args, **kw)
            call.apply_defaults()
            read = {call.arguments[p] for p in of if p in call.arguments}
            kept = [c for c in df.columns if c in read or c.lower() not in made]
            name = {c: f"other__{i}" for i, c in enumerate(kept) if c not in read}
            call.arguments["df"] = df.select(*[F.col(f"`{c}`").alias(name.get(c, c)) for c in kept])
            if call.arguments.get("columns"):
                call.arguments["columns"] = [name.get(c, c) for c in call.arguments["columns"]]
            out, back = f(*call.args, **call.kwargs), {v: c for c, v in name.items()}
            return out.toDF(*[back.get(c, c) for c in out.columns])
        return run
    return wrap


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on costly computed columns.

    A plain filter would be moved below the projections, with the columns' expressions copied into it
    and computed again; it does not move past a column that depends on the task.
    """
    part = own_name(df, "part_")
    return df.withColumn(part, F.spark_partition_id()).where(condition & (F.col(part) >= 0)).drop(part)


#: Links to a file of the component rounds, so that small graphs do not become hundreds of tiny files.
LINKS_PER_FILE = 100_000


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest member of each link's component: (node, root), for nodes that occur in ``links``.

    ``links`` has two long columns (a, b). Alternates large-star and small-star steps (each is
    one shuffle with pre-aggregated minima); every round is written to the shared folder and
    the loop ends when every node but the roots has one link, to a root. No component is ever gathered in one place.
    """
    n = max(1, links.count())
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = store(small.select("x.u", "x.v").where("u <> v").distinct(), "cc", files=-(-n // LINKS_PER_FILE))
        n = max(1, e.count())
        # A star forest: no node has two links, and no root has a link to a smaller node.
        if e.groupBy("u").count().where("count > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle; raise rounds")


#: Ids up to so many are broadcast to a scan; more are joined by shuffle.
BROADCAST_IDS = 400_000
#: Up to so many members of a bucket are paired with each other at once.
SMALL = 4


def with_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``; the ids are counted first to choose the join."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


def bucket_components(rows: DataFrame, may: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame],
                      closer: tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column]] | None = None,
                      by: tuple[str, ...] | list[str] = ("id", "key"), parts: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node, root): connected components of all similar pairs that share a bucket; members without a link are left out.

    ``rows`` has (key, id, x): bucket, member, and what the cheap test ``may`` reads of a member;
    ``verify`` keeps the similar ones of distinct pairs (a, b). Every member is paired with its bucket's leader
    (a pre-aggregated minimum by hash); small buckets are paired fully. What larger ones still lack are
    pairs between components that the links so far leave apart. So rounds follow, with 8 times as
    many further leaders each (members below a rising hash threshold), which meet members of other components
    only. They end when each bucket is one component or has had all its pairs tested: none is capped.

    ``closer``, for these rounds, has a function from (id, root) of the members left to (id, x), a costlier x that is found from all
    of them, and the test that reads it; members that it leaves out are known to have no link to another component.
    ``by``: what the order of leaders is hashed from.
    ``parts``: from x to an array, in which members that ``may`` passes have a value in common; for these rounds buckets are divided by it.
    """
    u = F.shiftrightunsigned(F.xxhash64(*by), 11) / F.lit(2.0**53)
    # Most keys are held by one member; they leave on their count alone, before members are dealt out.
    many = store(rows.groupBy("key").count().where("count > 1").select("key"), "keys")
    rows = store(with_ids(rows, many, "key"), "rows")
    lead = rows.groupBy("key").agg(F.min(F.struct(u.alias("u"), "id", "x")).alias("m"), F.count(F.lit(1)).alias("n"))
    shared = store(rows.join(lead.select("key", "n", F.col("m.id").alias("lead"), F.col("m.x").alias("lead_x")), "key"), "buckets")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = shared.where((F.col("id") != F.col("lead")) & may(F.col("x"), F.col("lead_x"))).select(*pair(F.col("id"), F.col("lead")))
    few = shared.where(f"n > 2 and n <= {SMALL}").groupBy("key").agg(F.collect_list(F.struct("id", "x")).alias("m"))
    few = few.select(F.explode("m").alias("p"), "m").select("p", F.explode("m").alias("q")).where("p.id < q.id").where(may(F.col("p.x"), F.col("q.x")))
    found = verify(store(first.union(few.select(*pair(F.col("p.id"), F.col("q.id")))).distinct(), "pairs"))
    comp = connected_components(store(found, "links"))
    large = shared.where(f"n > {SMALL}").select("key", "id", "x", "n", u.alias("u"), F.col("id").alias("root"))
    if parts:
        large = large.withColumn("part", F.explode(parts(F.col("x")))).withColumn("key", F.xxhash64("key", "part")).drop("n", "part")
        sizes = store(large.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
        large = store(large.join(sizes, "key"), "parts")
    done, width, renamed, detail = 0, 8, comp, closer
    while True:
        if renamed is not None:
            new = renamed.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
            large = large.join(new, "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        apart = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("n"))
        large = store(large.join(apart.where(f"lo < hi and n > {done}").select("key"), "key", "left_semi"), "open")
        if large.isEmpty():
            return comp
        if detail:
            known, may = detail
            large, detail = store(large.drop("x").join(known(large.select("id", "root").distinct()), "id"), "closer"), None
        place = F.col("u") * F.col("n")
        leaders = large.where((place >= done) & (place < done + width)).select(
            "key", F.col("id").alias("lead"), F.col("x").alias("lead_x"), F.col("root").alias("lead_root"), F.col("u").alias("lead_u"))
        more = large.join(leaders, "key").where("u > lead_u and root <> lead_root").where(may(F.col("x"), F.col("lead_x")))
        more = more.select(*pair(F.col("id"), F.col("lead")), "root", "lead_root").dropDuplicates(["a", "b"])
        more = store(more, "pairs")
        renamed = None
        if not more.isEmpty():
            # New links join components, so the next components are those of the roots.
            joined = store(more.join(verify(more.select("a", "b")), ["a", "b"], "left_semi").select(
                F.col("root").alias("a"), F.col("lead_root").alias("b")).distinct(), "links")
            if not joined.isEmpty():
                renamed = connected_components(joined)
                moved = comp.join(renamed.select(F.col("node").alias("root"), F.col("root").alias("new_root")), "root", "left")
                known = moved.select("node", F.coalesce("new_root", "root").alias("root"))
                comp = store(known.union(renamed.join(comp.select("node"), "node", "left_anti").select("node", "root")), "components")
        done, width = done + width, width * 8


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of ``df``: those with the smallest hash of ``key``.

    A count gives the hash threshold that leaves about n rows, so the ordering that follows sees
    few rows from each task.
    """
    total = df.count()
    h = hash60(F.col(key), seed=3)
    few = df if total <= n else df.where(h < F.lit(int(2**60 * min(1.0, 1.1 * n / total + 50 / total))))
    return few.orderBy(h, key).limit(n)


def crc_mod(key: Column, m: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(m))
