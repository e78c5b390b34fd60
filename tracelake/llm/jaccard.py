"""N-gram Jaccard join by set relations: exact links between documents whose 5-word shingle sets have a similarity of 0.75 or more.

1. shared_tokens() finds the shingles that occur twice. A document linked with another one shares at least 75% of its shingles with it, so one with fewer
   shared shingles is skipped: in most corpora nearly all are.
2. Documents with equal sets are one class; its smallest doc_id stands for it.
3. Classes are indexed under their rarest shingles (prefix filter). An index list is cut into blocks by set size, in steps a little wider than the sizes that
   can be linked; a set stands in the block of its own size, and in the next one if its position in the list leaves an overlap possible with any
   set there. All other blocks are skipped, and inside a block entries whose positions rule out the overlap.
4. Answers come from answers: each block is first compared with its smallest member. Members of one component need no comparison with each other, and the
   known distances to a common set bound those between two sets (triangle inequality), so a later round compares only members outside a block's largest
   component, where the bounds leave it open. Blocks of one component, as groups of near copies are, are never expanded into pairs.

Components are found by rounds of smallest labels with shortcuts, all in DataFrames.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .shared import shared_tokens
from .textkit import shingles

WIDTH, SHARE = 5, 75
#: Sizes of one block differ by this factor: more than 100 / SHARE, so linked sets stand in the same block or in neighbouring ones.
STEP = 1.34


def _tokenize(column):
    return shingles(column, WIDTH)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, c): for each vertex of edges (x, y) the smallest vertex it can reach."""
    links = scratch.save(edges.select(F.col("x").alias("v"), F.col("y").alias("u")).union(edges.select(F.col("y").alias("v"), F.col("x").alias("u"))).distinct())
    labels = scratch.save(links.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")))
    while True:
        near = links.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", "c", F.least("c", "m").alias("m"))
        far = labels.select(F.col("v").alias("m"), F.col("c").alias("further"))
        new = scratch.save(step.join(far, "m", "left").select("v", F.col("c").alias("old"), F.least("m", F.coalesce("further", "m")).alias("c")))
        done = new.where("old <> c").isEmpty()
        scratch.drop(labels)
        labels = new
        if done:
            scratch.drop(links)
            return labels.select("v", "c")


def _verify(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (x, y) with the exact distance of their sets, all that are linked or not."""
    one = reps.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("toks").alias("tx"))
    two = reps.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("toks").alias("ty"))
    both = pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", F.size(F.array_intersect("tx", "ty")).cast("long").alias("inter"))
    return both.select("x", "y", (100 * F.col("inter") >= SHARE * (F.col("nx") + F.col("ny") - F.col("inter"))).alias("linked"), (1 - F.col("inter") / (F.col("nx") + F.col("ny") - F.col("inter"))).alias("dist"))


def _within_reach(a: str, b: str):
    """Sizes and positions of a common token leave an overlap of SHARE possible. Of two visitors of a block, one is at home in an earlier one: they meet there."""
    na, nb, pa, pb = (F.col(f"{t}.{c}") for t, c in ((a, "n"), (b, "n"), (a, "pos"), (b, "pos")))
    most = F.least(na - pa, nb - pb)
    return (100 * F.least(na, nb) >= SHARE * F.greatest(na, nb)) & ((100 + SHARE) * most >= SHARE * (na + nb)) & (F.col(f"{a}.home") | F.col(f"{b}.home"))


def _blocks(entries: DataFrame) -> DataFrame:
    """entries (tok, rep, n, pos) by block, with home: whether the block is that of its own size. The largest set that an entry can be linked with follows from its
    size and from the tokens left behind its position."""
    own = F.floor(F.log("n") / math.log(STEP)).cast("int")
    reach = F.least(F.col("n") * 100 / SHARE, F.lit((100 + SHARE) / SHARE) * (F.col("n") - F.col("pos")) - F.col("n"))
    next_size = F.pow(F.lit(STEP), own + 1)
    # A little under the next block's smallest size, so that rounding skips nothing.
    both = F.when(reach >= next_size * (1 - 1e-9), F.array(own, own + 1)).otherwise(F.array(own))
    return entries.select("*", F.posexplode(both).alias("away", "blk")).withColumn("home", F.col("away") == 0).drop("away")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by links, itself included), n_links (links of its class with other classes
    that were compared; copies of a set are in one class).

    docs needs doc_id and text; other columns are not read. Text null, empty or blank: no shingles, linked with nothing. Fewer than five words: the whole
    sequence is the one shingle. Rows without doc_id have no name and are left out. Rows that share a doc_id give one row (its smallest component, its largest set).
    An empty table gives an empty table. Texts are read whole, whatever their length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = scratch.save(shared_tokens(docs, _tokenize, True, SHARE / 100).drop("dfs"))
    members = found.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("toks", ignorenulls=True).alias("toks"))
    members = members.withColumn("key", F.col("rep"))
    reps = scratch.save(members.where("toks is not null").select("rep", "n", "toks"))
    # Shingles that stand nowhere else come first in every set; what remains of the prefix is taken from the rarest shared ones.
    prefix = F.col("n") - F.ceil(F.col("n") * SHARE / 100) + 1 - (F.col("n") - F.size("toks"))
    entries = reps.where(prefix > 0).select("rep", "n", (F.col("n") - F.size("toks")).alias("alone"), F.posexplode(F.slice("toks", F.lit(1), prefix.cast("int"))).alias("k", "tok"))
    entries = _blocks(entries.select("tok", "rep", "n", (F.col("alone") + F.col("k")).alias("pos")))
    member = F.struct("rep", "n", "pos", "home")
    first = entries.groupBy("tok", "blk").agg(F.count("*").alias("size"), F.min_by(member, "rep").alias("lead")).where("size > 1").drop("size")
    entries = scratch.save(entries.join(first, ["tok", "blk"]))
    star = entries.select("lead", member.alias("m")).where("m.rep <> lead.rep").where(_within_reach("lead", "m"))
    star = star.select(F.col("lead.rep").alias("lead"), F.col("m.rep").alias("rep"))
    tested = scratch.save(_verify(star.select(F.col("lead").alias("x"), F.col("rep").alias("y")).distinct(), reps))
    labels = components(scratch, tested.where("linked"))
    for last in (False, True):
        open_ = _open_pairs(scratch, entries, labels, tested, last)
        if open_ is None:
            continue
        tested = scratch.save(tested.unionByName(_verify(open_, reps)))
        labels = components(scratch, tested.where("linked"))
    degree = tested.where("linked").select(F.explode(F.array("x", "y")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    names = members.select("n", "s1", "s2", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left").join(degree, "rep", "left")
    out = found.select("doc_id", "n", "s1", "s2").join(names, ["n", "s1", "s2"], "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("c", "rep", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))


def _open_pairs(scratch: Scratch, entries: DataFrame, labels: DataFrame, tested: DataFrame, last: bool) -> DataFrame | None:
    """Pairs that stand in one block and in different components, not yet compared and not excluded by known distances: those with the smallest member outside
    a block's largest component, or at last all. None if there are none."""
    named = entries.select("tok", "blk", "rep", "n", "pos", "home").join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    parts = named.groupBy("tok", "blk", "c").agg(F.count("*").alias("size"))
    lists = parts.groupBy("tok", "blk").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("size", "c")).alias("largest"))
    named = scratch.save(named.join(lists.where("parts > 1").select("tok", "blk", "largest"), ["tok", "blk"]))
    few = named.where("c <> largest")
    if not last:
        few = few.groupBy("tok", "blk").agg(F.min_by(F.struct("rep", "n", "pos", "home", "c"), "rep").alias("p")).select("tok", "blk", "p.*")
    a, b = few.alias("a"), named.alias("b")
    same = (F.col("a.tok") == F.col("b.tok")) & (F.col("a.blk") == F.col("b.blk"))
    pairs = a.join(b, same & (F.col("a.c") != F.col("b.c")) & _within_reach("a", "b"))
    pairs = pairs.select(F.least("a.rep", "b.rep").alias("x"), F.greatest("a.rep", "b.rep").alias("y")).distinct().join(tested, ["x", "y"], "left_anti")
    known = tested.groupBy("y").agg(F.min_by(F.struct("x", "dist"), "x").alias("k"))
    bounds = pairs.join(known.select(F.col("y").alias("x"), F.col("k").alias("kx")), "x", "left").join(known.select("y", F.col("k").alias("ky")), "y", "left")
    apart = (F.col("kx.x") == F.col("ky.x")) & (F.abs(F.col("kx.dist") - F.col("ky.dist")) > (100 - SHARE) / 100 + 1e-9)
    left = scratch.save(bounds.where(~F.coalesce(apart, F.lit(False))).select("x", "y"))
    scratch.drop(named)
    return None if left.isEmpty() else left


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id. Rows without doc_id stay; of rows that share a doc_id that with the smallest text (then by hash of all
    columns) stays, whatever the layout of the files."""
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs)
    lost = scratch.save(found.where("component_id <> doc_id").select("doc_id"))
    kept = docs.join(lost, "doc_id", "left_anti").select(docs.columns)
    repeated = scratch.save(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    plain = [c for c, t in docs.dtypes if "map" not in t and "variant" not in t]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*plain)))
    name = "_place"
    while name in docs.columns:
        name += "_"
    several = kept.join(repeated, "doc_id", "left_semi").withColumn(name, place).where(F.col(name) == 1).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(several)
