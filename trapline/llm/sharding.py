"""Sharding by balanced label propagation.

Documents are linked by the hubs that they share: by default a hub is a text and its copies are
linked; a list of links (a, b) may be given instead, and then every link is a hub of two. Each
document starts in a shard given by a hash; in every round a linked document wants the shard
where most of its neighbours are. Wishes that another shard's make up for are swaps; beyond them
the quota of a shard is what linked documents leave free of its capacity. A wish is granted with
the share that this leaves, by a hash of document and round: a group larger than a shard fills several instead of overrunning one. Rounds are Spark
joins of the linked documents only with one row per hub: members are counted per hub and shard
before they shuffle, and a hub of more than `HOT` members is dealt over `SALT` rows, so none
makes a long task. The links cut are counted before the first round and at the end. At the end,
shards give up what exceeds their exact size, unlinked documents first, then whole hubs: counts
differ by one at most (law `rows`) and only hubs at a boundary are cut.

Everything on the way is one row per document of some 40 bytes; texts are read once. Native:
DataFrame expressions only.

Defined cases: a null text counts as empty; empty texts are one key; rows repeated with one
id are rows of their own; null ids stay null; an empty table gives no rows; other columns are
not read. A link between ids that no document has, or of an id with itself, links nothing; one to
an id of several documents links them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import runtime as R

#: Rows that are numbered by one task.
CELL = 20_000


def _share(*cols) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


#: Members from which a hub's row is kept SALT times.
HOT, SALT = 4096, 64


def _per_hub(placed: DataFrame, shards: int) -> DataFrame:
    """(hub, n, c0, c1, ...): members of each hub in each shard; placed (hub, n, shard)."""
    return placed.groupBy("hub").agg(F.first("n").alias("n"), *[F.count_if(F.col("shard") == s).alias(f"c{s}") for s in range(shards)])


def cut_links(placed: DataFrame, shards: int) -> int:
    """Pairs of members of a hub that lie in different shards; placed (hub, n, shard)."""
    c = [F.col(f"c{s}").cast("double") for s in range(shards)]
    return int(_per_hub(placed, shards).agg(F.sum((F.col("n") * F.col("n").cast("double") - sum(x * x for x in c)) / 2)).first()[0] or 0)


def grants(want: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], float]:
    """Share of the wishes from shard a to b that is granted: those that b's wishes to a make up for,
    and of the others what is free in b."""
    swap = {(a, b): min(n, want.get((b, a), 0)) for (a, b), n in want.items()}
    rest = [sum(n - swap[x] for x, n in want.items() if x[1] == b) for b in range(len(free))]
    return {x: (swap[x] + (n - swap[x]) * min(1.0, free[x[1]] / max(1, rest[x[1]]))) / n for x, n in want.items()}


def propagate(members: DataFrame, n: int, shards: int, rounds: int) -> DataFrame:
    """members (uid, hub, n, salt), those of hubs with two members or more: (uid, hub, shard) of every
    linked document, hub the least of its own. n: documents, linked or not."""
    capacity = -(-n // shards)
    at = R.cut(members.groupBy("uid").agg(F.min("hub").alias("hub")).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")))
    for k in range(rounds):
        hubs = _per_hub(members.join(at.drop("hub"), "uid"), shards).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT, SALT - 1).otherwise(0)))).drop("n")
        votes = members.join(hubs, ["hub", "salt"]).groupBy("uid").agg(F.count("*").alias("hubs"), *[F.sum(f"c{s}").alias(f"c{s}") for s in range(shards)])
        # a document counts itself once, not once for every hub
        own = lambda s: F.col(f"c{s}") - F.when(F.col("shard") == s, F.col("hubs") - 1).otherwise(0)
        best = F.array_max(F.array(*[F.struct(own(s).alias("c"), F.xxhash64("hub", F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))
        now = R.cut(at.join(votes, "uid").select("uid", "hub", "shard", best["s"].alias("wish")))
        # at most shards * shards rows
        flow = now.groupBy("shard", "wish").agg(F.count("*").alias("c")).collect()
        want = {(x.shard, x.wish): x.c for x in flow if x.shard != x.wish}
        if not want:
            break
        # linked documents displace unlinked ones at the end, so a quota is what linked documents leave free
        granted = grants(want, [max(0, capacity - sum(x.c for x in flow if x.shard == s)) for s in range(shards)])
        grant = F.element_at(F.array(*[F.lit(granted.get((a, b), 0.0)) for a in range(shards) for b in range(shards)]), F.col("shard") * shards + F.col("wish") + 1)
        at = R.cut(now.select("uid", "hub", F.when(_share("uid", F.lit(k)) < grant, F.col("wish")).otherwise(F.col("shard")).alias("shard")))
    return at


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int = 5, links: DataFrame | None = None, report: list | None = None) -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot and grown_shard (null under law `rows`).
    links: (a, b), ids of linked documents, instead of equal texts. report: gets the links that a deal by
    hash cuts and those that the shards returned cut."""
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.concat(F.hex(F.xxhash64(t)), F.hex(F.crc32(t.cast("binary"))), F.octet_length(t)).alias("hub"))
    nodes = R.cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    if links is None:
        every = nodes.select("uid", "hub")
    else:
        pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")).alias("hub")).distinct()
        every = nodes.select("id", "uid").join(ends, "id").select("uid", "hub")
    several = every.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    members = R.cut(every.join(several, "hub").withColumn("salt", F.when(F.col("n") > HOT, F.pmod(F.xxhash64("uid"), F.lit(SALT))).otherwise(0).cast("int")))
    placed = propagate(members, nodes.count(), shards, rounds)
    at = R.cut(nodes.drop("hub").join(placed, "uid", "left").withColumn("linked", F.col("shard").isNotNull()).withColumn("shard", F.coalesce("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))).withColumn("key", F.coalesce("hub", F.hex(F.xxhash64("uid")))).drop("hub"))
    load = dict.fromkeys(range(shards), 0) | dict(at.groupBy("shard").count().collect())
    n = sum(load.values())
    exact = [n // shards + (s < n % shards) for s in range(shards)]
    cells = max(1, n // (CELL * shards))
    wide = max(1, int(cells**0.5))
    cell = ["shard", "single", "kb", "ub"]
    at = at.select("*", (~F.col("linked")).cast("int").alias("single"), F.pmod(F.xxhash64("key"), F.lit(max(1, cells // wide))).alias("kb"), F.pmod(F.xxhash64("uid"), F.lit(wide)).alias("ub"))
    counts = at.groupBy(*cell).agg(F.count("*").alias("c"))
    offsets = counts.select(*cell, (F.sum("c").over(W.partitionBy("shard").orderBy("single", "kb", "ub").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    pos = at.withColumn("rn", F.row_number().over(W.partitionBy(*cell).orderBy("key", "uid"))).join(offsets, cell).withColumn("pos", F.col("before") + F.col("rn") - 1)
    # what a shard holds beyond its exact size fills the others' gaps, in order
    over, gap, a, b = [], [], 0, 0
    for s in range(shards):
        over.append(a - exact[s])
        a += max(0, load[s] - exact[s])
        gap.append(b)
        b += max(0, exact[s] - load[s])
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("shard") + 1)
    moved = F.col("pos") >= pick(exact)
    rank = F.col("pos") + pick(over)
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        inside = (rank >= gap[s]) & (rank < gap[s] + max(0, exact[s] - load[s]))
        to = F.when(inside, F.lit(s)).otherwise(to)
        slot = F.when(inside, rank - gap[s] + load[s]).otherwise(slot)
    out = pos.select("uid", "id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(moved, to).otherwise(F.col("shard")).cast("int").alias("shard"), F.when(moved, slot).otherwise(F.col("pos")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    if report is not None:
        out = R.cut(out)
        hashed = members.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
        report += [cut_links(hashed, shards), cut_links(members.join(out.select("uid", "shard"), "uid"), shards)]
    return out.drop("uid")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
