"""Candidate pairs of file names by shared block keys.

Every file gives its keys in one exploded table; blocks outside the size limits
are dropped before they are joined with themselves, so no block emits more than
the square of the limit. Files whose names give the same go into their blocks as
one group, with what a matcher reads; groups meet, and pairs come out of them at
last, unshuffled. A group lies in a usable block, so it has no more files than the
limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simigraph import store
from simigraph.config import Blocking

KINDS = ("name", "token", "prefix", "signature", "category", "length")
#: Columns that the keys are made of.
KEYED = ("normalized_name", "tokens", "token_signature", "extension_category", "length_bucket")
#: Columns of a file that its name doesn't give.
OWN = ("path", "size", "mtime", "parent_folder", "folder", "vector")


def _keys(kind: str, o: Blocking) -> Column:
    """The keys of one kind; repeated tokens give repeated keys."""
    name = F.col("normalized_name")
    one = lambda cond, c: F.when(cond, F.array(c)).otherwise(F.array().cast("array<string>"))
    return {
        "name": lambda: one(name != "", name),
        "token": lambda: F.filter("tokens", lambda t: F.length(t) >= o.min_token_length),
        "prefix": lambda: one(F.length(name) >= o.prefix_length, F.left(name, F.lit(o.prefix_length))),
        "signature": lambda: one(F.col("token_signature") != "", F.col("token_signature")),
        "category": lambda: one(F.lit(True), F.col("extension_category")),
        "length": lambda: one(F.lit(True), F.col("length_bucket").cast("string")),
    }[kind]()


def _entries(kind: str, o: Blocking) -> Column:
    return F.transform(_keys(kind, o), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))


def kinds_of(o: Blocking) -> list[str]:
    on = {"signature": o.use_token_signature, "category": o.use_extension_category, "length": o.use_length_bucket}
    return [k for k in KINDS if on.get(k, True)]


def block_keys(files: DataFrame, o: Blocking, kinds: Sequence[str] | None = None, by: Sequence[str] = ("path",)) -> DataFrame:
    """kind, key, path, or the columns in ``by``"""
    entries = [_entries(k, o) for k in (kinds or kinds_of(o))]
    rows = files.select(*by, F.explode(F.flatten(F.array(*entries))).alias("e"))
    return rows.select("e.kind", "e.key", *by)


def usable_blocks(keys: DataFrame, o: Blocking, entries: Column | None = None) -> DataFrame:
    """Blocks with their number of entries, within the limits; each key is one unless ``entries`` sums them."""
    count = F.count("*") if entries is None else F.sum(entries)
    return keys.groupBy("kind", "key").agg(count.alias("entries")).where(F.col("entries").between(2, o.max_block_size))


def groups_of(files: DataFrame, o: Blocking, columns: Sequence[str] = (), kinds: Sequence[str] | None = None) -> DataFrame:
    """Files that are alike in all of these columns and of the keys' but those of ``OWN``, as one row each.

    It has the columns, ``files`` with the path and those of ``OWN`` that are asked for,
    in order of the paths, and ``blocks`` with the numbers of the usable blocks, in order.
    Groups without any block are left out. Groups are told apart by the SHA-256 of their columns.
    """
    own = ["path", *(c for c in columns if c in OWN and c != "path")]
    shared = [c for c in columns if c not in OWN]
    named = list(dict.fromkeys([*(c for c in KEYED if c in files.columns), *shared]))
    told = F.unhex(F.sha2(F.to_json(F.struct(*named)), 256))
    rows = store.materialise(files.select(told.alias("_group"), *own, *named), "rows")  # read twice; made once
    sized = rows.groupBy("_group").agg(F.count("*").alias("_n"), F.first(F.struct(*named)).alias("_named"))
    sized = store.materialise(sized.select("_group", "_n", "_named.*"), "groups")
    keys = block_keys(sized, o, kinds, ("_group", "_n"))
    numbered = usable_blocks(keys, o, F.col("_n")).select("kind", "key", F.monotonically_increasing_id().alias("block"))
    numbered = store.materialise(numbered, "blocks")  # numbers must not change
    blocks = keys.join(numbered, ["kind", "key"]).groupBy("_group").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    usable = store.materialise(sized.select("_group", *shared).join(blocks, "_group"), "usable")
    # Files of a group without a block, which may be many, go before they are gathered.
    members = rows.select("_group", F.struct(*own).alias("f")).join(usable.select("_group"), "_group", "left_semi")
    return usable.join(members.groupBy("_group").agg(F.array_sort(F.collect_list("f")).alias("files")), "_group").drop("_group")


def meet(rows: DataFrame) -> DataFrame:
    """Any two rows that share one of their ``blocks``, under a_ and b_, a row with itself and both ways round.

    Two rows meet in the first block that they share and in no other, so what is
    shuffled is a row for each block of each row, once for both sides, never a pair.
    The number of tasks is given: adaptive execution would join small partitions to a
    few, by their bytes, but the work grows with the square of a block.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in rows.columns if c != "blocks"]
    entries = rows.select("*", F.posexplode("blocks").alias("_at", "_block")).withColumn("_before", F.slice("blocks", F.lit(1), F.col("_at"))).drop("blocks", "_at")
    entries = entries.repartition(tasks, "_block")
    side = lambda s: entries.select("_block", *(F.col(c).alias(f"{s}_{c}") for c in [*columns, "_before"]))
    both = side("a").join(side("b"), "_block").where(~F.arrays_overlap("a__before", "b__before"))
    return both.drop("_block", "a__before", "b__before")


def grouped_pairs(files: DataFrame, o: Blocking, columns: Sequence[str] = (), kinds: Sequence[str] | None = None) -> DataFrame:
    """Pairs of groups, both ways round, with these columns of both under a_ and b_ but those of ``OWN``, and with a_files and b_files."""
    met = meet(groups_of(files, o, columns, kinds))
    return met.where(F.element_at("a_files", 1)["path"] < F.element_at("b_files", -1)["path"])


def expanded(pairs: DataFrame) -> DataFrame:
    """The pairs of files in pairs of groups: path_a, path_b, the smaller path first, and all columns under a_ and b_."""
    own = pairs.schema["a_files"].dataType.elementType.names
    rest = [c for c in pairs.columns if c not in ("a_files", "b_files")]
    one = pairs.select(*rest, "b_files", F.explode("a_files").alias("_a")).select(*rest, "_a", F.explode("b_files").alias("_b"))
    one = one.where(F.col("_a")["path"] < F.col("_b")["path"])
    paths = [F.col(f"_{s}")["path"].alias(f"path_{s}") for s in "ab"]
    return one.select(*rest, *(F.col(f"_{s}")[c].alias(f"{s}_{c}") for s in "ab" for c in own), *paths)


def attached_pairs(files: DataFrame, o: Blocking, columns: Sequence[str] = (), kinds: Sequence[str] | None = None) -> DataFrame:
    """Distinct (path_a, path_b), the smaller path first, with these columns of both files under a_ and b_."""
    return expanded(grouped_pairs(files, o, columns, kinds))


def candidate_pairs(files: DataFrame, o: Blocking, kinds: Sequence[str] | None = None) -> DataFrame:
    """Distinct (path_a, path_b), the smaller path first."""
    return attached_pairs(files, o, kinds=kinds).select("path_a", "path_b")


def name_pairs(files: DataFrame, o: Blocking) -> DataFrame:
    """Distinct (a_normalized_name, b_normalized_name) of the candidate pairs.

    Files of the same name and blocks meet the same others, so they go as one, with
    their first and last path: some file of a comes before one of b if a's first
    comes before b's last.
    """
    named = groups_of(files, o, ("normalized_name",))
    first, last = F.element_at("files", 1)["path"], F.element_at("files", -1)["path"]
    alike = named.groupBy("normalized_name", "blocks").agg(F.min(first).alias("first"), F.max(last).alias("last"))
    return meet(alike).where("a_first < b_last").select("a_normalized_name", "b_normalized_name").distinct()
