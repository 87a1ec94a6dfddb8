"""Best representative of each duplicate group (problem 1).

Captures of one run are found by their trade lists: two records belong together
if one list is a prefix of the other. Every distinct list offers the hashes of
all its prefixes; an equi-join with the hashes of whole lists finds the shortest
list that begins it, which names the run. The work is linear in the lists' total
length: no pair of captures is ever formed, and exact copies are one list.

The surviving record takes each field from the most current capture of its run that
has a value, by currency reasoning. The captures of a run and field are a partial order:
better trust goes before worse, in one trust a later time before an earlier one and any
time before none. Captures of one trust without time are ordered by what the dated
captures of all runs show: where a value is followed by another more often than the
other way round, the first is the older one. Of the undated values of a run the
topologically latest is taken, the one that no other value of the run supersedes; in a
cycle of such edges the one against which the fewest votes speak, that is the first to
be free when edges are taken out from the weakest on. What is then still open goes to
the smallest run_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.drift import cast_records, documented, matched_files, read_once
from ..plans.ranking import bucketed_rank
from ..session import checkpointed
from ..sources.tables import contract_key

#: Fields of a surviving record that are chosen one by one.
FIELDS = ("fidelity", "strategy", "entry_signal", "bar_type", "calculate", "params", "perf_cum_profit")
#: Trust in a capture by its fidelity, best first; all else comes last.
TRUST = ("exact", "fillsguessed")
#: The ways in which a capture writes its time (fractions are cut before).
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyyMMdd HHmmss", "dd MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd")


def written_at(col: str | Column) -> Column:
    """Time of a capture to the second in any of TIME_FORMATS; null if it cannot be read.
    An offset from UTC behind the time of day is taken off."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    offset = F.regexp_extract(c, r":\d\d(?:[.,]\d+)?\s*([+-]\d\d:?\d\d)$", 1)
    minutes = (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, -2, 2).cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)
    text = F.regexp_replace(F.regexp_replace(c, r"(?<=:\d\d)(?:[.,]\d+)?\s*[+-]\d\d:?\d\d$", ""), r"Z$", "")
    text = F.regexp_replace(text, r"[.,]\d+$", "")
    at = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])
    return F.when(offset == "", at).otherwise(F.timestamp_seconds(F.unix_seconds(at) - 60 * minutes))


def has_value(name: str, kind: str) -> Column:
    """Null, NaN, blank, 'unknown' and '{}' are no value."""
    c = F.col(name)
    if kind in ("double", "float"):
        return c.isNotNull() & ~F.isnan(c)
    if kind != "string":
        return c.isNotNull()
    bare = F.lower(F.regexp_replace(c, r"\s+", ""))
    return c.isNotNull() & ~bare.isin("", "unknown", "{}")


def fidelity_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_-]+", ""))


def trust_rank(c: Column) -> Column:
    out = F.when(fidelity_key(c) == TRUST[0], 0)
    for i, name in enumerate(TRUST[1:], 1):
        out = out.when(fidelity_key(c) == name, i)
    return out.otherwise(len(TRUST))


def _prefixed(files: DataFrame, trade_fields: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """run_id, c (instrument), ``keep``, prefixes (digests of the first 1, 2, ... trades)
    and whole (the last of them), one row per file; files without trades or instrument
    have none."""
    fields = documented(trade_fields)
    rows = files.where("run_id is not null").withColumn("c", contract_key("instrument")).where("c is not null")
    laid = matched_files(rows.select("run_id", "c", "trades", *keep), trade_fields).select("trades", "match", "c", "run_id", *keep)
    kinds = dict(laid.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, match, c in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                listed = sorted(t for t in ((r.get("entry") or "", r.get("exit") or "") for r, _ in cast_records(text, match, fields)) if any(t))
                digest, digests = hashlib.md5(c.encode("utf-8", "surrogatepass")).digest(), []
                for a, b in listed:
                    digest = hashlib.md5(digest + f"|{a}|{b}".encode("utf-8", "surrogatepass")).digest()
                    digests.append(digest)
                out.append(digests)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.list_(pa.binary()))], names=[*batch.schema.names[2:], "prefixes"])

    out = laid.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in laid.columns[2:]) + ", prefixes array<binary>")
    return out.where(F.size("prefixes") > 0).withColumn("whole", F.element_at("prefixes", -1))


def _rooted(keyed: DataFrame) -> DataFrame:
    """``keyed`` with the column run instead of prefixes and whole."""
    distinct = keyed.groupBy("whole").agg(F.first("prefixes").alias("prefixes"))
    offered = distinct.select("whole", F.posexplode("prefixes").alias("n", "p"))
    roots = offered.join(distinct.select(F.col("whole").alias("p")), "p").groupBy("whole").agg(F.hex(F.min_by("p", "n")).alias("run"))
    return keyed.drop("prefixes").join(roots, "whole").drop("whole")


def run_groups(files: DataFrame, trade_fields: DataFrame) -> DataFrame:
    """(run_id, run): the run that each capture belongs to, named by the digest of its
    instrument and shortest list.

    Listed trades are ordered by entry and exit time before they are compared. A
    capture without instrument or without any listed trade with a time agrees
    with none and has no row. Captures of two runs that share a shorter capture
    are one run.
    """
    return _rooted(read_once(_prefixed(files, trade_fields, ()), "run_id")).select("run_id", "run").distinct()


def value_precedence(captures: DataFrame, group: str, capture_id: str, value: str, at: str, field: str | None = None) -> DataFrame:
    """(earlier, later, n_forward, n_backward, precedes): learned transitions, for each
    value of the column ``field`` if one is named.

    In each group, timestamped captures in order of time vote for 'earlier value
    before later value'; ``precedes`` holds where forward votes outnumber backward
    ones. Consecutive captures only, found by joining ranks, so a large group is
    never one task. Groups with one capture, and captures without time or value,
    do not vote; captures of one second do not vote against each other.
    """
    rows = captures.where(F.col(group).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(group).alias("g"), (F.col(field) if field else F.lit("")).alias("f"), F.col(capture_id).alias("id"), F.unix_seconds(F.col(at)).alias("t"), F.col(value).alias("v"))
    ranked = bucketed_rank(rows, ["g", "f"], "t", 86_400, "r", ties=("id",))
    after = ranked.select("g", "f", (F.col("r") - 1).alias("r"), F.col("v").alias("w"), F.col("t").alias("u"))
    moves = ranked.join(after, ["g", "f", "r"]).where("v != w and t < u").groupBy("f", F.col("v").alias("earlier"), F.col("w").alias("later")).agg(F.count(F.lit(1)).alias("n_forward"))
    back = moves.select("f", F.col("earlier").alias("later"), F.col("later").alias("earlier"), F.col("n_forward").alias("n_backward"))
    out = moves.join(back, ["f", "earlier", "later"], "left").withColumn("n_backward", F.coalesce("n_backward", F.lit(0)))
    names = ["earlier", "later", "n_forward", "n_backward", (F.col("n_forward") > F.col("n_backward")).alias("precedes")]
    return out.select(*([F.col("f").alias(field)] if field else []), *names)


def topologically_latest(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, f, v, against): of each group and field the values with what speaks against
    their being the latest: the most net votes of an edge from the value to another one
    of the group, 0 where none leaves it. The latest are those of the least ``against``.

    values: distinct (g, f, v); edges: (f, earlier, later, votes), one for each learned
    precedence. Joined along the edges, never value by value: a group costs the edges
    between its values.
    """
    leaving = values.join(edges, (values["f"] == edges["f"]) & (values["v"] == edges["earlier"])).select("g", values["f"], "v", "later", "votes")
    there = values.select("g", "f", F.col("v").alias("later"))
    most = leaving.join(there, ["g", "f", "later"]).groupBy("g", "f", "v").agg(F.max("votes").alias("against"))
    return values.join(most, ["g", "f", "v"], "left").select("g", "f", "v", F.coalesce("against", F.lit(0)).alias("against"))


def most_current(captures: DataFrame, group: str, capture_id: str, fields: tuple[str, ...], trust: Column, at: str) -> DataFrame:
    """(group, field, capture_id, value): for each group of two or more captures and each
    field the most current capture that has a value, by the partial order above.

    trust: integral, best first; at: timestamp or null. Values that differ only in
    case, blanks, '-' and '_' are one value to the learning. Repeated rows are one
    capture. A field without any value in its group has no row. Aggregates on the
    map side: a group that holds a third of all captures is one buffer per task.
    """
    kinds = dict(captures.dtypes)
    rows = captures.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(capture_id).alias("id"), trust.alias("tr"), F.col(at).alias("at"), *[F.when(has_value(f, kinds[f]), F.col(f).cast("string")).alias(f) for f in fields])
    key = F.struct("tr", F.col("at").isNull().alias("undated"), (-F.unix_seconds("at")).alias("ago"), "id")
    stated = rows.groupBy("g").agg(F.count_distinct("id").alias("_n"), *[F.min(F.when(F.col(f).isNotNull(), F.struct(key.alias("k"), F.col(f).alias("v")))).alias(f) for f in fields]).where("_n > 1")
    long = lambda r, *more: r.select("g", *more, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in fields])).alias("y"))
    stated = long(stated).select("g", "y.f", F.col("y.x.k").alias("k"), F.col("y.x.v").alias("v")).where("k is not null")
    # Undated captures of one trust whose values differ: only they need the learned order.
    values = long(rows, "id", "tr", "at").select("g", "id", "tr", "at", "y.f", F.col("y.x").alias("x"), fidelity_key(F.col("y.x")).alias("v")).where("x is not null")
    undated = values.where("at is null")
    contested = undated.groupBy("g", "tr", "f").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a != z").select("g", "tr", "f")
    open_ = undated.join(contested, ["g", "tr", "f"]).withColumn("place", F.struct("g", "tr"))
    edges = value_precedence(values, "g", "id", "v", "at", "f").where("precedes").select("f", "earlier", "later", (F.col("n_forward") - F.col("n_backward")).alias("votes"))
    ranked = topologically_latest(open_.select(F.col("place").alias("g"), "f", "v").distinct(), edges)
    settled = open_.join(ranked.withColumnRenamed("g", "place"), ["place", "f", "v"]).groupBy("g", "tr", "f").agg(F.min(F.struct("against", "id", "x")).alias("s"))
    # They decide where no dated capture and no better trust has a value.
    out = stated.join(settled.select("g", "f", "tr", "s"), (stated["g"] == settled["g"]) & (stated["f"] == settled["f"]) & stated["k.undated"] & (stated["k.tr"] == settled["tr"]), "left")
    return out.select(stated["g"].alias(group), stated["f"].alias("field"), F.coalesce("s.id", "k.id").alias(capture_id), F.coalesce("s.x", stated["v"]).alias("value"))


def surviving_fields(files: DataFrame, trade_fields: DataFrame) -> DataFrame:
    """(run, field, run_id, value) of the surviving record of each run that was
    captured more than once. A run_id given twice is one capture; see run_groups
    for nulls."""
    # The fields travel with the digests, spread by capture. Captures with their runs are
    # kept: the learning reads them several times, and no lost executor costs the texts again.
    keyed = read_once(_prefixed(files.withColumn("_at", written_at("written")), trade_fields, (*FIELDS, "_at")), "run_id")
    return most_current(checkpointed(_rooted(keyed)), "run", "run_id", FIELDS, trust_rank(F.col("fidelity")), "_at")
