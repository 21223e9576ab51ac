"""The inventory side: typed views of the entity table, edges, contig edits, reports.

The entity table means something else per container; every function works on a typed view, never on x, y, z.
Edits are selects that give the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: container -> meaning of o, x, y, z and barcode (fixed values of the data model)
VIEWS = {
    "sequence": {"o": "kind", "x": "owner", "y": "length", "z": "chr"},
    "assemblyCtg": {"o": "assembly", "x": "chr", "y": "order", "z": "position", "barcode": "length"},
}


def view(entities: DataFrame, container: str) -> DataFrame:
    names = VIEWS.get(container, {})
    return entities.filter(F.col("container") == container).select("id", "name", "note", *[F.col(c).alias(names.get(c, c)) for c in ("o", "x", "y", "z", "barcode")])


def children(edges: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """(parent, child rows): the child column is text, ids are numbers."""
    links = edges.filter(F.col("type") == kind).select("parent", F.expr("try_cast(child as bigint)").alias("id"))
    return links.join(entities, "id")


def either_name(wanted: DataFrame, clones: DataFrame) -> DataFrame:
    """Clones whose name or origin is wanted: two equi-joins and a union instead of an OR."""
    w = wanted.select("name").distinct()
    return clones.join(w, "name", "left_semi").unionByName(clones.join(w.withColumnRenamed("name", "origin"), "origin", "left_semi").select(clones.columns)).dropDuplicates(["id"])


def setting(users: DataFrame, values: DataFrame, defaults: DataFrame, field: str) -> DataFrame:
    """(user, value): the user's own or the default; of several the smallest, so the result does not depend on the order of rows."""
    own = values.filter(F.col("field") == field).groupBy("user").agg(F.min("value").alias("own"))
    default = defaults.filter(F.col("field") == field).groupBy("field").agg(F.min("value").alias("general"))
    asked = users.select("user", F.lit(field).alias("field")).join(own, "user", "left")
    return asked.join(F.broadcast(default), "field", "left").select("user", F.coalesce("own", "general").alias("value"))  # one row


# --- Contig edits -------------------------------------------------------------------------------------


def broken(contigs: DataFrame, members: DataFrame, contig: str, at: int, tail: str) -> tuple[DataFrame, DataFrame]:
    """Cut a contig before member ``at``: its tail becomes a contig right behind it, later orders move on by one."""
    moved = members.withColumn("__t", (F.col("contig") == contig) & (F.col("position") >= at))
    members2 = moved.select(F.when(F.col("__t"), tail).otherwise(F.col("contig")).alias("contig"), F.when(F.col("__t"), F.col("position") - at).otherwise(F.col("position")).alias("position"), *[c for c in members.columns if c not in ("contig", "position")])
    place = contigs.filter(F.col("contig") == contig).select(F.col("chr").alias("__c"), F.col("order").alias("__o"))
    shifted = contigs.join(F.broadcast(place), F.col("chr") == F.col("__c"), "left").withColumn("order", F.when(F.col("order") > F.col("__o"), F.col("order") + 1).otherwise(F.col("order")))
    new = place.select(F.lit(tail).alias("contig"), F.col("__c").alias("chr"), (F.col("__o") + 1).alias("order"))
    lengths = members2.groupBy("contig").agg(F.sum("length").alias("length"))
    return shifted.select("contig", "chr", "order").unionByName(new).join(lengths, "contig", "left"), members2


#: end types that swap when a contig is turned (fixed values)
TURNED_ENDS = {1: 2, 2: 1, 4: 5, 5: 4, 7: 8, 8: 7}


def turned(members: DataFrame, contigs: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """Reverse the members of the contigs that ``which`` picks, negate their strands and swap end types."""
    last = F.max("position").over(Window.partitionBy("contig"))
    m = members.withColumns({"position": F.when(which, last - F.col("position")).otherwise(F.col("position")), "strand": F.when(which, F.when(F.col("strand") == "-", "+").otherwise("-")).otherwise(F.col("strand"))})
    ends = F.coalesce(F.create_map(*[F.lit(x) for kv in TURNED_ENDS.items() for x in kv])[F.col("end_type")], F.col("end_type"))
    return m, contigs.withColumn("end_type", F.when(which, ends).otherwise(F.col("end_type")))


def reordered(contigs: DataFrame, order: str) -> DataFrame:
    """Contigs (contig, chr, order) with the orders of a list ``a,b,c``; contigs that it does not name follow in their old order."""
    asked = [n for n in order.split(",") if n]
    listed = F.create_map(*[F.lit(x) for i, n in enumerate(dict.fromkeys(asked), 1) for x in (n, i)])[F.col("contig")] if asked else F.lit(None).cast("int")
    rows = contigs.withColumn("__listed", listed)
    place = F.row_number().over(Window.partitionBy("chr").orderBy(F.col("__listed").asc_nulls_last(), "order", "contig"))
    return rows.withColumn("order", place).drop("__listed")


def full_length(members: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (contig, position, seq, start, end) with their whole sequences (seq, length) again, and the contigs' lengths."""
    m = members.drop("start", "end").join(sequences, "seq").select("contig", "position", "seq", F.lit(1).cast("long").alias("start"), F.col("length").cast("long").alias("end"))
    return m, m.groupBy("contig").agg(F.sum("end").alias("length"))


def toggled(members: DataFrame, which: Column, column: str, off: str = "-", on: str = "+") -> DataFrame:
    """Turn or hide single members: the sign in ``column`` changes for those that ``which`` picks."""
    return members.withColumn(column, F.when(which, F.when(F.col(column) == off, on).otherwise(off)).otherwise(F.col(column)))


def hidden_hit(hits: DataFrame, query: str, ref: str, line: int, hide: bool = True) -> DataFrame:
    """Hide or show the hit with that ordinal between two sequences, in whichever direction it is stored."""
    here = ((F.col("query_name") == query) & (F.col("ref_name") == ref)) | ((F.col("query_name") == ref) & (F.col("ref_name") == query))
    return hits.withColumn("hidden", F.when(here & (F.col("line_no") == line), hide).otherwise(F.col("hidden")))


def rekeyed(table: DataFrame, ids: DataFrame, columns: list[str], distinct: bool = False) -> DataFrame:
    """Replace ids by the map (old, new) in all of ``columns``; merges and deep copies are this on each relation."""
    for c in columns:
        m = ids.select(F.col("old").alias(c), F.col("new").alias("__new"))
        table = table.join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return table.dropDuplicates() if distinct else table


def first_free(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """The first letter A to Z that each key does not use yet; null if all are taken."""
    letters = F.array(*[F.lit(chr(c)) for c in range(65, 91)])
    return tracks.groupBy(*keys).agg(F.collect_set("track").alias("used")).select(*keys, F.get(F.array_except(letters, "used"), F.lit(0)).alias("track"))


def contig_lengths(members: DataFrame, filters: DataFrame, gap: int) -> DataFrame:
    """(contig, length): members less their filtered stretches, and one gap between neighbours that keep anything."""
    cut = members.join(filters, "seq", "left").withColumn("__f", F.when(F.col("f_start").isNotNull(), F.greatest(F.lit(0), F.least("end", "f_end") - F.greatest("start", "f_start") + 1)).otherwise(0))
    kept = cut.groupBy("contig", "position", "seq", "start", "end").agg((F.first("end") - F.first("start") + 1 - F.sum("__f")).alias("length")).filter("length > 0")
    return kept.groupBy("contig").agg((F.sum("length") + (F.count("*") - 1) * gap).alias("length"))


# --- Evidence and reports -------------------------------------------------------------------------------


def paired_ends(ends: DataFrame, least: int = 25_000, most: int = 300_000) -> DataFrame:
    """Both ends of a clone on one target, in opposite directions and a plausible distance apart."""
    a = ends.select("clone", "target", F.col("position").alias("left"), F.col("strand").alias("ls"), F.col("direction").alias("ld"))
    b = ends.select("clone", "target", F.col("position").alias("right"), F.col("strand").alias("rs"), F.col("direction").alias("rd"))
    pairs = a.join(b, ["clone", "target"]).filter((F.col("ld") < F.col("rd")) & (F.col("ls") != F.col("rs")))
    return pairs.withColumn("distance", F.abs(F.col("right") - F.col("left"))).filter(F.col("distance").between(least, most))


def voted_clones(tags: DataFrame, matches: DataFrame, least_share: float) -> DataFrame:
    """(sequence, clone, matched, share): the clone with most matched tags above the share; ties to the smaller name."""
    total = tags.groupBy("clone").agg(F.count("*").alias("total"))
    votes = matches.groupBy("sequence", "clone").agg(F.countDistinct("tag").alias("matched")).join(total, "clone").withColumn("share", F.col("matched") / F.col("total")).filter(F.col("share") > least_share)
    return votes.groupBy("sequence").agg(F.min(F.struct((-F.col("matched")).alias("m"), "clone", "share")).alias("b")).select("sequence", "b.clone", (-F.col("b.m")).alias("matched"), "b.share")


def progress(clones: DataFrame, library: str = "library", plate: str = "plate") -> DataFrame:
    """Clones and sequenced clones by plate, by library and in all, with whole percents."""
    sums = clones.rollup(library, plate).agg(F.count("*").alias("clones"), F.sum(F.col("sequenced").cast("long")).alias("sequenced"), F.grouping_id().alias("level"))
    return sums.withColumn("percent", F.expr("sequenced * 100 div clones"))


def status_of_clones(sequences: DataFrame) -> DataFrame:
    """(clone, status): the best status of its sequences; 1 and 2 over 3 over 4 over 5."""
    rank = F.when(F.col("status").isin(1, 2), 1).otherwise(F.col("status"))
    return sequences.groupBy("clone").agg(F.min(F.struct(rank.alias("r"), "status")).alias("b")).select("clone", "b.status")


def over_capacity(wells: DataFrame, run: str, limit: int, candidate: str | None = None) -> DataFrame:
    """Runs whose wells hold more than the limit, ``candidate`` left out if given."""
    rows = wells if candidate is None else wells.filter(F.col("id") != candidate)
    return rows.groupBy(run).agg(F.sum("amount").alias("amount")).filter(F.col("amount") > limit)


def table_rows(records: DataFrame, fields: int = 6) -> DataFrame:
    """JSON records ``{n: {field, value}}`` as (id, values): the first fields in numeric order of their keys."""
    entries = F.map_entries(F.from_json("note", "map<string,struct<field:string,value:string>>"))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].cast("int").alias("n"), e["value"]["value"].alias("value"))))
    return records.select("id", F.transform(F.slice(ordered, 1, fields), lambda x: x["value"]).alias("values"))


def search(names: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Names that contain the text, whatever its case; shortest first, then by name."""
    return names.filter(F.lower("name").contains(text.lower())).orderBy(F.length("name"), "name").limit(limit)
