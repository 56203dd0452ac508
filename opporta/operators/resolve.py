"""Organization resolution: which mentions are one organization, and the upsert that follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.functions import ids, text as tx
from opporta.runtime import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, component` of an undirected graph (u, v): component is the smallest node of each part.

    Alternates two star rounds until nothing changes, which takes a number of rounds that grows with
    the logarithm of the longest chain. Each round is two map-side combined aggregates and a join, so a
    node with very many neighbors is never collected; no round limit cuts a result short.
    """
    current = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    before = _signature(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        current = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        after = _signature(current)
        if after == before:
            break
        before = after
    parts = current.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(parts, nodes.node == parts.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def _keys() -> tuple[Column, Column, Column]:
    domain = F.concat(F.lit("d:"), tx.blank_to_null(F.lower(F.trim("domain"))))
    tax = F.concat(F.lit("t:"), tx.blank_to_null(F.trim("tax_code")))
    name = F.concat(F.lit("n:"), tx.blank_to_null(F.lower(F.trim("legal_name"))))
    return domain, tax, name


def resolve(mentions: DataFrame) -> DataFrame:
    """Add `component`. Mentions with the same domain or tax code are one organization (transitively).

    A mention with neither joins an organization of its name: the smallest component that has a mention
    so named, else a component of its own name. Repeated key pairs collapse before the graph is built. A
    mention without domain, tax code and name tells of no organization and is left out (see `nameless`).
    """
    domain, tax, name = _keys()
    keyed = mentions.withColumns({"_d": domain, "_t": tax, "_n": name}).withColumn("_k", F.coalesce("_d", "_t"))
    pairs = keyed.where("_k IS NOT NULL").select(
        F.coalesce("_d", "_t").alias("u"), F.coalesce("_t", "_d").alias("v")).distinct()
    parts = cut_lineage(connected_components(pairs))
    by_key = keyed.where("_k IS NOT NULL").join(parts, keyed._k == parts.node).drop("node")
    names = by_key.where("_n IS NOT NULL").groupBy("_n").agg(F.min("component").alias("_named"))
    by_name = keyed.where("_k IS NULL AND _n IS NOT NULL").join(names, "_n", "left").withColumn("component", F.coalesce("_named", "_n")).drop("_named")
    return by_key.unionByName(by_name).drop("_d", "_t", "_n", "_k")


def resolution_state(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What later runs need of a full one: `node, component` of every domain and tax code, and the different pairs
    `name, component` of mentions that have a key. Store both."""
    domain, tax, name = _keys()
    keyed = mentions.select(domain.alias("d"), tax.alias("t"), name.alias("name")).where("coalesce(d, t) IS NOT NULL")
    pairs = keyed.select(F.coalesce("d", "t").alias("u"), F.coalesce("t", "d").alias("v")).distinct()
    labels = cut_lineage(connected_components(pairs))
    names = keyed.where("name IS NOT NULL").join(labels, F.coalesce("d", "t") == labels.node).select("name", "component").distinct()
    return labels, names


@dataclass
class Delta:
    """What new mentions change. Tables of the size of the change, but for the two that are joined with stored ones on use.

    resolved: the new mentions with their `component`. labels: `node, component` of new nodes. relabel: `old, component` of
    stored components that are now part of another. names: new pairs `name, component`. renamed: `name, component` of all
    names whose keyless mentions now belong elsewhere.
    """

    resolved: DataFrame
    labels: DataFrame
    relabel: DataFrame
    names: DataFrame
    renamed: DataFrame


def resolve_delta(labels: DataFrame, names: DataFrame, mentions: DataFrame) -> Delta:
    """Resolve new mentions against stored results without the stored mentions or their edges.

    Stored nodes that new mentions name stand for their whole component, so the graph has the edges of the new mentions alone. A
    component keeps its smallest node as its name, which is why the result is that of a full run. Keyless mentions that were
    given to a component by their name follow it in `renamed`.
    """
    domain, tax, name = _keys()
    keyed = cut_lineage(mentions.withColumns({"_d": domain, "_t": tax, "_n": name}).withColumn("_k", F.coalesce("_d", "_t")))
    pairs = keyed.where("_k IS NOT NULL").select("_k", F.coalesce("_t", "_d").alias("_v")).distinct()
    touched = pairs.select(F.explode(F.array("_k", "_v")).alias("node")).distinct()
    known = cut_lineage(labels.join(touched, "node", "left_semi"))
    at_u, at_v = known.select(F.col("node").alias("_k"), F.col("component").alias("_cu")), known.select(F.col("node").alias("_v"), F.col("component").alias("_cv"))
    edges = pairs.join(at_u, "_k", "left").join(at_v, "_v", "left").select(F.coalesce("_cu", "_k").alias("u"), F.coalesce("_cv", "_v").alias("v")).distinct()
    parts = cut_lineage(connected_components(edges))
    relabel = parts.join(known.select(F.col("component").alias("node")).distinct(), "node", "left_semi").where("node <> component").select(F.col("node").alias("old"), "component")
    fresh = touched.join(known.withColumnRenamed("component", "_old"), "node", "left").select("node", F.coalesce("_old", "node").alias("_at"), F.col("_old").isNull().alias("is_new"))
    placed = cut_lineage(fresh.join(parts.withColumnRenamed("node", "_at"), "_at").select("node", "component", "is_new"))
    by_key = keyed.where("_k IS NOT NULL").join(placed.select(F.col("node").alias("_k"), "component"), "_k")
    new_names = by_key.where("_n IS NOT NULL").select(F.col("_n").alias("name"), "component").distinct().join(names, ["name", "component"], "left_anti")
    # Names to look at again: those of new mentions, keyed or not, and those of components that moved.
    moved = names.join(relabel, names.component == relabel.old).select("name")
    asked = keyed.where("_n IS NOT NULL").select(F.col("_n").alias("name")).unionByName(moved).distinct()
    stored = names.join(asked, "name", "left_semi")
    now = stored.join(relabel.withColumnRenamed("component", "_to"), stored.component == F.col("old"), "left").select(
        "name", F.col("component").alias("was"), F.coalesce("_to", "component").alias("component"))
    both = now.unionByName(new_names.withColumn("was", F.lit(None).cast("string")))
    named = cut_lineage(both.groupBy("name").agg(F.min("was").alias("was"), F.min("component").alias("component")))
    by_name = keyed.where("_k IS NULL AND _n IS NOT NULL").join(named.select(F.col("name").alias("_n"), F.col("component").alias("_named")), "_n", "left").withColumn(
        "component", F.coalesce("_named", "_n")).drop("_named")
    resolved = by_key.unionByName(by_name).drop("_d", "_t", "_n", "_k")
    renamed = named.where("coalesce(was, name) <> component").select("name", "component")
    return Delta(resolved, placed.where("is_new").select("node", "component"), relabel, new_names, renamed)


def relabelled(stored: DataFrame, delta: Delta) -> DataFrame:
    """Stored resolved mentions with the components they have now. Both maps have the size of the change."""
    domain, tax, name = _keys()
    keyless = F.when(F.coalesce(domain, tax).isNull(), name)
    maps = delta.relabel.select(F.col("old").alias("_from"), F.col("component").alias("_to")).unionByName(
        delta.renamed.select(F.concat(F.lit("by name:"), F.col("name")).alias("_from"), F.col("component").alias("_to")))
    marked = stored.withColumn("_from", F.coalesce(F.concat(F.lit("by name:"), keyless), F.col("component")))
    return marked.join(maps, "_from", "left").withColumn("component", F.coalesce("_to", "component")).drop("_from", "_to")


def relabelled_state(labels: DataFrame, names: DataFrame, delta: Delta) -> tuple[DataFrame, DataFrame]:
    """The state after a delta, for the next one."""
    moved = delta.relabel.select(F.col("old").alias("component"), F.col("component").alias("_to"))

    def now(table: DataFrame) -> DataFrame:
        return table.join(moved, "component", "left").withColumn("component", F.coalesce("_to", "component")).select(*table.columns)
    return now(labels).unionByName(delta.labels), now(names).unionByName(delta.names).distinct()


def nameless(mentions: DataFrame) -> DataFrame:
    """Mentions that name no organization: no domain, tax code or name."""
    return mentions.where(F.coalesce(*_keys()).isNull())


def merge_organizations(resolved: DataFrame, fields: list[str], existing_id: str | None = None, compat: bool = False) -> DataFrame:
    """One row per component: latest non-null value per field by `verified_at` (ties: `mention_id`).

    `compat=True` takes every field of the last mention, nulls included. The id of a stored
    organization is kept; else it is derived from the component key.
    """
    order = F.struct("verified_at", "mention_id")
    if compat:
        latest = [F.max_by(F.struct(*fields), order).alias("_l")]
        picked = [F.col(f"_l.{f}").alias(f) for f in fields]
    else:
        latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
        picked = [F.col(f) for f in fields]
    kept = F.min(existing_id) if existing_id else F.lit(None).cast("string")
    merged = resolved.groupBy("component").agg(
        kept.alias("_id"), F.count("*").alias("mentions"), F.max("verified_at").alias("verified_at"), *latest)
    return merged.select("component", F.coalesce("_id", ids.keyed_id(F.col("component"))).alias("id"), "mentions", *picked, "verified_at")


def contact_rows(profiles: DataFrame) -> DataFrame:
    """Child contacts of profiles that carry `organization_id`; equal ids collapse to one row."""
    rows = profiles.select("organization_id", "verified_at", F.posexplode("contacts").alias("pos", "c")).select(
        ids.keyed_id(F.col("organization_id"), F.col("c.full_name"), F.col("c.raw_title"), F.col("c.source_url")).alias("id"),
        "organization_id", "pos", "c.*", "verified_at")
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("organization_id", "pos")).alias("f")).select("id", "f.*").drop("pos")


def evidence_rows(profiles: DataFrame) -> DataFrame:
    rows = profiles.select("organization_id", F.col("verified_at").alias("crawled_at"), F.posexplode("evidence").alias("pos", "e")).select(
        ids.keyed_id(F.col("organization_id"), F.col("e.field"), F.col("e.source_url"), F.col("e.evidence_text")).alias("id"),
        "organization_id", "pos", "e.*", "crawled_at")
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("organization_id", "pos")).alias("f")).select("id", "f.*").drop("pos")


def replace_children(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Children of the touched organizations are replaced, all others stay."""
    return stored.join(touched.select("organization_id").distinct(), "organization_id", "left_anti").unionByName(
        fresh, allowMissingColumns=True)
