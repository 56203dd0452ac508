"""Merkle manifest of a table: leaf digests, one tree per source, one tree over the sources, and a proof for every row.

Leaves are ranked inside their source. The digits of a rank in base 16 are grouped away one after another, the last one
first, and each step nests the structs of the step before, so one row in the end holds a block of 4,096 leaves with all
digests between. One exchange by (source, block) serves all three steps. Block heads are the leaves of the next layer, and
the roots of the sources those of the last tree. Proofs are made by a transform over the nested structs of a block and an
explode; no leaf takes part in a join. What a whole block shares (its path above and the root) reaches it by one join of
block rows a layer, one row for 4,096 leaves.

Defined results: null fields are `-`; a null source is a source of its own and comes first; null ids come first in their
source, equal ids are ordered by leaf, equal rows by where they were written; a row whose tampering changes nothing keeps its
leaf. An empty table has no rows and no root. Only the named columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opporta.llm import common
from opporta.operators.ordering import with_row_number

FAN, DIGITS = 16, 3
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values' lengths and UTF-8 bytes, null as `-`."""
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[told(v) for v in values]), 256)


def _nested(nodes: DataFrame) -> DataFrame:
    """Nodes `g, rank, h, item` as blocks `g, block, lone, hs, h, kids`; `lone`: nothing is hashed, the only child passes.

    A run is the only node of its level if it is the first one and has one child.
    """
    digits = [F.expr(f"rank div {BLOCK}").alias("block"),
              *[F.expr(f"cast(rank div {FAN**k} % {FAN} AS int)").alias(f"d{k}") for k in range(DIGITS)]]
    at = nodes.select("g", *digits, "h", "item").repartition("g", "block")
    keys, child = ["block", *[f"d{k}" for k in range(DIGITS - 1, 0, -1)]], ["h", "item"]
    for k in range(DIGITS):
        at = at.groupBy("g", *keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), *child))).alias("kids"))
        first = F.lit(True)
        for key in keys:
            first = first & (F.col(key) == 0)
        at = at.withColumn("lone", first & (F.size("kids") == 1)).withColumn("hs", F.col("kids.h"))
        at = at.withColumn("h", F.when(F.col("lone"), F.element_at("hs", 1)).otherwise(F.sha2(F.array_join("hs", ""), 256)))
        keys, child = keys[:-1], ["h", "lone", "hs", "kids"]
    return at


def _step(hs: Column, lone: Column, i: Column) -> Column:
    return F.struct((~lone).alias("live"), F.array_join(F.slice(hs, F.lit(1), i), "").alias("before"),
                    F.array_join(F.slice(hs, i + 2, F.lit(FAN)), "").alias("after"))


def _opened(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row for each node under `blocks`, which carry `path` from their head upwards: `g, rank, item, h, path` and `keep`."""
    def grand(a: Column, i: Column) -> Column:
        def child(b: Column, j: Column) -> Column:
            def leaf(c: Column, k: Column) -> Column:
                steps = F.array(_step(b["hs"], b["lone"], k), _step(a["hs"], a["lone"], j), _step(F.col("hs"), F.col("lone"), i))
                return F.struct(((i * FAN + j) * FAN + k).alias("at"), c["item"].alias("item"), c["h"].alias("h"), steps.alias("steps"))
            return F.transform(b["kids"], leaf)
        return F.flatten(F.transform(a["kids"], child))
    rows = blocks.select("g", "block", "path", *keep, F.explode(F.flatten(F.transform("kids", grand))).alias("x"))
    own = F.transform(F.filter("x.steps", lambda s: s["live"]), lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after")))
    return rows.select("g", (F.col("block") * BLOCK + F.col("x.at")).alias("rank"), "x.item", "x.h", F.concat(own, "path").alias("path"), *keep)


def _grown(nodes: DataFrame, what: str) -> list[DataFrame]:
    """Layers of blocks, written, until every group has one head."""
    layers = []
    while True:
        layers.append(common.stored(_nested(nodes), f"merkle-{what}"))
        heads = layers[-1].select("g", F.col("block").alias("rank"), "h", F.lit(None).cast("int").alias("item"))
        if heads.where("rank > 0").isEmpty():
            return layers
        nodes = heads


def _paths(layers: list[DataFrame], above: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Walk from the heads, `above(g, path, ..keep)`, down to the nodes that the first layer was grown from."""
    up = above.withColumn("block", F.lit(0).cast("bigint"))
    for layer in reversed(layers):
        rows = _opened(layer.join(up, ["g", "block"]), keep)
        up = rows.select("g", F.col("rank").alias("block"), "path", *keep)
    return rows


def proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
           found: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of `docs`: `<order>, leaf, found_leaf, path, subroot, root`.

    `path` lists, from the leaf to the root, the digests before and after the own one in its run, each concatenated.
    `found` gives fields as they are read later; `found_leaf` is the leaf of those values.
    """
    now = found or {}
    value = {f: F.col(f"`{f}`") for f in fields}
    g = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))  # null first, then by bytes
    leaves = docs.select(g.alias("g"), F.col(f"`{order}`").alias("id"), digest([value[f] for f in fields]).alias("h"),
                         digest([now.get(f, value[f]) for f in fields]).alias("found"), F.monotonically_increasing_id().alias("row"))
    leaves = common.stored(leaves, "merkle-leaves")
    ranked = with_row_number(leaves, ["g"], ["id", "h", "row"], "rank")
    layers = _grown(ranked.select("g", (F.col("rank") - 1).alias("rank"), "h", F.struct("id", F.nullif("found", "h").alias("found")).alias("item")), "rows")
    subroots = common.stored(layers[-1].select("g", "h"), "merkle-subroots")
    over = with_row_number(subroots, [], ["g"], "rank").select(F.lit("").alias("g"), (F.col("rank") - 1).alias("rank"), "h", F.col("g").alias("item"))
    tops = _grown(over, "groups")
    step = "array<struct<before:string,after:string>>"
    head = tops[-1].select("g", F.array().cast(step).alias("path"), F.col("h").alias("root"))
    groups = _paths(tops, head, ["root"]).select(F.col("item").alias("g"), "path", F.col("h").alias("subroot"), "root")
    rows = _paths(layers, common.stored(groups, "merkle-paths"), ["subroot", "root"])
    return rows.select(F.col("item.id").alias(order), F.col("h").alias("leaf"), F.coalesce("item.found", "h").alias("found_leaf"), "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, p: F.sha2(F.concat(p["before"], own, p["after"]), 256))


def report(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, every fifth (by CRC of the id) checked against a text whose capitals were lowered."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = proofs(docs, found={"text": tampered})
    again = rows.select("doc_id", "leaf", "subroot", "root",
                        F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""), 256).alias("proof_sha256"),
                        folded(F.col("found_leaf"), F.col("path")).alias("folded_root"))
    return again.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(depth: int = 5, top: int = 4) -> str:
    """SQL for up to 16 ** depth rows in a source and 16 ** top sources."""
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    parts = [f"""doc AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS found FROM documents)""",
             "a0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM doc)"]

    def level(name: str, k: int, group: str) -> None:
        parts.append(f"""{name}{k} AS (SELECT {group} r // 16 AS r, CASE WHEN max(many) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h
  FROM (SELECT *, count(*) OVER ({'PARTITION BY g' if group else ''}) AS many FROM {name}{k - 1}) GROUP BY ALL)""".replace("GROUP BY ALL", f"GROUP BY {group} r // 16"))

    def beside(name: str, k: int, group: str) -> None:
        window = f"PARTITION BY {group} r // 16 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND"
        parts.append(f"""{name}p{k} AS (SELECT {group} r, coalesce(string_agg(h, '') OVER ({window} 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER (PARTITION BY {group} r // 16 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f, count(*) OVER ({'PARTITION BY g' if group else ''}) > 1 AS live FROM {name}{k})""")
    for k in range(1, depth + 1):
        level("a", k, "g,")
    parts.append(f"s0 AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS r FROM a{depth})")
    for k in range(1, top + 1):
        level("s", k, "")
    for k in range(depth):
        beside("a", k, "g,")
    for k in range(top):
        beside("s", k, "")
    parts.append("t0 AS (SELECT a0.doc_id, a0.leaf, a0.g, a0.r, s0.r AS sr, s0.h AS subroot, found AS x, '' AS proof FROM a0 JOIN s0 USING (g))")
    steps = [(f"ap{k}", f"p.g = t.g AND p.r = t.r // {16**k}") for k in range(depth)] + [(f"sp{k}", f"p.r = t.sr // {16**k}") for k in range(top)]
    for k, (table, on) in enumerate(steps):
        parts.append(f"t{k + 1} AS (SELECT doc_id, leaf, t.g, t.r, sr, subroot, CASE WHEN live THEN sha256(b || x || f) ELSE x END AS x, CASE WHEN live THEN proof || b || f ELSE proof END AS proof FROM t{k} t JOIN {table} p ON {on})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = h AS verified FROM t{len(steps)}, s{top}"""


ORACLE_SQL = _oracle()
