"""One pass over raw pages: everything later jobs need from the HTML, as typed columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, StructType

from opporta.functions import link_batch
from opporta.functions.html import Page, published_values, tidy

PAGE_FIELDS = """h1 STRING, h1_spaced STRING, h1_title STRING, h1_heading STRING, h2 STRING, page_title STRING,
 title_block STRING, og_title STRING, description STRING, company STRING, json_ld ARRAY<STRING>,
 json_dates ARRAY<STRING>,
 metas ARRAY<STRUCT<marker: STRING, content: STRING>>, date_elements ARRAY<STRING>,
 links ARRAY<STRUCT<position: INT, href: STRING, resolved: STRING, text: STRING, in_chrome: BOOLEAN,
  block: INT, near_date: STRING>>, blocks ARRAY<STRING>, paragraphs ARRAY<STRING>,
 visible_text STRING, body_text STRING, parse_error STRING"""

LINK_FIELDS = "position INT, href STRING, resolved STRING, text STRING, in_chrome BOOLEAN, near_date STRING"

BATCH_PAGES = 200  # pages whose fields a task holds at once
BATCH_BYTES = 1 << 20  # and what is read at once of plain pages

CARD_FIELDS = """links ARRAY<STRUCT<resolved: STRING, text: STRING>>, title STRING, company STRING,
 card_text STRING, position INT, parse_error STRING"""


def _json_or_none(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def read_page(markup: str, base_url: str, wanted: frozenset[str] | None = None) -> dict:
    """The PAGE_FIELDS of one page; with `wanted`, only those."""
    page = Page(markup)
    heads, metas, scripts = page.elements("h1"), [page.nodes[i].attrs for i in page.elements("meta")], []

    def text_of(found, sep=""):
        return tidy(page.text(found[0], sep)) if found else None

    def head_with(*words):
        return [i for i in heads if any(w in page.nodes[i].attrs.get("class", "").lower() for w in words)]

    def json_ld():
        scripts.extend(page.text(i, "") for i in page.elements("script") if "ld+json" in page.nodes[i].attrs.get("type", "").lower())
        return scripts

    makers = {
        "h1": lambda: text_of(heads), "h1_spaced": lambda: text_of(heads, " "), "h1_title": lambda: text_of(head_with("title")),
        "h1_heading": lambda: text_of(head_with("title", "heading", "name")), "h2": lambda: text_of(page.elements("h2")),
        "page_title": lambda: text_of(page.elements("title")), "title_block": lambda: text_of(page.with_class(r"title|heading-detail")),
        "og_title": lambda: next((tidy(m.get("content")) for m in metas if m.get("property") == "og:title"), None),
        "description": lambda: next((m.get("content", "").strip() for m in metas if m.get("name") == "description"), None),
        "company": lambda: text_of(page.with_class(r"company-name|company_name"), " "), "json_ld": json_ld,
        "json_dates": lambda: [d for s in scripts for d in published_values(_json_or_none(s))],
        "metas": lambda: [{"marker": " ".join(m.get(k, "") for k in ("property", "name", "itemprop", "id")).lower(),
                           "content": tidy(m.get("content") or m.get("datetime"))} for m in metas],
        "date_elements": page.date_elements, "paragraphs": page.body_paragraphs, "visible_text": page.visible_text,
        "body_text": page.body_text,
    }
    out = {name: make() for name, make in makers.items() if wanted is None or name in wanted}
    if wanted is None or "links" in wanted:
        out["links"], out["blocks"] = page.anchors(base_url, wanted is None or "blocks" in wanted)
    return out


def read_cards(markup: str, base_url: str) -> list[dict]:
    page = Page(markup)
    links, _ = page.anchors(base_url, with_blocks=False)
    anchors = page.elements("a")
    by_node = dict(zip([i for i in anchors if page.nodes[i].attrs.get("href", "").strip()], links))
    cards = []
    for i in page.with_class(r"job-item"):
        inside = page.elements(within=i)
        titled = [n for n in inside if page.nodes[n].tag in ("h2", "h3")
                  or (page.nodes[n].tag == "a" and "title" in page.nodes[n].attrs.get("class", ""))
                  or (page.nodes[n].tag == "a" and page.ancestor(n, {"h3"}) is not None)]
        firm = page.with_class(r"company", within=i)
        cards.append({
            "links": [{"resolved": by_node[n]["resolved"], "text": by_node[n]["text"]} for n in inside if n in by_node],
            "title": tidy(page.text(titled[0], "")) if titled else None,
            "company": tidy(page.text(firm[0], "")) if firm else None,
            "card_text": tidy(page.text(i, " | ")), "position": len(cards), "parse_error": None})
    return cards


def with_page_fields(raw: DataFrame, keep: list[str], wanted: tuple[str, ...] | None = None) -> DataFrame:
    """`keep` columns plus PAGE_FIELDS, or the `wanted` ones of them, and `parse_error`.

    A page that cannot be read gets `parse_error`, never a failed task. Rows leave in small batches, so that memory follows the
    pages of one, not those of an input batch.
    """
    kept = raw.select(*dict.fromkeys([*keep, "url", "html"]))
    passed = [c for c in kept.columns if c != "html" or "html" in keep]
    only = None if wanted is None else frozenset(wanted)
    fields = [f for f in StructType.fromDDL(PAGE_FIELDS).fields if only is None or f.name in only or f.name == "parse_error"]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(f for f in kept.schema if f.name in passed), *fields])
    kinds = {f.name: _arrow_type(f.dataType) for f in fields}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(start, BATCH_PAGES)
                rows = []
                for url, markup in zip(part["url"].to_pylist(), part["html"].to_pylist(), strict=True):
                    try:
                        rows.append(read_page(markup or "", url or "", only))
                    except Exception as exc:  # a bad page is data, not a reason to stop the job
                        rows.append({"parse_error": f"{type(exc).__name__}: {exc}"})
                made = [pa.array([r.get(name) for r in rows], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in passed), *made], [*passed, *kinds])

    return kept.mapInArrow(walk, head)


def with_links(raw: DataFrame, keep: list[str], wanted: tuple[str, ...]) -> DataFrame:
    """One row per link of a page: `keep` columns and the `wanted` ones of LINK_FIELDS. A page that cannot be read has no links.

    Pages are taken by about a megabyte. Plain ones are read all at once where that gives every wanted field.
    """
    keep = list(dict.fromkeys(keep))
    kept = raw.select(*dict.fromkeys([*keep, "url", "html"]))
    fields = [f for f in StructType.fromDDL(LINK_FIELDS).fields if f.name in wanted]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(f for f in kept.schema if f.name in keep), *fields])
    kinds = {f.name: _arrow_type(f.dataType) for f in fields}

    def rows(pages: pa.RecordBatch, owner: pa.Array, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pages[c].take(owner) for c in keep), *columns], [*keep, *kinds])

    def walked(pages: pa.RecordBatch) -> pa.RecordBatch:
        owner, found = [], []
        for n, (url, markup) in enumerate(zip(pages["url"].to_pylist(), pages["html"].to_pylist(), strict=True)):
            try:
                links = Page(markup or "").anchors(url or "", with_blocks=False, fields=kinds)[0]
            except Exception:  # a bad page is data, not a reason to stop the job
                continue
            owner += [n] * len(links)
            found += links
        return rows(pages, pa.array(owner, pa.int32()), [pa.array([link[name] for link in found], kind) for name, kind in kinds.items()])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch["html"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                part = batch.slice(start, stop - start)
                if link_batch.FIELDS >= set(kinds):
                    read, table = link_batch.plain_links(part["html"], "near_date" in kinds)
                    yield rows(part, table["page"].combine_chunks(), [table[name].combine_chunks() for name in kinds])
                    part = part.filter(pa.array(~read))
                for first in range(0, part.num_rows, BATCH_PAGES):
                    yield walked(part.slice(first, BATCH_PAGES))

    return kept.mapInArrow(walk, head)


def _arrow_type(kind: DataType) -> pa.DataType:
    """Arrow form of the types in PAGE_FIELDS."""
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[kind.simpleString()]


def with_cards(raw: DataFrame) -> DataFrame:
    """One row per job card of each listing page."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["listing_url", "fetched_at"] + [part.split()[0] for part in _field_names(CARD_FIELDS)]
        for batch in batches:
            rows = []
            for url, fetched, markup in zip(batch["url"], batch["fetched_at"], batch["html"]):
                try:
                    cards = read_cards(markup or "", url or "")
                except Exception as exc:
                    cards = [{"parse_error": f"{type(exc).__name__}: {exc}"}]
                rows += [{"listing_url": url, "fetched_at": fetched, **card} for card in cards]
            yield pd.DataFrame(rows, columns=names)

    return raw.select("url", "fetched_at", "html").mapInPandas(
        walk, f"listing_url STRING, fetched_at TIMESTAMP_NTZ, {CARD_FIELDS}")


def _field_names(ddl: str) -> list[str]:
    """Top-level fields of a DDL string: commas inside <...> do not split."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append((ddl + ",")[start:i].strip())
            start = i + 1
    return out
