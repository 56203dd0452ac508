"""Links of many pages at once: the tags of a batch are columns of numbers, and no page is walked.

For pages of plain markup, which closes its elements in order; the others are left to `html.Page`, with the same answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from opporta.functions.html import _DATED, _RAW_TEXT, VOID

FIELDS = frozenset({"position", "href", "near_date"})  # what is known of a link here

_BLANKS = r"[ \t\r\n\f]*"
_VALUE = r'"(?:[^"&<>\p{Z}\p{Cc}]| )*"'
# Text and tags that the standard parser reads as they stand; digits and white space beyond ASCII, and references that could hide some, are its own.
_PLAIN = (r"^(?:[^<&\p{Nd}\p{Z}\p{Cc}]|[0-9 \t\r\n\f]|&(?:amp|quot|lt|gt);|</[a-z][a-z0-9]{0,7}>"
          rf"|<[a-z][a-z0-9]{{0,7}}(?: [a-z][a-z0-9:_-]*={_VALUE})*>)*$")
# A date that begins before a tag and ends after it.
_TAGS = rf"{_BLANKS}(?:<[^>]*>{_BLANKS})+"
_TORN = rf"[0-9]{_TAGS}[0-9]?/|/(?:[0-9]{{0,2}}|[0-9]{{1,2}}/[0-9]{{3}}){_TAGS}[0-9/]"
_ONLY_HREF = np.frombuffer(b' href="', np.uint8)
_HREF = r'^(?: [^ =]+="[^"]*")* href="(?P<href>[^"]*)"'


def _key(name: str) -> int:
    return int.from_bytes(name.encode(), "little")


def _keys(names) -> np.ndarray:
    return np.array([_key(n) for n in sorted(names) if len(n) <= 8], np.uint64)


_VOID_KEYS, _RAW_KEYS, _DATED_KEYS, _A_KEY = _keys(VOID), _keys(_RAW_TEXT), _keys(_DATED), np.uint64(_key("a"))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The pieces of a text that stand from `start` to `end`."""
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[places]))


def _hrefs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The last `href` among the attributes that stand from `start` to `end`, or null."""
    only = (data[start[:, None] + np.arange(len(_ONLY_HREF))] == _ONLY_HREF).all(axis=1)
    quotes = np.append(np.flatnonzero(data == 34), len(data))
    first = start + len(_ONLY_HREF)
    only &= quotes[np.searchsorted(quotes, first)] == end - 1
    if only.all():
        return _strings(data, first, end - 1)
    href = _strings(data, np.where(only, first, 0), np.where(only, end - 1, 0))
    others = pc.struct_field(pc.extract_regex(_strings(data, start[~only], end[~only]), _HREF), "href")
    return pc.replace_with_mask(href, pa.array(~only), others)


def _levels(page: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Running sum of the steps of each page; `first`: where its tags begin."""
    total = np.cumsum(step)
    return total - np.concatenate([[0], total])[first][page]


def _dates(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where dates (d/m/yyyy) of the text outside tags start and end."""
    digit = (data >= 48) & (data <= 57)
    slash = np.flatnonzero(data == 47)
    slash = slash[digit[slash - 1] & digit[slash + 1]]
    if not len(slash):
        return slash, slash
    width = np.where(digit[slash + 2], 3, 2)
    second = slash + width
    good = data[second] == 47
    for k in range(1, 5):
        good &= digit[second + k]
    tag = np.searchsorted(begin, slash) - 1
    good &= (tag < 0) | (slash > end[tag])
    slash, second = slash[good], second[good]
    return slash - 1 - digit[slash - 2], second + 5


def plain_links(html: pa.StringArray, with_dates: bool = True) -> tuple[np.ndarray, pa.Table]:
    """Which pages were read, and their links: number of the page, position, href and the date near it."""
    html = html.cast(pa.string()).fill_null("")
    plain = pc.match_substring_regex(html, _PLAIN)
    if with_dates:
        plain = pc.and_not(plain, pc.match_substring_regex(html, _TORN))
    plain = plain.to_numpy(zero_copy_only=False)
    number = np.flatnonzero(plain)
    kept = html.take(pa.array(number))
    limits = np.frombuffer(kept.buffers()[1], np.int32)[kept.offset:kept.offset + len(kept) + 1].astype(np.int64) + 8
    # Eight bytes more on each side, so that a look around never leaves the text.
    data = np.zeros(limits[-1] + 8, np.uint8)
    if limits[-1] > limits[0]:
        data[limits[0]:limits[-1]] = np.frombuffer(kept.buffers()[2], np.uint8)[limits[0] - 8:limits[-1] - 8]

    begin, closing = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
    end = closing[np.searchsorted(closing, begin)]
    page = np.searchsorted(limits, begin, "right") - 1
    close = data[begin + 1] == 47
    key, alive, at = np.zeros(len(begin), np.uint64), np.ones(len(begin), bool), begin + 1 + close
    for k in range(8):
        letter = data[at + k]
        alive &= (letter != 32) & (letter != 62)
        key |= np.where(alive, letter, 0).astype(np.uint64) << np.uint64(8 * k)
    step = np.where(np.isin(key, _VOID_KEYS), 0, np.where(close, -1, 1))
    first = np.searchsorted(page, np.arange(len(number)))
    level = _levels(page, first, step)

    # Elements closed out of order: a level of a page holds opening and closing tags in turn, of one name each.
    odd = np.zeros(len(number), bool)
    odd[page[(level < 0) | np.isin(key, _RAW_KEYS)]] = True
    ends = np.append(first[1:], len(begin)) - 1
    some = ends >= first
    odd[some] |= level[ends[some]] != 0
    use = np.flatnonzero((step != 0) & ~odd[page])
    span = int(level.max(initial=0)) + 2
    use = use[np.argsort(page[use] * span + level[use] + close[use], kind="stable")]
    opened, closed = use[0::2], use[1::2]
    odd[page[opened[key[opened] != key[closed]]]] = True
    partner = np.zeros(len(begin), np.int64)
    partner[opened] = closed

    anchor = np.flatnonzero((key == _A_KEY) & ~close & ~odd[page])
    href = pc.utf8_trim(_hrefs(data, begin[anchor] + 2, end[anchor]), " ")
    filled = pc.fill_null(pc.not_equal(href, ""), False).to_numpy(zero_copy_only=False)
    anchor, href = anchor[filled], href.filter(pa.array(filled))
    owner = page[anchor]
    columns = {"page": pa.array(number[owner]), "position": pa.array((np.arange(len(owner)) - np.searchsorted(owner, owner)).astype(np.int32)), "href": href}
    if with_dates:
        dated = np.isin(key, _DATED_KEYS)
        inside = _levels(page, first, np.where(dated, step, 0))
        # The element an anchor stands in is the last one opened before it at its level.
        mixed = np.sort(np.concatenate([np.flatnonzero(dated & ~close & ~odd[page]), anchor]))
        mixed = mixed[np.argsort(page[mixed] * span + inside[mixed], kind="stable")]
        last = np.maximum.accumulate(np.where(dated[mixed], np.arange(len(mixed)), 0))
        row = np.zeros(len(begin), np.int64)
        row[mixed] = mixed[last] if len(mixed) else 0
        starts, stops = _dates(data, begin, end)
        row, within = row[anchor], inside[anchor] > 0
        found = np.searchsorted(starts, end[row])
        there = within & (found < len(starts))
        there[there] = stops[found[there]] <= begin[partner[row[there]]]
        near = _strings(data, starts[found[there]], stops[found[there]])
        columns["near_date"] = near.take(pa.array(np.cumsum(there) - 1, mask=~there))
    read = np.zeros(len(html), bool)
    read[number[~odd]] = True
    return read, pa.table(columns)
