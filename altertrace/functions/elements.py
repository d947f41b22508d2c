"""XES traces from their text and as text, whole Arrow batches at once.

A text holds what stands before the end of one trace. Plain texts are read by NumPy: tags lie between the places of ``<``, and their
attributes between quotes, so no byte is looked at by Python. A text that is not plain (entities, comments, other quotes, attributes
or elements, lists, wrong nesting) is read by expat. Both give the same entries, in the same order of precedence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS = ("string", "date", "int", "float", "boolean", "id")
#: Elements that have no value of their own, only attributes.
HOLDERS = ("list", "container")
END = b"</trace>"
#: Bytes of texts that are read at once.
SLICE = 4 << 20

_ENTRY = pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("text", pa.string())]))
SCHEMA = pa.schema([("case", _ENTRY), ("pos", pa.int64()), ("event", _ENTRY), ("unsure", pa.bool_())])

_DAY = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|1\d|2[0-8]))"
#: Texts that are certainly of their kind; all others are left to the cast.
SURE = {
    "date": rf"^[12]\d{{3}}-{_DAY}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{{1,6}})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)$",
    "int": r"^-?\d{1,18}$",
    "float": r"^-?\d+(?:\.\d+)?$",
    "boolean": r"^(?:true|false)$",
}

_TRACE, _EVENT = len(KINDS), len(KINDS) + 1
_NAMES = [n.encode() for n in (*KINDS, "trace", "event")]
_BLANKS = "".join(map(chr, range(33)))


def _word(name: bytes) -> tuple[np.uint64, np.uint64]:
    """The bytes of a short name as a number, and the bits they take."""
    return np.uint64(int.from_bytes(name, "little")), np.uint64((1 << 8 * len(name)) - 1)


def _gathered(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the buffer as strings, and their bytes."""
    ends = np.cumsum(size)
    held = buf[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(held)), held


def _trimmed(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without blanks at both ends."""
    while (blank := (start < stop) & (buf[start] <= 32)).any():
        start = start + blank
    while (blank := (start < stop) & (buf[stop - 1] <= 32)).any():
        stop = stop - blank
    return start, stop


def _between(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of several ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)


def _last(open_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(open_, places, -1))


def _maps(offsets: np.ndarray, key: pa.Array, kind: pa.Array, text: pa.Array) -> pa.Array:
    items = pa.StructArray.from_arrays([kind, text], names=["kind", "text"])
    return pa.MapArray.from_arrays(pa.array(offsets.astype(np.int32)), key, items)


def plain(data: bytes | np.ndarray, bounds: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of the plain texts, and which texts are not plain. Text i is ``data[bounds[i]:bounds[i + 1]]``."""
    n_rows = len(bounds) - 1
    buf = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    at = np.flatnonzero(buf == 60)  # <
    row = np.searchsorted(bounds, at, "right") - 1
    odd = np.zeros(n_rows, dtype=bool)
    odd[row[(buf[at + 1] == 33) | (buf[at + 1] == 63)]] = True  # <! and <? may hide any tag
    amp = np.flatnonzero(buf == 38)
    odd[np.searchsorted(bounds, amp, "right") - 1] = True
    closing = buf[at + 1] == 47
    name_at = at + 1 + closing
    word, name, width = words[name_at], np.full(len(at), -1), np.zeros(len(at), dtype=np.int64)
    for i, n in enumerate(_NAMES):
        code, mask = _word(n)
        found = (word & mask) == code
        name[found], width[found] = i, len(n)
    name_end = name_at + width
    after = buf[name_end]
    name[~((after <= 32) | (after == 47) | (after == 62))] = -1
    # a text begins with its first trace; what stands before belongs to the log
    begins = (name == _TRACE) & ~closing
    first = np.full(n_rows, len(at))
    np.minimum.at(first, row[begins], np.flatnonzero(begins))
    used = (np.arange(len(at)) >= first[row]) & ~odd[row]
    if not used.any():
        return _none(), odd
    at, row, closing, name, name_end, after = (x[used] for x in (at, row, closing, name, name_end, after))
    until = np.append(at[1:], 0)
    ends_row = np.append(row[1:] != row[:-1], True)
    until[ends_row] = bounds[row[ends_row] + 1]
    quote = np.flatnonzero(buf == 34)
    q = np.searchsorted(quote, at)
    n_quotes = np.searchsorted(quote, until) - q
    attr = (name >= 0) & (name < len(KINDS)) & ~closing
    quote = np.append(quote, np.zeros(4, dtype=quote.dtype))
    q0, q1, q2, q3 = (quote[q + i] for i in range(4))
    (key, key_bits), (value, value_bits) = _word(b' key="'), _word(b' value="')
    has = attr & (n_quotes == 4) & (q0 - 5 == name_end) & ((words[name_end] & key_bits) == key) & (q2 - 7 == q1 + 1) & ((words[q1 + 1] & value_bits) == value)
    tail = np.where(has, q3 + 1, name_end)
    tail = tail + (has & (buf[tail] == 32))
    closed = has & (buf[tail] == 47)  # />
    tail = tail + closed
    good = (has | ((n_quotes == 0) & (name >= 0) & (~attr | closing))) & (buf[tail] == 62)
    text = np.cumsum(buf > 32, dtype=np.int32)  # only blanks may stand between tags
    good &= text[tail] == text[until - 1]
    # levels: a trace is 0, an event or an attribute of the trace 1, attributes of events 2, those inside them 3
    delta = np.where(closing, -1, np.where(closed, 0, 1))
    depth = np.cumsum(delta)
    starts_row = np.append(True, row[1:] != row[:-1])
    depth -= np.repeat((depth - delta)[starts_row], np.diff(np.append(np.flatnonzero(starts_row), len(row))))
    level = np.where(closing | closed, depth, depth - 1)
    good &= (level >= 0) & (level <= 3) & ((level == 0) == (name == _TRACE)) & ((name != _EVENT) | (level == 1)) & (~ends_row | (depth == 1)) & ~((name == _TRACE) & closing)
    places, opens = np.arange(len(at)), ~closing & ~closed
    above = [_last(opens & (level == i), places) for i in range(3)]  # 3 only closes itself
    inner = _last(opens & (level == 3), places)
    for i, last in enumerate([*above, inner]):
        x = np.flatnonzero(closing & (level == i))
        good[x] &= name[last[x]] == name[x]
    in_event = (level >= 2) & (name[above[1]] == _EVENT)
    good &= ~((level == 3) & ~in_event)  # more than one below another
    odd[row[~good]] = True
    if odd.any():
        # what is left out still moves no other text: places of parents stay those of all tags
        good = ~odd[row]
    else:
        good = np.ones(len(at), dtype=bool)
    a = np.flatnonzero(good & attr)
    key_start, key_stop = _trimmed(buf, q0[a] + 1, q1[a])
    text_start, text_stop = _trimmed(buf, q2[a] + 1, q3[a])
    keys, key_bytes = _gathered(buf, key_start, key_stop - key_start)
    texts, text_bytes = _gathered(buf, text_start, text_stop - text_start)
    if (key_bytes < 32).any() or (text_bytes < 32).any():  # blanks that a parser changes
        low = np.concatenate([[0], np.cumsum(buf < 32)])
        again = odd.copy()
        again[row[a[(low[key_stop] > low[key_start]) | (low[text_stop] > low[text_start])]]] = True
        kept = np.flatnonzero(~again)
        size = (bounds[1:] - bounds[:-1])[kept]
        batch, more = plain(buf[_between(buf, bounds[:-1][kept], size)], np.concatenate([[0], np.cumsum(size)]))
        again[kept[more]] = True
        return batch, again
    coded = keys.dictionary_encode()
    known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    kind, in_event, level_a = name[a], in_event[a], level[a]
    below = (level_a == 3) | ((level_a == 2) & ~in_event)
    parent = np.where(level_a == 3, above[2][a], above[1][a])
    if below.any():
        place_of = np.zeros(len(at), dtype=np.int64)
        place_of[a] = np.arange(len(a))
        pair = code[place_of[parent[below]]] * len(known) + code[below]
        found, back = np.unique(pair, return_inverse=True)
        number = {k: i for i, k in enumerate(known)}
        names = [f"{known[p // len(known)]}/{known[p % len(known)]}" for p in found.tolist()]
        code[below] = np.array([number.setdefault(n, len(number)) for n in names])[back]
        known = list(number)
    events = np.flatnonzero(good & (name == _EVENT) & ~closing)
    event_row = row[events]
    # elements: the cases of all texts, then the events
    element = np.where(in_event, n_rows + np.searchsorted(events, above[1][a]), row[a])
    held = element * len(known) + code
    picked = np.arange(len(a))
    if np.unique(held).size < held.size:  # of repeated keys the first counts: by kind, an attribute before those inside its kind
        outer = np.where(below, kind_of(name, parent), kind)
        order = np.lexsort((picked, np.where(below, kind, 0), np.where(below, parent, 0), below, outer, element))
        picked = np.sort(order[np.unique(held[order], return_index=True)[1]])
    sure = np.ones(len(a), dtype=bool)
    for k, pattern in SURE.items():
        x = np.flatnonzero(kind == KINDS.index(k))
        if x.size:
            sure[x] = pc.match_substring_regex(texts.take(pa.array(x)), pattern).to_numpy(zero_copy_only=False)
    unsure = np.bincount(element[~sure], minlength=n_rows + len(events)) > 0
    names, kinds = pa.array(known, pa.string()), pa.array(KINDS)

    def maps(entries, counts):
        x = pa.array(entries)
        return _maps(np.concatenate([[0], np.cumsum(counts)]), names.take(pa.array(code[entries])), kinds.take(pa.array(kind[entries])), texts.take(x))

    own, case = picked[element[picked] >= n_rows], picked[element[picked] < n_rows]
    n_case = np.bincount(element[case], minlength=n_rows)
    case_at = np.concatenate([[0], np.cumsum(n_case)])[:-1]
    of_case = maps(case[_between(case, case_at[event_row], n_case[event_row])], n_case[event_row])
    of_event = maps(own, np.bincount(element[own] - n_rows, minlength=len(events)))
    begins = np.searchsorted(event_row, event_row)
    doubt = unsure[n_rows:] | unsure[event_row]
    return pa.record_batch([of_case, pa.array(np.arange(len(events)) - begins), of_event, pa.array(doubt)], schema=SCHEMA), odd


def kind_of(name: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(place >= 0, name[place], 0)


def _none() -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=SCHEMA)


_OUTSIDE = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|(<!--|<!\[CDATA\[|<\?)|(<trace(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)|(</trace\s*>)", re.DOTALL)


def cut_traces(text: bytes) -> tuple[list[bytes], bool]:
    """The traces in a text, and whether it ends inside a comment or the like."""
    out, start = [], None
    for m in _OUTSIDE.finditer(text):
        if m[1]:
            return out, True
        if m[2] and start is None and not m[2].endswith(b"/>"):
            start = m.start()
        elif m[3] and start is not None:
            out.append(text[start : m.end()])
            start = None
    return out, False


class Node:
    __slots__ = ("name", "key", "value", "below")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.below = name, []
        self.key, self.value = (None if (v := attributes.get(k)) is None else v.strip(_BLANKS) for k in ("key", "value"))

    def named(self, name: str) -> list[Node]:
        return [x for x in self.below if x.name == name]


def tree(text: bytes) -> Node | None:
    """The element of a text; none if it is not well-formed."""
    root = Node("", {})
    open_ = [root]

    def start(name, attributes):
        node = Node(name, attributes)
        open_[-1].below.append(node)
        open_.append(node)

    parser = expat.ParserCreate("UTF-8")
    parser.StartElementHandler, parser.EndElementHandler = start, lambda name: open_.pop()
    try:
        parser.Parse(text, True)
    except expat.ExpatError:
        return None
    return root.below[0]


def entries(node: Node) -> list[tuple[str, tuple[str, str | None]]]:
    """All attributes of an element, those inside others too; of repeated keys the first counts."""
    inside = lambda x, key: [("/".join(k for k in (key, c.key) if k is not None), i, c.value) for i in KINDS for c in x.named(i)]
    found = []
    for k in KINDS:
        own = node.named(k)
        found += [(x.key, k, x.value) for x in own if x.key is not None]
        found += [e for x in own for e in inside(x, x.key)]
    for k in HOLDERS:
        for x in node.named(k):
            found += inside(x, x.key) + [e for v in x.named("values")[-1:] for e in inside(v, x.key)]
    out: dict[str, tuple[str, str | None]] = {}
    for key, kind, text in found:
        out.setdefault(key, (kind, text))
    return [(key, {"kind": kind, "text": text}) for key, (kind, text) in out.items()]


def rows(text: bytes) -> list[dict]:
    """The rows of one trace."""
    node = tree(text)
    if node is None:
        return []
    case = entries(node)
    return [{"case": case, "pos": i, "event": entries(e), "unsure": True} for i, e in enumerate(node.named("event"))]


def read(texts: Iterator[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows of traces from texts that their ends have been cut from; texts follow each other as in their file."""
    rest = b""  # of a text that ended inside a comment: the next one goes on with it
    for column in texts:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if not len(column) or offsets[0] == offsets[-1]:
            continue
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
            part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
            text = lambda i: part[bounds[i] : bounds[i + 1]].tobytes() + END  # noqa: B023, E731
            upto = 0 if rest else len(bounds) - 1
            hides = np.flatnonzero((part[:-1] == 60) & ((part[1:] == 33) | (part[1:] == 63)))
            for i in np.unique(np.searchsorted(bounds, hides, "right") - 1)[: upto or 0]:
                if cut_traces(text(i))[1]:
                    upto = int(i)
                    break
            batch, odd = plain(part[: bounds[upto]], bounds[: upto + 1])
            if batch.num_rows:
                yield batch
            out = []
            for i in [*np.flatnonzero(odd).tolist(), *range(upto, len(bounds) - 1)]:
                traces, open_ = cut_traces(rest + text(i))
                rest = rest + text(i) if open_ else b""
                if not open_:
                    out += [r for t in traces for r in rows(t)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
    if rest:
        raise ValueError("an XES file ends inside a comment, or was cut there to be read by several tasks")


def counted(batches: Iterator[pa.RecordBatch], scopes: Sequence[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """How many rows of a task have each key with each kind; a batch has lists of keys and of kinds for each scope."""
    names = ["scope", "key", "kind", "n"]
    seen: Counter[tuple[str, str, str]] = Counter()

    def out():
        columns = [*zip(*seen)] or [(), (), ()]
        return pa.record_batch([*(pa.array(c, pa.string()) for c in columns), pa.array(seen.values(), pa.int64())], names=names)

    for b in batches:
        for i, scope in enumerate(scopes):
            pair = pa.table([b.column(2 * i).flatten(), b.column(2 * i + 1).flatten()], names=["key", "kind"])
            n = pair.group_by(["key", "kind"]).aggregate([([], "count_all")])
            for key, kind, count in zip(*(n.column(c).to_pylist() for c in ("key", "kind", "count_all"))):
                seen[scope, key, kind] += count
        if len(seen) > most:
            yield out()
            seen.clear()
    yield out()


HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<log>\n'
FOOT = "</log>"
#: Events whose text is made at once, and bytes of a file (a trace that is larger has one of its own).
EVENTS_AT_ONCE, FILE_BYTES = 20_000, 32 << 20

_SPECIAL = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}


def escaped(texts: pa.Array) -> pa.Array:
    """Texts as they stand between quotes in XML."""
    if not pc.any(pc.match_substring_regex(texts, r'[\x00-\x1f&<>"]')).as_py():
        return texts
    if pc.any(pc.match_substring_regex(texts, r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).as_py():
        raise ValueError("a text has a character that XML cannot hold")
    for c, entity in _SPECIAL.items():
        texts = pc.replace_substring(texts, c, entity)
    return texts


def joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def tags(attributes: dict[str, str], texts: dict[str, pa.Array]) -> list[pa.Array]:
    """The elements of attributes, given with their kinds and texts; ``parent/child`` stands inside its parent, and nulls are left out."""
    inside = {n: [c for c in attributes if c.rpartition("/")[0] == n] for n in attributes}
    children = {c for below in inside.values() for c in below}

    def element(name: str, key: str, below: list[str]) -> pa.Array:
        begin = f'<{attributes[name]} key="{escaped(pa.array([key]))[0]}" value="'
        parts = [element(c, c.rpartition("/")[2], []) for c in below]
        end = ['">', *parts, f"</{attributes[name]}>"] if parts else ['"/>']
        return pc.fill_null(joined(begin, escaped(texts[name]), *end), "")

    return [element(n, n, inside[n]) for n in attributes if n not in children]


def traces(case: dict[str, pa.Array], events: pa.Array, case_kinds: dict[str, str], kinds: dict[str, str]) -> pa.Array:
    """The elements of traces: texts of the attributes of their cases, and lists of those of their events."""
    flat = dict(zip(kinds, events.flatten().flatten()))
    each = joined("<event>", *tags(kinds, flat), "</event>\n")
    size = pc.fill_null(pc.list_value_length(events), 0).to_numpy()
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), each)
    return joined("<trace>", *tags(case_kinds, case), "\n", pc.binary_join(lists, ""), "</trace>\n")


def files(batches: Iterator[pa.RecordBatch], case_kinds: dict[str, str], kinds: dict[str, str], most: int) -> Iterator[pa.RecordBatch]:
    """Whole files of at most ``most`` traces, one in a row; a batch has the texts of cases and last those of their events."""
    held, n, size = [], 0, 0

    def file():
        return pa.record_batch([pa.array([HEAD + "".join(held) + FOOT])], names=["value"])

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(b.num_columns - 1)), 0).to_numpy())
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EVENTS_AT_ONCE, "right")))
            part = b.slice(lo, hi - lo)
            lo = hi
            case = dict(zip(case_kinds, part.columns[:-1]))
            for t in traces(case, part.column(b.num_columns - 1), case_kinds, kinds).to_pylist():
                if held and (n >= most or size + len(t) > FILE_BYTES):
                    yield file()
                    held, n, size = [], 0, 0
                held.append(t)
                n, size = n + 1, size + len(t)
    if held:
        yield file()
