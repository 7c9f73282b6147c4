"""Suffix-array dedup: bytes covered by a long string that a document with a smaller id holds, too, are removed.

Sorting the suffixes of a whole corpus in one place does not scale, so strings that may be equal are first brought together. Each window of
LENGTH bytes has an anchor, the place of its smallest hashed k-gram, which depends on the window's content alone; windows with one anchor
make a span, and equal windows lie in spans of one k-gram. That is all that hashes decide. Which windows are equal is told by
deep-shallow sorting of the suffixes in the spans' texts: a radix step on two bytes, multikey quicksort by words to a shallow depth,
blind tries for groups of longer common prefixes. Of equal windows, those of larger documents are covered.

It is done twice. First each batch of documents for itself, for k-grams that occur in it more than once: what a smaller document of the batch
covers travels on as intervals and is not sent any more, so that a text with many copies leaves a batch once. Then, for k-grams that are in several
batches, the texts of the spans that are left are brought together. Spans of equal bytes (compared as bytes) are sorted as one.
Spans of a k-gram that is in many different spans (HOT) are spread by their own hash, and their windows by theirs, so that no
key gathers them.

A null text is empty. A null id counts as larger than all ids. Rows with equal ids do not cover each other. Every byte is
judged on the input. Empty tables give empty results; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import Rolling, bounded, dealt, drop_saved, hot_from, mixed, runs_of, saved, step_entries, text_chunks

#: Bytes of a string that counts as repeated, and of the k-gram at its anchor.
LENGTH, GRAM = 50, 20
#: Spans of a batch, and of a bucket in the mean, at least and at most (some 100 bytes of a task's memory each).
LEAST_ENTRIES, MOST_ENTRIES = 1 << 20, 1 << 22
#: Different spans of a k-gram in a batch from which it is hot, at least (see common.hot_from); bytes of one text looked at together.
HOT, SEGMENT = 32, 1 << 20
#: Spans whose text is compared in one bucket, in the mean; a k-gram with an eighth of them is hot, too.
BUCKET_SPANS = 30_000
#: Bytes that multikey quicksort compares; longer common prefixes are left to blind tries.
SHALLOW = 32
#: Texts and what is asked of them that are looked at together.
TEXT_BYTES = 8 << 20
LAST = (1 << 63) - 1
HASH = np.uint64(16)


# ---- spans


def spans(data: np.ndarray, offs: np.ndarray, rolling: Rolling, length: int = LENGTH, gram: int = GRAM):
    """Of each run of windows with one anchor: the k-gram's hash, the span's hash, its text, its start in the text, and its last window's distance."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    rolling.over(data)
    value = mixed((rolling.sums[gram:] - rolling.sums[: n - gram + 1]) * rolling.inverse[: n - gram + 1])
    grams = value
    place = np.arange(len(value), dtype=np.int32)
    width, size = length - gram + 1, 1
    while size < width:  # the rightmost least of ever wider stretches
        step = min(size, width - size)
        right = value[step:] <= value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        size += step
    ends = np.repeat(offs[1:], np.diff(offs))[: len(place)]
    window = np.flatnonzero(np.arange(len(place)) + length <= ends)
    anchor = place[window]
    if not len(window):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1))))
    first, last, at = window[new], window[np.append(new[1:], len(window)) - 1], anchor[new].astype(np.int64)
    whole = mixed(rolling.of(first, last + length) + (at - first).astype(np.uint64))
    text = np.searchsorted(offs, first, "right") - 1
    return grams[at], whole, text, first - offs[text], last - first


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal ones in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of integers, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


#: kinds: 0 spans, 1 spans of a hot k-gram, 2 hot k-grams that others may hold, 3 covered intervals.
BLOCK = "bucket int, kind int, batch long, ids binary, marks binary, grams binary, docs binary, starts binary, ends binary"
#: kinds: 0 covered intervals, 1 spans whose text is needed.
FOUND = "key long, mark long, kind int, starts array<int>, ends array<int>, grams array<long>, hot array<boolean>"
#: Texts (spans, or single windows of hot ones) of a bucket: bytes, lengths, and where they are from.
TEXTS = "bucket int, texts binary, lens binary, grams binary, ids binary, marks binary, starts binary"


def _table(spec: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in spec.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols, fields)], names=[name for name, _ in fields])


def _found(kind: int, ids, marks, starts, ends, grams=None, hot=None):
    """A row for each document, of flat arrays."""
    import pyarrow as pa

    order = np.lexsort((starts, marks, ids))
    ids, marks = ids[order], marks[order]
    first, _ = runs_of(ids, marks) if len(ids) else (np.zeros(0, np.int64), None)
    bounds = pa.array(np.append(first, len(ids)).astype(np.int32))

    def listed(x, t):
        return pa.nulls(len(first), pa.list_(t)) if x is None else pa.ListArray.from_arrays(bounds, pa.array(x[order], t))

    grams = None if grams is None else grams.astype(np.int64)
    cols = (pa.array(ids[first]), pa.array(marks[first].astype(np.int64)), pa.array(np.full(len(first), kind, np.int32)), listed(starts, pa.int32()), listed(ends, pa.int32()), listed(grams, pa.int64()), listed(hot, pa.bool_()))
    return pa.table(list(cols), names=[f.split()[0] for f in FOUND.split(", ")])


def _joined(tables: list):
    import pyarrow as pa

    none = np.zeros(0, np.int64)
    return pa.concat_tables([*tables, _found(0, none, none, none, none)])


def _by_span(g: np.ndarray, w: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by k-gram, span and rank. Most k-grams occur once: only the others are sorted by more than the k-gram."""
    order = np.argsort(g)
    s = g[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    several = np.flatnonzero(same[1:] | same[:-1])
    some = order[several]
    order[several] = some[np.lexsort((rank[some], w[some], g[some]))]
    return order


def _place(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(x) % np.uint64(buckets)).astype(np.int64)


def _block(bucket: int, kind: int, batch: int, ids, marks, doc=None, g=None, start=None, end=None) -> tuple:
    """Rows of one bucket, ordered by k-gram where there are any; ids and marks are held once for each document."""
    if doc is None:
        return bucket, kind, batch, None, None, g.astype("<u8").tobytes(), None, None, None
    used, doc = np.unique(doc, return_inverse=True)
    spread = None if g is None else _planes(np.diff(g, prepend=np.uint64(0)), 8)
    return bucket, kind, batch, ids[used].tobytes(), marks[used].astype("<u4").tobytes(), spread, _planes(doc, 3), _planes(start, 4), _planes(end - start, 4)


def _parted(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has rows, and these in their order."""
    order = np.argsort(place, kind="stable")
    first, _ = runs_of(place[order])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        yield int(place[order[a]]), order[a:b]


def _alike(text: np.ndarray, at: np.ndarray, size: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows, sorted by class, whose bytes are those of their class's first row."""
    to = first[number]
    same = size == size[to]
    some = np.flatnonzero(same & (to != np.arange(len(to))))
    if len(some):
        n = size[some]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = text[np.repeat(at[some], n) + step] == text[np.repeat(at[to[some]], n) + step]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


def _blocks(buckets: int, entries: int, from_hot: int, length: int, gram: int, sort: Callable):
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        rolling, part, number = Rolling(), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        names: list[tuple] = []
        texts: list[np.ndarray] = []
        total = known = size = 0

        def flush():
            nonlocal held, names, texts, total, known, size, number
            ids, marks = (np.concatenate(c) for c in zip(*names))
            doc, g, w, at, start, end = (np.concatenate(c) for c in zip(*held))
            text = np.concatenate(texts)
            batch, number = part << 24 | number, number + 1
            held, names, texts, total, known, size = [], [], [], 0, 0, 0
            order = _by_span(g, w, ids[doc])
            doc, g, w, at, start, end = (c[order] for c in (doc, g, w, at, start, end))
            g = g >> HASH
            gfirst, gnumber = runs_of(g)
            rows = []
            several = np.flatnonzero((np.bincount(gnumber) > 1)[gnumber])
            keep = np.ones(len(doc), bool)
            if len(several):  # settled here: merged intervals travel on by document
                cfirst, cnumber = runs_of(g[several], w[several])
                span = (end - start)[several]
                lone = ~_alike(text, at[several], span, cnumber, cfirst)
                cnumber = np.where(lone, len(cfirst) + np.cumsum(lone) - 1, cnumber)  # equal hashes, other bytes
                which, frm, to = covered(text, at[several], span, gnumber[several], cnumber, ids[doc[several]], length, sort)
                which = several[which]
                base = doc[which].astype(np.int64) << 32
                s, e = merged(base + start[which] + frm, base + start[which] + to)
                d = s >> 32
                base = d << 32
                for k, p in _parted(_place(ids[d].astype(np.uint64), buckets)):
                    rows.append(_block(k, 3, batch, ids, marks, d[p], None, (s - base)[p], (e - base)[p]))
                keep[which[(frm == 0) & (to == (end - start)[which])]] = False
            doc, g, w, start, end = (x[keep] for x in (doc, g, w, start, end))
            gfirst, gnumber = runs_of(g)
            many = np.bincount(gnumber, minlength=len(gfirst)) >= from_hot
            hot = many[gnumber] if len(g) else np.zeros(0, bool)
            for kind, some in ((0, np.flatnonzero(~hot)), (1, np.flatnonzero(hot))):
                for k, p in _parted(_place(g[some] if kind == 0 else w[some], buckets)):
                    p = some[p]
                    rows.append(_block(k, kind, batch, ids, marks, doc[p], g[p], start[p], end[p]))
            h = g[gfirst[many]]
            rows += [_block(k, 2, batch, None, None, None, h[p]) for k, p in _parted(_place(h, buckets))]
            return _table(BLOCK, rows).to_batches()

        for rows_, data, offs in text_chunks(batches, budget=SEGMENT):
            ids, marks = rows_.column(0).to_numpy(), rows_.column(1).to_numpy()
            if len(offs) > 2 or len(data) <= SEGMENT:
                parts = [(0, data, offs)]
            else:  # one long text, in stretches that share all but one byte of a window
                parts = [(a, data[a : a + SEGMENT + length - 1], None) for a in range(0, len(data) - length + 1, SEGMENT)]
            names.append((ids, marks))
            for begin, piece, bounds in parts:
                bounds = np.array([0, len(piece)]) if bounds is None else bounds
                g, w, doc, start, last = spans(piece, bounds, rolling, length, gram)
                held.append((doc + known, g, w, bounds[doc] + start + size, start + begin, start + begin + last + length))
                texts.append(piece.copy())
                size += len(piece)
                total += len(start)
                if total >= entries:
                    yield from flush()
                    names.append((ids, marks))
            known = sum(len(n) for n, _ in names)
        if total:
            yield from flush()

    return run


def _matched(_, rows):
    """A bucket of spans: those whose k-gram several batches hold ask for text."""
    got: dict[int, list] = {0: [], 1: [], 2: [], 3: []}
    for kind, batch, ids, marks, grams, docs, starts, lens in zip(*(rows.column(c).to_pylist() for c in ("kind", "batch", "ids", "marks", "grams", "docs", "starts", "ends"))):
        if kind == 2:
            got[2].append(np.frombuffer(grams, "<u8"))
            continue
        doc = _unplanes(docs, 3).astype(np.int64)
        start = _unplanes(starts, 4).astype(np.int32)
        g = np.cumsum(_unplanes(grams, 8)) if grams is not None else np.zeros(len(doc), np.uint64)
        got[kind].append((np.frombuffer(ids, np.int64)[doc], np.frombuffer(marks, "<u4")[doc], g, start, start + _unplanes(lens, 4).astype(np.int32), np.full(len(doc), batch)))
    out = []
    if got[3]:
        ids, marks, _, start, end, _ = (np.concatenate(c) for c in zip(*got[3]))
        out.append(_found(0, ids, marks, start, end))
    shared = np.unique(np.concatenate(got[2])) if got[2] else np.zeros(0, np.uint64)
    if got[0]:
        ids, marks, g, start, end, batch = (np.concatenate(c) for c in zip(*got[0]))
        got[0] = []
        order = np.argsort(g)
        s = g[order]
        told = np.isin(s, shared)
        near = told.copy()  # the others' k-grams that occur once have no partner
        near[1:] |= s[1:] == s[:-1]
        near[:-1] |= s[:-1] == s[1:]
        order, told = order[near], told[near]
        ids, marks, g, start, end, batch = (c[order] for c in (ids, marks, g, start, end, batch))
        if len(g):
            first, number = runs_of(g)
            apart = np.minimum.reduceat(batch, first) < np.maximum.reduceat(batch, first)
            apart &= np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
            hot = told | (np.diff(first, append=len(g)) >= BUCKET_SPANS // 8)[number]
            ask = told | apart[number]
            out.append(_found(1, ids[ask], marks[ask], start[ask], end[ask], g[ask], hot[ask]))
    if got[1]:
        ids, marks, g, start, end, _ = (np.concatenate(c) for c in zip(*got[1]))
        out.append(_found(1, ids, marks, start, end, g, np.ones(len(g), bool)))
    return _joined(out)


def _packer():
    import pyarrow as pa

    return pa.Codec("zstd", compression_level=1)


def _together(batches: Iterator, size: int) -> Iterator:
    """Small batches as larger ones, of about ``size`` bytes."""
    import pyarrow as pa

    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _texts(buckets: int, length: int):
    """Texts of the spans that ask for it, by bucket of their k-gram; of hot ones, each window by its own hash."""

    def run(batches: Iterator) -> Iterator:
        rolling = Rolling()
        for batch in _together(batches, TEXT_BYTES):
            for rows_, data, offs in text_chunks([batch], budget=TEXT_BYTES):
                keys, marks = rows_.column(0).to_numpy(), rows_.column(1).to_numpy()
                asked = [rows_.column(rows_.schema.get_field_index(c)) for c in ("starts", "ends", "grams", "hot")]
                doc = np.repeat(np.arange(len(keys)), np.diff(asked[0].offsets.to_numpy()))
                start, end, g, hot = (a.flatten().to_numpy(zero_copy_only=False) for a in asked)
                start = start.astype(np.int64) + offs[doc]
                size = end - asked[0].flatten().to_numpy()
                place = _place(g.astype(np.uint64), buckets)
                if hot.any():  # each window of a hot span for itself
                    many = size[hot] - length + 1
                    s = np.repeat(start[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    rolling.over(data)
                    place = np.concatenate((place[~hot], _place(rolling.of(s, s + length), buckets)))
                    doc = np.concatenate((doc[~hot], np.repeat(doc[hot], many)))
                    g = np.concatenate((g[~hot], np.repeat(g[hot], many)))
                    start, size = np.concatenate((start[~hot], s)), np.concatenate((size[~hot], np.full(len(s), length)))
                rows = []
                for k, p in _parted(place):
                    n = size[p].astype(np.int64)
                    texts = data[np.repeat(start[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    rows.append((k, _packer().compress(texts, asbytes=True), n.astype("<u4").tobytes(), g[p].astype("<u8").tobytes(), keys[doc[p]].tobytes(), marks[doc[p]].astype("<u4").tobytes(), (start[p] - offs[doc[p]]).astype("<i4").tobytes()))
                yield from _table(TEXTS, rows).to_batches()

    return run


# ---- deep-shallow suffix sorting


class BlindTrie:
    """Strings of one length in order. Inner nodes know only the place at which their strings part and the bytes there: going down
    looks at these places alone, and one comparison with the leaf that is reached tells where the new string really parts."""

    def __init__(self, length: int):
        self.length, self.root = length, None

    def add(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = [s, [item]]
            return
        node = self.root
        while len(node) == 3:
            children = node[1]
            node = children.get(s[node[0]]) or node[2]
        if node[0] == s:
            node[1].append(item)
            return
        other = node[0]
        at = next(i for i in range(self.length) if s[i] != other[i])
        node, parent, branch = self.root, None, -1
        while len(node) == 3 and node[0] < at:
            parent, branch = node, s[node[0]]
            node = node[1][branch]
        leaf = [s, [item]]
        if len(node) == 3 and node[0] == at:
            node[1][s[at]] = leaf
            return
        inner = [at, {other[at]: node, s[at]: leaf}, leaf]
        if parent is None:
            self.root = inner
        else:
            parent[1][branch] = inner

    def groups(self) -> Iterator[list[int]]:
        """Items of equal strings, in the strings' order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                yield node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def multikey_quicksort(places: np.ndarray, word: np.ndarray, deep: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of ``places`` by ``near`` and then by the ``deep`` bytes there (a multiple of 8), and where the groups that are equal so far begin and
    how long they are.

    A step on ``near`` and two bytes makes the first groups. Then each group is split by its pivot, the median of three keys of one word, into less,
    equal and greater; the equal part goes on with the next word. All groups take their step at once; what stands alone takes none."""
    lead = near << 16 | (word[places] >> np.uint64(48)).astype(np.int64)
    ranks = np.argsort(lead)
    first, _ = runs_of(lead[ranks]) if len(places) else (np.zeros(0, np.int64), None)
    size = np.diff(first, append=len(places))
    alone = size < 2
    at = np.flatnonzero(np.repeat(~alone, size))
    size = size[~alone]
    depth = np.zeros(len(size), np.int64)
    starts, sizes = [], []
    while len(size):
        group = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        here = ranks[at]
        key = word[places[here] + depth[group]]
        a, b, c = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        side = (key > pivot) * np.int8(2) + (key == pivot)
        count = np.bincount(group * 3 + side, minlength=3 * len(size)).reshape(-1, 3)
        offset = (np.cumsum(count) - count.ravel()).reshape(-1, 3)
        moved = np.empty_like(here)
        for k in range(3):
            some = np.flatnonzero(side == k)
            rank = np.arange(len(some)) - np.repeat(np.cumsum(count[:, k]) - count[:, k], count[:, k])
            moved[np.repeat(offset[:, k], count[:, k]) + rank] = here[some]
        ranks[at] = moved
        count, offset, depth = count.ravel(), offset.ravel(), np.repeat(depth, 3)
        depth[1::3] += 8
        ready = (count > 1) & (depth >= deep)
        starts.append(at[offset[ready]])
        sizes.append(count[ready])
        on = (count > 1) & ~ready
        at = at[np.repeat(on, count)]
        size, depth = count[on], depth[on]
    if not starts:
        return ranks, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    order = np.argsort(start)
    return ranks, start[order], size[order]


def equal_suffixes(text: np.ndarray, places: np.ndarray, length: int, near: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``places`` (their numbers) have the same ``length`` bytes as another one that is ``near`` (has the same number there), and their groups' numbers, rising.
    A place alone is a group if its text is ``held`` by several documents.

    Multikey quicksort orders them to SHALLOW bytes; groups that are still equal there go to a blind trie each, unless all the rest is equal, too."""
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    word = np.empty(len(text) // 8 * 8 + 8, np.uint64)
    for i in range(8):
        word[i::8] = padded[i : i + len(word)].view(">u8")
    deep = min(SHALLOW, length) // 8 * 8
    if deep:
        ranks, start, size = multikey_quicksort(places, word, deep, near)
    else:
        ranks = np.argsort(near, kind="stable")
        start, _ = runs_of(near[ranks]) if len(near) else (np.zeros(0, np.int64), None)
        size = np.diff(start, append=len(near))
    begin = np.cumsum(size) - size
    rows = ranks[np.repeat(start - begin, size) + np.arange(size.sum())]
    flat = places[rows]
    lead = np.repeat(flat[begin], size) if len(flat) else flat
    same = np.ones(len(flat), bool)
    for d in [*range(deep, length - 7, 8), *([length - 8] if length >= 8 else [])]:
        same &= word[flat + d] == word[lead + d]
    if not deep and len(flat):
        same[:] = False
    whole = np.logical_and.reduceat(same, begin) if len(flat) else np.zeros(0, bool)
    found, group = [rows[np.repeat(whole, size)]], [np.repeat(np.arange(len(size))[whole], size[whole])]
    number, raw = len(size), text.tobytes() if len(size) and not whole.all() else b""
    for a, n in zip(begin[~whole].tolist(), size[~whole].tolist()):
        trie = BlindTrie(length - deep)
        for r, p in zip(rows[a : a + n].tolist(), flat[a : a + n].tolist()):
            trie.add(raw[p + deep : p + length], r)
        for items in trie.groups():
            if len(items) > 1:
                found.append(np.array(items))
                group.append(np.full(len(items), number))
                number += 1
    lone = held.copy()
    for some in found:
        lone[some] = False
    lone = np.flatnonzero(lone)
    return np.concatenate([*found, lone]).astype(np.int64), np.concatenate([*group, number + np.arange(len(lone))]).astype(np.int64)


def covered(text: np.ndarray, at: np.ndarray, size: np.ndarray, grams: np.ndarray, number: np.ndarray, ids: np.ndarray, length: int, sort: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (where their text is, its size, the k-gram's and the text's number, their document): which spans have bytes that a smaller document
    covers, and from where to where. Each text is sorted once, whatever the number of spans that hold it."""
    none = np.zeros(0, np.int64)
    order = np.lexsort((ids, number))
    at, size, number, ids = (x[order] for x in (at, size, number, ids))
    first, of = runs_of(number)
    least, last = ids[first], ids[np.append(first[1:], len(ids)) - 1]
    begin, near = at[first], grams[order][first]
    windows = size[first] - length + 1
    owner = np.repeat(np.arange(len(first)), windows)
    places = (begin - np.cumsum(windows) + windows)[owner] + np.arange(len(owner))
    found, group = sort(text, places, length, near[owner], (last > least)[owner])
    if not len(found):
        return none, none, none
    k, p = owner[found], places[found]
    gfirst, gnumber = runs_of(group)
    lowest = np.minimum.reduceat(least[k], gfirst)[gnumber]
    # the whole of what larger documents of a class hold, if all its windows were found
    complete = np.bincount(k, minlength=len(first)) == windows
    others = np.flatnonzero((ids > least[of]) & complete[of])
    out = [(others, np.zeros(len(others), np.int64), size[others])]
    # of the smallest document of a class, what still smaller ones hold
    hit = np.flatnonzero(lowest < least[k])
    if len(hit):
        hit = hit[np.lexsort((p[hit], k[hit]))]
        k, p = k[hit], p[hit]
        run = np.ones(len(k), bool)
        run[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)
        a = np.flatnonzero(run)
        b = np.append(a[1:], len(k)) - 1
        k, frm, to = k[a], p[a] - begin[k[a]], p[b] - begin[k[a]] + length
        firsts = np.flatnonzero(ids == least[of])  # sorted by class
        lo, hi = np.searchsorted(of[firsts], k), np.searchsorted(of[firsts], k, "right")
        n = hi - lo
        rows = firsts[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out.append((rows, np.repeat(frm, n), np.repeat(to, n)))
    which, frm, to = (np.concatenate(c) for c in zip(*out))
    return order[which], frm, to


def _compared(length: int, sort: Callable):
    """A bucket of texts: windows that a smaller document has, too."""

    def run(_, rows):
        each = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows.column("lens").to_pylist()]
        raw = b"".join(_packer().decompress(x, int(n.sum()), asbytes=True) for x, n in zip(rows.column("texts").to_pylist(), each))
        lens = np.concatenate(each)
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), np.int64)
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), "<u4").astype(np.int64)
        starts = np.frombuffer(b"".join(rows.column("starts").to_pylist()), "<i4").astype(np.int64)
        begin = np.cumsum(lens) - lens
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(raw[a : a + n], len(numbers)) for a, n in zip(begin.tolist(), lens.tolist())], np.int64)
        _, grams = np.unique(np.frombuffer(b"".join(rows.column("grams").to_pylist()), "<u8"), return_inverse=True)
        which, frm, to = covered(np.frombuffer(raw, np.uint8), begin, lens, grams, number, ids, length, sort)
        return _found(0, ids[which], marks[which], starts[which] + frm, starts[which] + to)

    return run


# ---- the operator


def _kept(full: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            flat = [batch.column(batch.schema.get_field_index(c)) for c in ("starts", "ends")]
            bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(flat[0]), 0).to_numpy())))
            starts, ends = (f.flatten().to_numpy().astype(np.int64) for f in flat)
            for i, text in enumerate(batch.column("text")):
                raw = text.as_py()
                s, e = merged(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])
                kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)])) if len(s) else raw
                for col, v in zip(cols, (len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if full:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def dedup(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, full: bool = True, sort: Callable = equal_suffixes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``full``, the bytes that are kept. ``sort`` tells equal suffixes."""
    if not gram < length < 256:
        raise ValueError("the k-gram must be shorter than the string, the string shorter than 256 bytes")
    bounded(docs.sparkSession)
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(LAST))).withColumn("mark", F.crc32("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    spans_all = total // max(1, (length - gram + 2) // 2) + 1  # a k-gram is smallest about once in half a window
    entries = step_entries(spans_all, min(LEAST_ENTRIES, MOST_ENTRIES), MOST_ENTRIES)
    buckets = max(16, -(-spans_all // entries))
    blocks = docs.select("key", "mark", "text").mapInArrow(_blocks(buckets, entries, hot_from(spans_all, entries, HOT), length, gram, sort), BLOCK)
    found = saved(dealt(blocks, "bucket", buckets).groupBy("bucket").applyInArrow(_matched, FOUND), "substr-found")
    lists = lambda *names: [F.flatten(F.collect_list(c)).alias(c) for c in names]
    # each step is written, and what it was made of dropped, before the next one shuffles
    by_doc = lambda df, *names: df.groupBy("key", "mark").agg(*lists(*names))
    asked = saved(by_doc(found.filter("kind = 1"), "starts", "ends", "grams", "hot"), "substr-asked")
    settled = saved(by_doc(found.filter("kind = 0"), "starts", "ends"), "substr-settled")
    drop_saved(found)
    smaller = max(16, -(-asked.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0] // BUCKET_SPANS))
    texts = docs.join(asked, ["key", "mark"]).select("key", "mark", "text", "starts", "ends", "grams", "hot").mapInArrow(_texts(smaller, length), TEXTS)
    more = saved(dealt(texts, "bucket", smaller).groupBy("bucket").applyInArrow(_compared(length, sort), FOUND), "substr-more")
    drop_saved(asked)
    covers = saved(by_doc(settled.unionByName(more.select("key", "mark", "starts", "ends")), "starts", "ends"), "substr-covers")
    drop_saved(settled, more)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full
    return docs.join(covers, ["key", "mark"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(_kept(full), schema)
