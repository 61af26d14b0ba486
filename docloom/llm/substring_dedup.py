"""Substring deduplication: exact windows of words, and MinHash banding of paragraphs.

Texts seldom break where a repeated passage begins, so exact repeats are found by content:
an anchor is the least ``GRAM``-word hash of some ``GRAM`` consecutive ones (rightmost on
ties), so every window of ``SIZE`` words holds an anchor with all its words, at the same
place wherever the window occurs.  An anchor is sent with the words around it, and windows
that agree in one of the 13 ways to place the anchor in them are equal.  Every word of
every window of ``SIZE`` words that another document holds is found, so passages of that
length or more are covered from end to end.  A word around an anchor is sent as 16 bits:
a window with one other word is taken for equal once in 65536.

Edited paragraphs are found line by line.  Equal lines of ``SIZE`` words or more count once;
they collide if they agree in one of ``BANDS`` bands of ``ROWS`` MinHash values (at Jaccard
0.8 that finds 9968 of 10000), and are classes by Jaccard over all their five-word shingles
(as 32-bit hashes) and connected components.  Colliding lines are dealt by band and salt.  In a salt
a line that has a representative there is linked to it, other lines become representatives;
those of a band are then compared pair by pair, in blocks.  The links so far give classes.
Lines that collide and are in different classes are then compared too, whether they are
representatives or not, so that no link of a colliding pair is lost between classes.  Lines
don't overlap, so nothing links passages step by step.

Of equal windows and of linked lines, those of the smallest doc_id stay and the others are
removed.  No key gathers in one task: anchors and bands that a sample shows to be frequent
are salted, and so is a group that floods a task; the windows of a part are told to all
parts and back, each once.  The sample deals rows and decides nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, slices, stored, texts
from .components import components
from .skew import SALTS, join_one, with_totals

SHINGLE, SIZE, GRAM, BANDS, ROWS, SIMILAR = 5, 25, 13, 8, 3, 0.8
SIDE = SIZE - GRAM  # words beside an anchor, at each side
#: Rows of one colliding group that are held at once.
HELD = 50_000
#: Bytes of text that are cut into words at once.
PART_BYTES = 2 << 20
#: A key is frequent if it has about ``HOT`` rows or more, and more than one of ``KEYS`` of
#: all rows: so there are at most ``KEYS``.  One row of ``SAMPLE`` is looked at.
HOT, KEYS, SAMPLE = 20_000, 10_000, 64
#: Representatives of a salt that are held at once, and those in a block.
LEADERS, BLOCK = 2000, 1000
PIECE, RAW, LEAD = 0, 1, 2
LINK, LEADER = 0, 1
_anchors = pa.schema([("key", pa.int64()), ("part", pa.int8()), ("doc_id", pa.int64()), ("start", pa.int32()), ("around", pa.binary())])
_pieces = pa.schema([("doc_id", pa.int64()), ("removed", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32()), ("component_id", pa.int64()), ("first_doc_id", pa.int64())])
_told = pa.schema([("what", pa.int8()), *_pieces, ("key", pa.int64()), ("part", pa.int8()), ("around", pa.binary())])
_lines = pa.schema([("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), *((f"b{k}", pa.int64()) for k in range(BANDS))])
_sets = pa.schema([("content", pa.int64()), ("shingles", pa.binary())])
_lead = pa.schema([("what", pa.int8()), ("key", pa.int64()), ("content", pa.int64()), ("leader", pa.int64()), ("shingles", pa.binary())])
_edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_spans = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int32()), ("component_id", pa.int64()), ("first_doc_id", pa.int64()), ("removed", pa.bool_())])
ANCHORS = "key long, part byte, doc_id long, start int, around binary"
PIECES = "doc_id long, removed boolean, start int, stop int, component_id long, first_doc_id long"
TOLD = f"what byte, {PIECES}, key long, part byte, around binary"
LINES = "content long, doc_id long, start int, size int, " + ", ".join(f"b{k} long" for k in range(BANDS))
SPANS = "doc_id long, start int, stop int, n_words int, component_id long, first_doc_id long, removed boolean"
_WORD = re.compile(rb"[^ \t-\r]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` consecutive ones, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of a flow of word hashes (runs over the end of
    a document are hashed too, and not used)."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    n, by = len(h) - size + 1, _odd(size, 1)
    out = h[:n] * by[0]
    for j in range(1, size):
        out += h[j : j + n] * by[j]
    return _mix(out)


def anchors(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position in the flow) of all anchors: one at least in every ``SIZE`` words."""
    if len(grams) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.uint64(0xFFFFFF)
    order = np.arange(len(grams), dtype=np.uint64) & low
    least = _sliding_min((grams & ~low) | (low - order), GRAM)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    window = np.arange(len(least))
    inside = window + SIZE <= (starts + sizes)[doc]
    window, least = window[inside], least[inside]
    at = np.unique(window + (((low - (least & low)).astype(np.int64) - window) & 0xFFFFFF))
    # empty documents share their start with the next one: the last of them owns it
    return np.searchsorted(starts, at, "right") - 1, at


def _flow(batch):
    """The word hashes of all texts end to end; starts and sizes of the texts and lines."""
    words, sizes, lines = [], [], []
    for x in texts(batch.column("text")):
        before = len(words)
        for line in x.encode().lower().splitlines():
            own = line.split()
            words += own
            lines.append(len(own))
        sizes.append(len(words) - before)
    sizes, lines = np.array(sizes, np.int64), np.array(lines, np.int64)
    return word_hashes(words), np.cumsum(sizes) - sizes, sizes, np.cumsum(lines) - lines, lines


def _anchored(batch):
    """(hashes of words, of runs of ``GRAM`` words, starts and sizes of texts, document and
    place in the flow of the anchors, their doc_ids)"""
    h, starts, sizes, _, _ = _flow(batch)
    grams = gram_hashes(h, GRAM)
    doc, at = anchors(grams, starts, sizes)
    return h, grams, starts, sizes, doc, at, batch.column("doc_id").to_numpy(zero_copy_only=False)[doc].astype(np.int64)


def _keys(batches):
    for batch in slices(batches, 1024, PART_BYTES):
        _, grams, _, _, _, at, _ = _anchored(batch)
        yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64))], names=["key"])


def _windows(frequent: np.ndarray):
    """The anchors with the words around them: the ``SIDE`` words to the left and to the
    right, from the anchor outwards (0: no word), and the anchor's word if it repeats one.
    Anchors with one of the ``frequent`` keys (sorted) are dealt to parts from 1 on."""

    def run(batches):
        for batch in slices(batches, 1024, PART_BYTES):
            h, grams, starts, sizes, doc, at, names = _anchored(batch)
            if not len(at):
                continue
            code = np.maximum(h & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
            begin, end, last = starts[doc], (starts + sizes)[doc], len(h) - 1
            around = np.zeros((len(at), 2 * SIDE + 1), np.uint16)
            for d in range(SIDE):
                left, right = at - 1 - d, at + GRAM + d
                around[:, d] = np.where(left >= begin, code[np.maximum(left, 0)], 0)
                around[:, SIDE + d] = np.where(right < end, code[np.minimum(right, last)], 0)
            one = np.ones(len(at), bool)
            for d in range(1, GRAM):
                one &= h[at + d] == h[at]
            around[:, -1] = np.where(one, code[at], 0)
            ends = np.arange(len(at) + 1, dtype=np.int32) * (2 * around.shape[1])
            around = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(around)])
            key = grams[at].view(np.int64)
            part = np.where(np.isin(key, frequent), 1 + names % SALTS, 0).astype(np.int8)
            yield batch_of(_anchors, [key, part, names, (at - begin).astype(np.int32), around])

    return run


def _around(column: pa.Array) -> np.ndarray:
    width = 2 * (2 * SIDE + 1)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = np.frombuffer(column.buffers()[1], kind)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * width].view(np.uint16).reshape(len(column), -1)


def window_names(key: np.ndarray, around: np.ndarray):
    """For each way to place an anchor in a window: (words before it, rows with such a
    window, names of their windows)."""
    own, by = key.view(np.uint64), _odd(2 * SIDE + 1, 3)
    sums = around[:, : 2 * SIDE].astype(np.uint64) * by[: 2 * SIDE]
    none = np.zeros(len(key), np.uint64)
    left, right = np.c_[none, np.cumsum(sums[:, :SIDE], 1)], np.c_[none, np.cumsum(sums[:, SIDE:], 1)]
    sides = around[:, :SIDE], around[:, SIDE : 2 * SIDE]
    full = [np.c_[np.ones(len(key), bool), np.logical_and.accumulate(x > 0, 1)] for x in sides]
    word = around[:, -1:]
    same = [np.c_[word > 0, np.logical_and.accumulate(x == word, 1)] for x in sides]
    for j in range(SIDE + 1):
        k = SIDE - j
        ok = full[0][:, j] & full[1][:, k]
        if j:  # a run of one repeated word keeps its first words
            ok &= ~((word[:, 0] > 0) & same[0][:, j] & (same[1][:, k] | (k == 0)))
        rows = np.flatnonzero(ok)
        if len(rows):
            yield j, rows, _mix(own[rows] + _mix(left[rows, j] + right[rows, k] * np.uint64(3) + by[-1:] * np.uint64(j)))


def _pieces_of(doc: np.ndarray, start: np.ndarray, windows):
    """Pieces of anchors, from (words before the anchor, rows, names and first documents)
    of their shared windows.  All windows around an anchor overlap, so what stays there is
    one piece, and what is removed is another."""
    n, big = len(doc), np.iinfo(np.int64).max
    top = {kind: [np.full(n, -1), np.full(n, SIZE), np.full(n, big), np.full(n, big)] for kind in (True, False)}
    for j, rows, name, begin in windows:
        for kind, columns in top.items():
            at = (doc[rows] != begin) == kind
            r = rows[at]
            columns[0][r] = np.maximum(columns[0][r], j)
            columns[1][r] = np.minimum(columns[1][r], j)
            columns[2][r] = np.minimum(columns[2][r], name[at])
            columns[3][r] = np.minimum(columns[3][r], begin[at])
    for kind, (most, least, name, begin) in top.items():
        at = np.flatnonzero(most >= 0)
        if not len(at):
            continue
        own, left, right = doc[at], start[at] - most[at], start[at] + SIZE - least[at]
        # pieces of a document that follow each other and touch are one
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (left[1:] < left[:-1]) | (left[1:] > right[:-1])])
        yield [own[new], np.full(len(new), kind), left[new].astype(np.int32), np.maximum.reduceat(right, new).astype(np.int32), np.minimum.reduceat(name[at], new), np.minimum.reduceat(begin[at], new)]


def equal_windows(key: np.ndarray, doc: np.ndarray, start: np.ndarray, around: np.ndarray):
    """Of anchors sorted by key, doc_id and start: the pieces that stay and are removed."""

    def shared():
        for j, rows, name in window_names(key, around):
            name, first, which = np.unique(name, return_index=True, return_inverse=True)
            last = np.zeros(len(name), np.int64)
            last[which] = np.arange(len(rows))
            begin = doc[rows][first]
            across = (begin != doc[rows][last])[which]
            yield j, rows[across], name.view(np.int64)[which[across]], begin[which[across]]

    yield from _pieces_of(doc, start, shared())


def _filled(n: int, **columns) -> pa.RecordBatch:
    """A batch of ``_told`` with nulls in the columns that aren't named."""
    return batch_of(_told, [columns.get(f.name, pa.nulls(n, f.type)) for f in _told])


def _equal(batches):
    """Streams the anchors, sorted by key, part, doc_id and start.  Emits pieces of
    documents that other documents hold too.  Anchors of dealt keys, and of keys with more
    than ``HELD`` rows, which are dealt here, are passed on, with their distinct windows
    and the first and last document of each."""
    names = [f for f in _anchors.names if f != "part"]

    def shared(rows):
        """The rows whose key is in several documents."""
        first = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
        last = np.r_[first[1:], len(rows["key"])] - 1
        at = np.repeat(rows["doc_id"][first] != rows["doc_id"][last], last - first + 1)
        return {f: x[at] for f, x in rows.items()}

    def pieces(rows):
        rows = shared(rows)
        for p in equal_windows(*(rows[f] for f in names)):
            yield _filled(len(p[0]), what=np.full(len(p[0]), PIECE, np.int8), **dict(zip(_pieces.names, p)))

    def dealt(rows):
        key, doc, n = rows["key"], rows["doc_id"], len(rows["key"])
        part = (1 + doc % SALTS).astype(np.int8)
        around = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (2 * rows["around"].shape[1])), pa.py_buffer(np.ascontiguousarray(rows["around"]))])
        yield _filled(n, what=np.full(n, RAW, np.int8), doc_id=doc, start=rows["start"], key=key, part=part, around=around)
        for _, at, name in window_names(key, rows["around"]):
            order = np.lexsort((doc[at], part[at], name))
            at, name = at[order], name[order]
            new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (part[at][1:] != part[at][:-1])])
            last = np.r_[new[1:], len(at)] - 1
            yield _filled(len(new), what=np.full(len(new), LEAD, np.int8), component_id=name[new].view(np.int64), first_doc_id=doc[at[new]], doc_id=doc[at[last]], key=key[at[new]], part=part[at[new]])

    held: list[dict] = []
    flood = None  # a key with more rows than are held
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {f: batch.column(f).to_numpy() for f in names if f != "around"} | {"around": _around(batch.column("around"))}
        direct = batch.column("part").to_numpy() > 0
        if flood is not None:
            direct |= rows["key"] == flood
        if direct.any():
            yield from dealt({f: x[direct] for f, x in rows.items()})
            rows = {f: x[~direct] for f, x in rows.items()}
            if not len(rows["key"]):
                continue
        held.append(rows)
        if sum(len(x["key"]) for x in held) < HELD:
            continue
        rows = {f: np.concatenate([x[f] for x in held]) for f in names}
        cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
        if cut:
            yield from pieces({f: x[:cut] for f, x in rows.items()})
            held = [{f: x[cut:] for f, x in rows.items()}]
        else:
            flood, held = rows["key"][-1], []
            yield from dealt(rows)
    if held:
        yield from pieces({f: np.concatenate([x[f] for x in held]) for f in names})


def _assign(batches):
    """Streams, per key and part, first the windows that several documents hold (name,
    first document) and then the anchors; emits their pieces."""
    group, names, firsts, known = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {f: batch.column(f) for f in batch.schema.names}
        key, part, what = (columns[f].to_numpy() for f in ("key", "part", "what"))
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (what[1:] != what[:-1]), True])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if (key[a], part[a]) != group:
                group, names, firsts, known = (key[a], part[a]), [], [], None
            own = {f: x.slice(a, b - a) for f, x in columns.items()}
            if what[a] == LEAD:
                names.append(own["component_id"].to_numpy())
                firsts.append(own["first_doc_id"].to_numpy())
                continue
            if known is None:
                known = (np.concatenate(names), np.concatenate(firsts)) if names else (np.empty(0, np.int64), np.empty(0, np.int64))
                known = [x[np.argsort(known[0])] for x in known]
            if not len(known[0]):
                continue

            def shared():
                for j, rows, name in window_names(key[a:b], _around(own["around"])):
                    name = name.view(np.int64)
                    at = np.minimum(np.searchsorted(known[0], name), len(known[0]) - 1)
                    found = known[0][at] == name
                    yield j, rows[found], name[found], known[1][at[found]]

            for p in _pieces_of(own["doc_id"].to_numpy(), own["start"].to_numpy(), shared()):
                yield batch_of(_pieces, p)


def contents(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Summands, a word with its place in its line, of the hash of a line's words."""
    return _mix(h + place.astype(np.uint64) * _odd(1, 4)[0])


def _own_lines(batches):
    """Each line of ``SIZE`` words or more, with its bands."""
    for batch in slices(batches, 1024, PART_BYTES):
        h, starts, sizes, at, size = _flow(batch)
        own = contents(h, np.arange(len(h)) - np.repeat(at, size))
        at, size = at[size >= SIZE], size[size >= SIZE]
        if not len(at):
            continue
        sh = gram_hashes(h, SHINGLE)

        def over(do, x, short):
            return do.reduceat(np.r_[x, x[-1:]], np.c_[at, at + size - short].ravel())[::2]

        several = over(np.minimum, sh, SHINGLE - 1) != over(np.maximum, sh, SHINGLE - 1)  # not one repeated word
        content = _mix(over(np.add, own, 0))
        values = [over(np.minimum, (sh ^ a) * b, SHINGLE - 1) for a, b in _odd(2 * BANDS * ROWS, 100).reshape(-1, 2)]
        bands = [_mix(sum(values[k * ROWS + r] * by for r, by in enumerate(_odd(ROWS, 50 + k)))) for k in range(BANDS)]
        doc = np.searchsorted(starts, at, "right") - 1
        names = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        start = (at - starts[doc]).astype(np.int32)
        yield batch_of(_lines, [x[several] for x in (content.view(np.int64), names, start, size.astype(np.int32), *(x.view(np.int64) for x in bands))])


def _collide(batches):
    """Streams (key, content), sorted; passes on the keys with several contents."""
    last, told = None, False  # the row before, and whether it was passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(f).to_numpy() for f in ("key", "content")]
        if last is not None:
            rows = [np.r_[x, y] for x, y in zip(last, rows)]
        same = rows[0][1:] == rows[0][:-1]
        at = np.r_[False, same] | np.r_[same, False]
        at[0] &= not told
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in rows], names=["key", "content"])
        last, told = [x[-1:] for x in rows], bool(len(same) and same[-1])


def _shingle_sets(batches):
    """From rows (text, wanted: start, size and content): the paragraphs' distinct shingles."""
    for batch in slices(batches, 256):
        out = [[], []]
        for text, wanted in zip(texts(batch.column("text")), batch.column("wanted").to_pylist()):
            h = word_hashes(text.encode().lower().split())
            sh = gram_hashes(h, SHINGLE)
            for x in wanted:
                start, stop = x["start"], x["start"] + x["size"]
                if stop <= len(h) and int(_mix(contents(h[start:stop], np.arange(stop - start)).sum(keepdims=True)).view(np.int64)[0]) == x["content"]:
                    out[0].append(x["content"])
                    out[1].append(np.unique(sh[start : stop - SHINGLE + 1].astype(np.uint32)).tobytes())
        yield batch_of(_sets, out)


def link_group(sets, block=None, root=None, told=None) -> np.ndarray:
    """For arrays of shingles: the first one of each one's group under exact Jaccard of
    at least ``SIMILAR``.  A pair is compared unless it is linked already (``root``: the
    groups at the start); with ``block`` only pairs of different blocks are, and with
    ``told`` only pairs that are not both in it."""
    sets = [np.unique(x) for x in sets]
    sizes = np.array([len(x) for x in sets])
    starts, root = np.cumsum(sizes) - sizes, np.arange(len(sets)) if root is None else root.copy()
    names, which = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), np.int64)
    for i in range(len(sets)):
        others = root != root[i]
        others[:i] = False
        if block is not None:
            others &= block != block[i]
        if told is not None and told[i]:
            others &= ~told
        others &= np.minimum(sizes, sizes[i]) >= SIMILAR * np.maximum(sizes, sizes[i])
        at = np.flatnonzero(others)
        if len(at):
            n = sizes[at]
            first = np.cumsum(n) - n
            own = which[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[which[np.repeat(starts[at] - first, n) + np.arange(n.sum())]], first)
            mark[own] = 0
            near = at[both >= SIMILAR * (n + sizes[i] - both)]
            if len(near):
                joined = np.isin(root, np.r_[root[near], root[i]])
                root[joined] = root[joined].min()
    return root


def _represent(batches):
    """Streams rows (key, salt, content, shingles) sorted by the first three.  Emits a link
    for a content that is near a representative of its key and salt, and the others as
    representatives.  Of those ``LEADERS`` are held; the next ones start anew, which
    loses no link, as all representatives of a key are compared afterwards.  So are linked
    contents with those of other classes (``_apart``): they keep their shingles."""
    group, leaders, out = None, [], [[], [], [], [], []]

    def told():
        rows = batch_of(_lead, out)
        for x in out:
            x.clear()
        return rows

    for batch in batches:
        for *at, name, shingles in zip(*(batch.column(f).to_pylist() for f in ("key", "salt", "content", "shingles"))):
            if at != group or len(leaders) >= LEADERS:
                group, leaders = at, []
            own = frozenset(np.frombuffer(shingles, np.uint32).tolist())
            near = None
            for leader, theirs in leaders:
                small, large = sorted((len(own), len(theirs)))
                if small >= SIMILAR * large and (both := len(own & theirs)) >= SIMILAR * (small + large - both):
                    near = leader
                    break
            if near is None:
                leaders.append((name, own))
            row = (LEADER, at[0], name, name, shingles) if near is None else (LINK, at[0], name, near, shingles)
            for x, v in zip(out, row):
                x.append(v)
        if len(out[0]) >= 1000:
            yield told()
    yield told()


def _compare(batches):
    """Streams rows (key, i, j, block, content, component, told, shingles) sorted by the
    first five; emits links within a block (i = j) or between two.  Contents of one
    component are linked already, and those told were compared with each other."""
    group, rows, own = None, [], {}

    def links():
        block, component, told = (np.array(x) for x in zip(*rows))
        _, first, which = np.unique(component, return_index=True, return_inverse=True)
        before = first[which]
        if len(first) == 1 or told.all():
            return batch_of(_edges, [[], []])
        sets = [np.frombuffer(x, np.uint32) for x in own.values()]
        if len(sets) == 2:
            both = len(frozenset(sets[0].tolist()) & frozenset(sets[1].tolist()))
            if both < SIMILAR * (len(sets[0]) + len(sets[1]) - both):
                return batch_of(_edges, [[], []])
            return batch_of(_edges, [[x] for x in own])
        names = np.array(list(own), np.int64)
        root = link_group(sets, block if group[1] != group[2] else None, before, told)
        at = np.flatnonzero((root != before) & (before == np.arange(len(root))))
        return batch_of(_edges, [names[root[at]], names[at]])

    for batch in batches:
        for *at, part, name, component, told, shingles in zip(*(batch.column(f).to_pylist() for f in ("key", "i", "j", "block", "content", "component", "told", "shingles"))):
            if at != group:
                if len(own) > 1:
                    yield links()
                group, rows, own = at, [], {}
            if name not in own:
                own[name] = shingles
                rows.append((part, component, told))
    if len(own) > 1:
        yield links()


def _merge(batches):
    """From pieces sorted by doc_id, removed and start: spans of those that overlap or touch."""

    def spans(rows):
        doc, removed, start, stop, name, first = (rows[f] for f in _pieces.names)
        new = np.r_[True, (doc[1:] != doc[:-1]) | (removed[1:] != removed[:-1])]
        group = np.cumsum(new) - 1
        reach = np.maximum.accumulate(stop + (group << 32)) - (group << 32)
        new[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(new)
        stop = np.maximum.reduceat(stop, at)
        return batch_of(_spans, [doc[at], start[at], stop, stop - start[at], np.minimum.reduceat(name, at), np.minimum.reduceat(first, at), removed[at]])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in _pieces.names}
        rows = rows if held is None else {f: np.concatenate([held[f], x]) for f, x in rows.items()}
        cut = int(np.searchsorted(rows["doc_id"], rows["doc_id"][-1]))
        if cut:
            yield spans({f: x[:cut] for f, x in rows.items()})
        held = {f: x[cut:] for f, x in rows.items()}
    if held is not None:
        yield spans(held)


def frequent(keys: DataFrame, rows: int = HOT // SAMPLE) -> np.ndarray:
    """The keys of a sample that have ``rows`` rows in it, and one of ``KEYS`` of all, sorted."""
    counts = keys.groupBy("key").count().where(F.col("count") >= rows)
    most = keys.count() // KEYS
    return np.array(sorted(x.key for x in counts.where(F.col("count") > most).toLocalIterator()), np.int64)  # at most KEYS


def equal_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) that equal windows of other documents cover."""
    some = stored(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SAMPLE)) == 0).mapInArrow(_keys, "key long"), "sampled-anchors")
    often = frequent(some)
    discard(some)
    rows = docs.mapInArrow(_windows(often), ANCHORS).repartition("key", "part").sortWithinPartitions("key", "part", "doc_id", "start")
    told = stored(rows.mapInArrow(_equal, TOLD), "windows")
    # of dealt keys: each window's first document, given to the parts that have the window
    leads = told.where(F.col("what") == LEAD).groupBy("component_id", "part").agg(F.min("first_doc_id").alias("least"), F.max("doc_id").alias("last"), F.max("key").alias("key"))
    windows = leads.groupBy("component_id").agg(F.min("least").alias("first_doc_id"), F.max("last").alias("last"), F.max("key").alias("key"), F.collect_list("part").alias("parts")).where("first_doc_id <> last")  # SALTS parts at most
    windows = windows.select(F.lit(LEAD).cast("byte").alias("what"), "component_id", "first_doc_id", "key", F.explode("parts").alias("part"))
    both = told.where(F.col("what") == RAW).unionByName(windows, allowMissingColumns=True)
    both = both.select("what", "key", "part", "doc_id", "start", "component_id", "first_doc_id", "around").repartition("key", "part").sortWithinPartitions("key", "part", F.desc("what"), "doc_id", "start")
    return told.where(F.col("what") == PIECE).select(*_pieces.names).unionByName(both.mapInArrow(_assign, PIECES))


def _compared(pairs: DataFrame) -> DataFrame:
    """Links (a, b) between the rows of the pairs of blocks (key, block, other)."""
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "content", "component", "told", "shingles")
    return pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "content").mapInArrow(_compare, "a long, b long")


def _apart(led: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between contents that collide but are in different ``classes`` (node,
    component) so far.  Of a key whose contents are in several classes, those outside the
    largest one are compared with all others, in blocks; two representatives of a key
    were compared before."""
    classes = classes.withColumnRenamed("node", "content")

    def classed(rows):
        return rows.join(classes, "content", "left").withColumn("component", F.coalesce("component", "content")).withColumn("told", F.col("what") == LEADER)

    sizes = classed(led.select("what", "key", "content")).groupBy("key", "component").agg(F.count("*").alias("n"), F.min("told").alias("told"))
    keys = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.min("told").alias("done")).where("n > most and not done").drop("done")
    keys = stored(keys, "keys-apart")
    # shingles of other keys stay where they are; either way gives the same rows
    rows = led.join(F.broadcast(keys), "key") if keys.count() <= KEYS else join_one(led, keys, "key", "content")
    rows = classed(rows).withColumn("few", F.ceil((F.col("n") - F.col("most")) / BLOCK)).withColumn("many", F.ceil(F.col("most") / BLOCK))
    # blocks of the largest class follow the others, and are not compared with each other
    main, dealt = F.col("component") == F.col("main"), F.xxhash64("content", F.lit(3))
    rows = rows.withColumn("block", F.when(main, F.col("few") + F.pmod(dealt, F.col("many"))).otherwise(F.pmod(dealt, F.col("few"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    return _compared(rows)


def near_links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) between contents of ``own`` (content, doc_id, start, size, bands): their
    components are those of all colliding pairs."""
    bands = own.select(F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("key"), "content")
    often = frequent(bands.where(F.pmod("content", F.lit(SAMPLE)) == 0))
    hot = F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in often], "key long"))  # at most KEYS
    rest = bands.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "content").mapInArrow(_collide, "key long, content long")
    candidates = stored(rest.unionByName(bands.join(hot, "key", "left_semi")), "collisions")
    units = own.select("content", "doc_id", "start", "size").join(candidates.select("content").distinct(), "content", "left_semi")
    wanted = units.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "content")).alias("wanted"))
    sets = docs.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_shingle_sets, "content long, shingles binary").dropDuplicates(["content"])
    groups = candidates.join(sets, "content").withColumn("salt", F.pmod(F.xxhash64("content"), F.lit(SALTS)))
    groups = groups.select("key", "salt", "content", "shingles").repartition("key", "salt").sortWithinPartitions("key", "salt", "content")
    led = stored(groups.mapInArrow(_represent, "what byte, key long, content long, leader long, shingles binary"), "representatives")
    leaders = with_totals(led.where(F.col("what") == LEADER).select("key", "content", "shingles", F.lit(1).alias("one")), "key", "content", n=("sum", "one")).where("n > 1")
    leaders = leaders.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("content", F.lit(3)), F.col("blocks")))
    more = _compared(leaders.withColumn("component", F.col("content")).withColumn("told", F.lit(False)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    links = led.where(F.col("what") == LINK).select(F.col("leader").alias("a"), F.col("content").alias("b"))
    first = stored(links.unionByName(more).distinct(), "first-links")
    classes = stored(components(first, "a", "b"), "first-classes")
    stars = classes.select(F.col("component").alias("a"), F.col("node").alias("b"))
    found = stored(stars.unionByName(_apart(led, classes)).distinct(), "line-links")
    discard(candidates, led, first, classes)
    return found


def near_pieces(docs: DataFrame) -> DataFrame:
    """The lines of ``docs`` (doc_id, text) that other documents repeat or nearly repeat,
    as pieces."""
    lines = stored(docs.mapInArrow(_own_lines, LINES), "lines")
    bands = [F.max(f"b{k}").alias(f"b{k}") for k in range(BANDS)]  # equal for equal contents
    own = lines.groupBy("content").agg(F.count("*").alias("n"), F.min_by("start", "doc_id").alias("start"), F.max("size").alias("size"), F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), *bands)
    own = stored(own, "contents")
    links = near_links(docs, own)
    classes = components(links, "a", "b").withColumnRenamed("node", "content")
    discard(links)
    named = own.select("content", "n", "doc_id", "last").join(classes, "content", "left").where("component is not null or doc_id <> last")
    named = named.withColumn("component", F.coalesce("component", "content"))
    named = with_totals(named, "component", "content", first_doc_id=("min", "doc_id"), final=("max", "last")).where("first_doc_id <> final")
    named = stored(named.select("content", "n", F.col("component").alias("component_id"), "first_doc_id"), "line-classes")
    discard(own)
    most = max(HOT, lines.count() // KEYS)
    hot = F.broadcast(named.where(F.col("n") > most).drop("n"))  # at most KEYS
    places = lines.select("content", "doc_id", "start", "size")
    found = places.join(hot, "content").unionByName(places.join(hot, "content", "left_anti").join(named.where(F.col("n") <= most).drop("n"), "content"))
    return found.select("doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("removed"), "start", (F.col("start") + F.col("size")).alias("stop"), "component_id", "first_doc_id")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (doc_id, text), the passages that other documents repeat or nearly
    repeat: a row per document and passage (spans of words), those that stay included.

    component_id is a class of windows or lines in the passage (the smallest), first_doc_id
    the document in which its text stays.  Words stand between ASCII white space and A-Z is
    lower-cased.  Null and empty texts, and texts of fewer than 25 words, have no rows;
    neither have rows with a null doc_id.  Rows with equal doc_id count as one document.
    A run of one repeated word keeps its first words.  No passage gives an empty table.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    pieces = equal_pieces(docs).unionByName(near_pieces(docs))
    return pieces.repartition("doc_id").sortWithinPartitions("doc_id", "removed", "start").mapInArrow(_merge, SPANS)


def cut(text: str, spans: list[dict]) -> str:
    """``text`` without the words of the spans; what is left is joined by line breaks."""
    data = text.encode()
    at, out, last = [m.span() for m in _WORD.finditer(data)], [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        out.append(data[last : at[s["start"]][0]].rstrip())
        last = at[s["stop"] - 1][1]
    out.append(data[last:].lstrip())
    return b"\n".join(x for x in out if x).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed everywhere but in their first document;
    n_chars, if there is such a column, is set anew.  A document of which nothing is left
    goes; all others stay, in their old columns."""
    spans = repeated_passages(docs).where("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in slices(batches):
            columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            spans, keep = columns.pop("__spans").to_pylist(), pa.array([True] * batch.num_rows)
            if any(spans):
                text = [cut(t, s) if s and t else t for t, s in zip(columns["text"].to_pylist(), spans)]
                keep = pa.array([bool(t) or not s for t, s in zip(text, spans)], pa.bool_())
                columns["text"] = pa.array(text, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in text], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[f] for f in names], names=names).filter(keep)

    return docs.join(spans, "doc_id", "left").select(*names, "__spans").mapInArrow(run, schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repeated_passages(table(spark, sf_dir, "documents"))
