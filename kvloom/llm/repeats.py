"""Removal of bytes that lie in a repeated 100-byte string, by merging Burrows-Wheeler transforms.

Windows are the WINDOW-byte strings inside documents. Each is filed under its
anchor, the least hash among its ANCHOR-byte substrings: equal windows have
equal anchors, so a window whose anchor occurs once in the corpus is not
repeated. Consecutive windows of one anchor form an item, (start, windows).

1. Items. Every task packs (anchor hash, digest of the item's bytes, document,
   start) into hash ranges; items that a task holds more than once are settled
   there, so a passage in a third of all documents sends one item for each task.
   A range finds items equal to an earlier item, which lose all windows, and
   open items: first of their bytes, with an anchor that also occurs in other
   bytes or more than once in their own.
2. Transforms. The bytes of open items meet by anchor, in groups of about MERGE
   bytes, and are cut into shards of at most SHARD bytes. Each shard sorts its
   own suffixes, once, into its Burrows-Wheeler transform.
3. Merge. The shards' transforms are interleaved by refinement: all suffixes
   begin as one block, shard after shard; each round reads the transforms'
   symbols in the order so far, sorts stably by them and steps each entry to its
   predecessor, so that round h orders by h symbols. A boundary that appears in
   round h + 1 parts suffixes with a common prefix of h symbols. What is alone in
   its block is settled and left out; the blocks that remain after WINDOW rounds
   are the intervals of repeated windows. No suffix is sorted again and no text
   is read. The first window of an interval, in document order, stays.
4. Removed windows become spans of their documents.

An anchor with more than HOT open items would make a large group: its items are
filed anew, in a second way, under anchors of LONG bytes.

Only items of one 128-bit BLAKE2 digest count as equal without a comparison of
their bytes. Hashes of anchors need not be free of collisions: an anchor that
two strings share only makes more items open, and the merge compares bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.common import give_back, materialize, quoted, shuffle_partitions, table, tidy

WINDOW, ANCHOR, LONG = 100, 24, 62
#: Bytes hashed at a time; items packed at a time; windows of an item at most.
PIECE, SHARD_ITEMS, ITEM_WINDOWS = 1 << 19, 300_000, 2048
#: Text bytes for each hash range of step 1, open bytes for each group of step 2, bytes of a shard.
RANGE, MERGE, SHARD = 16 << 20, 2 << 20, 1 << 19
#: Windows that refinement takes at a time.
MERGE_WINDOWS = 500_000
#: Open items of an anchor from which on they are filed under longer anchors.
HOT = 4096
U = np.uint64
M1, M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * M2
    return h ^ (h >> U(29))


def hashes(x: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all substrings of width bytes (8 or more): equal substrings, equal hashes. Words of 8 bytes are mixed in turn, so that no pattern of bytes cancels out."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    words = np.empty(len(x) - 7, U)
    for i in range(min(8, len(words))):
        own = np.frombuffer(x[i : i + (len(x) - i) // 8 * 8].tobytes(), "<u8")
        words[i::8] = own
    h = np.full(n, U(width), U)
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        h = _mix((h ^ words[at : at + n]) * M1)
    return h


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of a cryptographic hash of each stretch, as two integers."""
    return np.frombuffer(b"".join([hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def _rolling(h: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = pick(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return pick(h[: len(h) - rest], h[rest:]) if rest else h


def _runs(h: np.ndarray, width: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the items of the windows at whole: runs of one anchor of width bytes, whose hashes h has, cut at ITEM_WINDOWS."""
    value = _rolling(h, WINDOW - width + 1, np.minimum)[whole]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (np.diff(whole) != 1)))
    windows = np.diff(np.append(first, len(whole)))
    times = -(-windows // ITEM_WINDOWS)
    piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    first, windows = np.repeat(first, times) + piece * ITEM_WINDOWS, np.repeat(windows, times) - piece * ITEM_WINDOWS
    return whole[first], np.minimum(windows, ITEM_WINDOWS), value[first]


def items_of(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(piece, start, windows, anchor, bytes' digest, open) of all items of some texts."""
    size = np.array([len(p) for p in pieces])
    data = b"".join(pieces)
    x = np.frombuffer(data, np.uint8)
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U)), np.zeros((0, 2), U), np.zeros(0, bool))
    if len(x) < WINDOW:
        return none
    ends = np.cumsum(size)
    h, span = hashes(x, ANCHOR), WINDOW - ANCHOR + 1
    owner = np.repeat(np.arange(len(size)), size)[: len(x) - WINDOW + 1]
    at = np.flatnonzero(np.arange(len(owner)) + WINDOW <= ends[owner])  # windows that lie in one piece
    if not len(at):
        return none
    start, windows, anchor = _runs(h, ANCHOR, at)
    content = digests(data, start, start + windows + WINDOW - 1)
    # Places of anchors: the greatest of the minima of the windows around a place is its own hash.
    padded = np.concatenate([np.zeros(span - 1, U), _rolling(h, span, np.minimum), np.zeros(span - 1, U)])
    places = np.flatnonzero(_rolling(padded, span, np.maximum)[: len(h)] == h)
    # Items whose anchor occurs twice in their own bytes.
    values, rank = np.unique(h[places], return_inverse=True)
    keys = np.sort(rank.astype(np.int64) << 40 | places)
    own = np.searchsorted(values, anchor).astype(np.int64) << 40
    twice = np.searchsorted(keys, own | (start + windows + span - 1)) - np.searchsorted(keys, own | start) > 1
    piece = owner[start]
    return piece, start - (ends - size)[piece], windows, anchor, content, twice


def _pieces(text: bytes):
    """(offset, bytes): stretches of at most PIECE windows, overlapping by WINDOW - 1 bytes."""
    for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
        yield at, text[at : at + PIECE + WINDOW - 1]


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _key(anchor: np.ndarray) -> np.ndarray:
    """32 bits that deal anchors evenly; as least hashes, anchors themselves are small numbers."""
    return (_mix(anchor) >> U(32)).astype(np.uint32)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (key.astype(U) * U(parts) >> U(32)).astype(np.int64)


#: row: hash of the text, so that rows with one id and other texts are documents of their own.
ITEM = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("windows", "<i2"), ("twice", "?")])
SPANS = np.dtype([("start", "<i4"), ("windows", "<i4")])
OPEN = np.dtype([("start", "<i4"), ("windows", "<i2"), ("key", "<u4"), ("hot", "?")])


def _differ(content: np.ndarray) -> np.ndarray:
    """Whether each digest but the first is another one than that before it."""
    return (content[1:] != content[:-1]).any(axis=1)


def _item_order(item: np.ndarray, *outer: np.ndarray) -> np.ndarray:
    return np.lexsort((item["start"], item["row"], item["doc"], *outer))


def _pack_shards(docs: DataFrame, parts: int) -> DataFrame:
    """(part, kind, anchors, contents, items): kind 0 holds items by hash range, kind 1 items that repeat in their shard."""
    def run(batches):
        texts: list[bytes] = []
        ids: list[tuple[int, int, int]] = []
        held: list[tuple] = []
        size = n = 0

        def hash_texts():
            nonlocal texts, ids, size, n
            piece, start, windows, anchor, content, twice = items_of(texts)
            item = np.zeros(len(piece), ITEM)
            doc = np.array(ids, np.int64).reshape(-1, 3)
            item["doc"], item["row"], item["start"] = doc[piece, 0], doc[piece, 1], start + doc[piece, 2]
            item["windows"], item["twice"] = windows, twice
            held.append((anchor, content, item))
            n += len(piece)
            texts, ids, size = [], [], 0

        def emit():
            nonlocal held, n
            anchor, content, item = (np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
            part = _part(_key(anchor), parts)
            order = _item_order(item, content[:, 0], anchor, part)
            part, anchor, content, item = part[order], anchor[order], content[order], item[order]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | _differ(content))[: len(anchor)]
            again = ~new & ~_repeated_rows(item)
            rows = []
            cuts = np.searchsorted(part[new], np.arange(parts + 1))
            a, c, i = anchor[new], content[new], item[new]
            for p in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[p], cuts[p + 1])
                rows.append((int(p), 0, _six(a[s]), c[s].tobytes(), i[s].tobytes()))
            i = item[again]
            to = _part(_key(i["doc"].astype(U)), parts)
            order = np.argsort(to, kind="stable")
            i, to = i[order], to[order]
            cuts = np.searchsorted(to, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                rows.append((int(p), 1, b"", b"", i[cuts[p] : cuts[p + 1]].tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["part", "kind", "anchors", "contents", "items"])

        for b in batches:
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for at, piece in _pieces(text.as_py()):
                    texts.append(piece)
                    ids.append((doc, row, at))
                    size += len(piece)
                    if size >= PIECE:
                        hash_texts()
                        if n >= SHARD_ITEMS:
                            yield emit()
        if texts:
            hash_texts()
        if n:
            yield emit()

    return docs.mapInArrow(tidy(run), "part int, kind int, anchors binary, contents binary, items binary")


FOUND = "doc long, row long, open boolean, size long, found binary"


def _by_doc(item: np.ndarray, value: np.ndarray, opened: bool) -> pa.Table:
    """Rows of FOUND: values of each document packed; size counts the bytes under them."""
    order = np.lexsort((item["row"], item["doc"]))
    item, value = item[order], value[order]
    cut = np.flatnonzero(np.append(True, (item["doc"][1:] != item["doc"][:-1]) | (item["row"][1:] != item["row"][:-1])))[: len(item)]
    ends, wide, raw = np.append(cut[1:], len(item))[: len(cut)], value.dtype.itemsize, value.tobytes()
    size = np.add.reduceat(value["windows"].astype(np.int64) + WINDOW - 1, cut) if len(cut) else np.zeros(0, np.int64)
    return pa.table({
        "doc": pa.array(item["doc"][cut], pa.int64()), "row": pa.array(item["row"][cut], pa.int64()), "open": pa.array(np.full(len(cut), opened), pa.bool_()),
        "size": pa.array(size, pa.int64()), "found": pa.array([raw[wide * a : wide * z] for a, z in zip(cut, ends, strict=True)], pa.binary()),
    })


def _repeated_rows(item: np.ndarray) -> np.ndarray:
    """Whether the item before is the same one: it comes from a row that repeats id and text."""
    same = (item["doc"][1:] == item["doc"][:-1]) & (item["row"][1:] == item["row"][:-1]) & (item["start"][1:] == item["start"][:-1])
    return np.append(False, same)[: len(item)]


def _settle(shards: DataFrame, hot: int) -> DataFrame:
    """FOUND: items that lose all windows (SPANS), and open items (OPEN)."""
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_pylist()
        raw = t.column("items").to_pylist()
        join = lambda c: b"".join(t.column(c).to_pylist())
        again = np.frombuffer(b"".join([r for r, k in zip(raw, kind, strict=True) if k]), ITEM)
        item = np.frombuffer(b"".join([r for r, k in zip(raw, kind, strict=True) if not k]), ITEM)
        anchor, content = _from_six(join("anchors")), np.frombuffer(join("contents"), "<u8").reshape(-1, 2)
        order = _item_order(item, content[:, 0], anchor)
        anchor, content, item = anchor[order], content[order], item[order]
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]
        new = new_anchor | np.append(True, _differ(content))[: len(anchor)]
        group = np.cumsum(new_anchor) - 1
        contents = np.bincount(group, new, minlength=1)[group] if len(group) else np.zeros(0)
        lost = np.concatenate([item[~new & ~_repeated_rows(item)], again])
        open_at = new & ((contents > 1) | item["twice"])
        stay = item[open_at]
        spans, opened = np.zeros(len(lost), SPANS), np.zeros(len(stay), OPEN)
        spans["start"], spans["windows"] = lost["start"], lost["windows"]
        opened["start"], opened["windows"] = stay["start"], stay["windows"]
        opened["key"], opened["hot"] = _key(_mix(anchor[open_at])), contents[open_at] > hot
        out = pa.concat_tables([_by_doc(lost, spans, False), _by_doc(stay, opened, True)])
        give_back()
        return out

    return shards.groupBy("part").applyInArrow(run, FOUND)


# Transforms ------------------------------------------------------------


class Transform:
    """Burrows-Wheeler transform of some strings, each ended by a terminator of its own that is less than all bytes.

    last: the symbol before each suffix in suffix order, byte + 1 (0 before a
    whole string); step: the place of the suffix that is longer by that symbol;
    string, offset: where the suffix begins.
    """

    def __init__(self, x: np.ndarray, length: np.ndarray):
        m = len(length)
        size = length + 1
        begin = np.cumsum(size) - size
        self.n = n = int(size.sum())
        owner = np.repeat(np.arange(m), size)
        offset = np.arange(n) - begin[owner]
        y = np.zeros(n, np.int16)
        y[offset < length[owner]] = x.astype(np.int16) + 1
        order = self._sorted(y, owner, size[owner] - offset)
        self.last = np.where(offset[order] > 0, y[order - 1], 0).astype(np.uint16)
        # The place of a suffix is that of its first symbol among the symbols of the transform.
        self.step = np.empty(n, np.int32)
        self.step[np.argsort(self.last, kind="stable")] = np.arange(n)
        self.string, self.offset = owner[order].astype(np.int32), offset[order].astype(np.int32)

    @staticmethod
    def _sorted(y: np.ndarray, owner: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """All suffixes in order; rest: symbols up to and with the terminator. By 7 symbols, then by doubling where suffixes still agree."""
        n, k = len(y), 7
        wide = np.append(y, np.zeros(k, y.dtype)).astype(np.int64)
        key = np.zeros(n, np.int64)
        for i in range(k):
            key = key << 9 | np.where(rest > i, wide[i : i + n], 0)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.append(True, sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        todo = order[~(new & np.append(new[1:], True))]
        m = int(owner[-1]) + 1 if n else 0
        while len(todo):
            # Behind a terminator the strings' order decides.
            ended = rest[todo] <= k
            second = np.where(ended, owner[todo], m + rank[np.minimum(todo + k, n - 1)])
            pair = rank[todo] * (n + m + 1) + second
            by = np.argsort(pair, kind="stable")
            todo, pair = todo[by], pair[by]
            old = rank[todo]
            at = np.arange(len(todo))
            new_old, new = np.append(True, old[1:] != old[:-1]), np.append(True, pair[1:] != pair[:-1])
            rank[todo] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
            todo = todo[~(new & np.append(new[1:], True))]
            k *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return order


def interleave(shards: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, interval): suffixes of all shards whose first ``rounds`` symbols another suffix has too, interval by interval.

    Entries are places in the shards' transforms, one shard after the other. The
    rounds read transforms only.
    """
    base = np.cumsum([0] + [t.n for t in shards])
    last = np.concatenate([t.last for t in shards])
    step = np.concatenate([(t.step + b).astype(np.int32) for t, b in zip(shards, base[:-1], strict=True)])
    # Before the first round: the places behind all windows, each shard in its own order.
    behind = np.flatnonzero(np.concatenate([t.offset for t in shards]) >= rounds)
    times = max(1, -(-len(behind) // MERGE_WINDOWS))
    # Suffixes of other first symbols never meet again: parts by the last two symbols of the windows.
    two = last[behind].astype(np.int64) * 257 + last[step[behind]]
    part = (two * 0x9E3779B1 >> 7) % times
    entries, intervals, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i in range(times):
        entry, block = _refine(last, step, behind[part == i], rounds)
        entries.append(entry)
        intervals.append(block + n)
        n += int(block[-1]) + 1 if len(block) else 0
    return np.concatenate(entries), np.concatenate(intervals)


def _refine(last: np.ndarray, step: np.ndarray, entry: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    block = np.zeros(len(entry), np.int32)
    for _ in range(rounds):
        if not len(entry):
            break
        symbol = last[entry]
        by = np.argsort(symbol, kind="stable")
        entry, block, symbol = entry[by], block[by], symbol[by]
        # Same symbol here and same block before: these agree in one more symbol.
        new = np.append(True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))
        several = ~(new & np.append(new[1:], True))
        entry, block = step[entry[several]], (np.cumsum(new[several]) - 1).astype(np.int32)
    return entry, block


def repeated_windows(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, first): windows in strings joined in x that an earlier place repeats, and the first place of each one's interval.

    The strings are cut into shards of about SHARD bytes, whose transforms are merged.
    """
    begin = np.cumsum(length) - length
    shard = begin // SHARD
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    shards, places = [], []
    for a, z in zip(cuts, np.append(cuts[1:], len(length)), strict=True):
        t = Transform(x[begin[a] : begin[z - 1] + length[z - 1]], length[a:z])
        shards.append(t)
        places.append(begin[a:z][t.string] + t.offset)
    entry, interval = interleave(shards, WINDOW)
    if not len(entry):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.concatenate(places)[entry]
    start = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    first = np.repeat(np.minimum.reduceat(place, start), np.diff(np.append(start, len(place))))
    later = place != first
    return place[later], first[later]


def _strings(x: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The bytes of some of the strings that are joined in x, in the order of which."""
    size = length[which]
    shift = (np.cumsum(length) - length)[which] - (np.cumsum(size) - size)
    return x[np.repeat(shift, size) + np.arange(size.sum())]


def _filed_anew(data: bytes, start: int) -> list[tuple[int, int, int, bytes]]:
    """(key, start, windows, bytes) of an item's windows under anchors of LONG bytes."""
    x = np.frombuffer(data, np.uint8)
    at, windows, anchor = _runs(hashes(x, LONG), LONG, np.arange(len(x) - WINDOW + 1))
    key = _key(_mix(anchor + M2))
    return [(k, start + a, n, data[a : a + n + WINDOW - 1]) for k, a, n in zip(key.tolist(), at.tolist(), windows.tolist(), strict=True)]


def _open_bytes(docs: DataFrame, opened: DataFrame, parts: int) -> DataFrame:
    """(part, items, lengths, data): bytes of open items by the hash range of their anchors."""
    schema = "part int, items binary, lengths binary, data binary"

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def emit():
            nonlocal held, size
            cols: list[list] = [[] for _ in range(4)]
            press = zstandard.ZstdCompressor(level=3)
            for part, own in held.items():
                item = np.zeros(len(own), ITEM)
                for i, name in enumerate(("doc", "row", "start")):
                    item[name] = [o[i] for o in own]
                values = (part, item.tobytes(), np.array([len(o[3]) for o in own], "<i4").tobytes(), press.compress(b"".join([o[3] for o in own])))
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            held, size = {}, 0
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "items", "lengths", "data"])

        for b in batches:
            for doc, row, raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                text = _raw(raw.as_py())
                for start, windows, key, hot in np.frombuffer(b"".join(found), OPEN).tolist():
                    data = text[start : start + windows + WINDOW - 1]
                    for k, at, _, some in _filed_anew(data, start) if hot else [(key, start, windows, data)]:
                        held.setdefault(k * parts >> 32, []).append((doc, row, at, some))
                        size += len(some) + 100
                if size >= 1 << 24:
                    yield emit()
        if held:
            yield emit()

    rows = opened.groupBy("doc", "row").agg(F.collect_list("found").alias("found"))
    met = docs.join(rows.hint("shuffle_hash"), ["doc", "row"]).select("doc", "row", "z", "found")
    return met.mapInArrow(tidy(run), schema)


def _merge_ranges(shards: DataFrame) -> DataFrame:
    """FOUND: windows of open items that an earlier window repeats (SPANS)."""
    def run(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        item, length = join("items", ITEM), join("lengths", "<i4").astype(np.int64)
        x = np.frombuffer(b"".join([_raw(d.as_py()) for d in t.column("data")]), np.uint8)
        # Document order, so that the first of an interval is the first occurrence. Rows that repeat id and text bring an item once.
        order = _item_order(item)
        order = order[~_repeated_rows(item[order])]
        x, item, length = _strings(x, length, order), item[order], length[order]
        place = np.sort(repeated_windows(x, length)[0])
        string = np.repeat(np.arange(len(length)), length)[place]
        begin = np.cumsum(length) - length
        cut = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (string[1:] != string[:-1]))[: len(place)])
        spans = np.zeros(len(cut), SPANS)
        s = string[cut]
        spans["start"] = item["start"][s] + place[cut] - begin[s]
        spans["windows"] = np.diff(np.append(cut, len(place)))
        out = _by_doc(item[s], spans, False)
        give_back()
        return out

    return shards.groupBy("part").applyInArrow(run, FOUND)


def _press(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def _raw(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pressed(rows: DataFrame, kind: str) -> DataFrame:
    """(doc, row, z): texts compressed for the shuffle."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_press(t.as_py()) for t in b.column(2)], pa.binary())], names=["doc", "row", "z"])

    return rows.mapInArrow(tidy(run), f"doc {kind}, row long, z binary")


def repeated_spans(found: list[bytes], size: int) -> np.ndarray:
    """(start, end) rows of the maximal runs of bytes that removed windows cover."""
    spans = np.frombuffer(b"".join(found), SPANS)
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(spans["start"], kind="stable")
    start = spans["start"][order].astype(np.int64)
    end = np.maximum.accumulate(start + spans["windows"][order] + WINDOW - 1)
    new = np.append(True, start[1:] > end[:-1])
    return np.stack([start[new], np.minimum(end[np.append(new[1:], True)], size)], axis=1)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc, row, found): packed removed windows of each document that has some; row is xxhash64 of the text."""
    spark = docs.sparkSession
    text = F.col(quoted(text_col)).cast("binary")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("t"))
    rows = rows.filter(F.col("doc").isNotNull() & (F.octet_length("t") >= WINDOW))
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    settled = materialize(_settle(_pack_shards(rows, max(2 * shuffle_partitions(spark), -(-total // RANGE))), hot), "repeats-settled")
    opened = settled.filter("open")
    size = opened.agg(F.sum("size")).first()[0] or 0
    shards = _open_bytes(_pressed(rows, "long"), opened, max(shuffle_partitions(spark), -(-size // MERGE)))
    merged = _merge_ranges(shards)
    every = settled.filter("not open").select("doc", "row", "found").union(merged.select("doc", "row", "found"))
    return every.groupBy("doc", "row").agg(F.collect_list("found").alias("found"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for each row.

    Defined cases: null and empty texts have no bytes; texts under WINDOW bytes
    lose nothing; rows with a null id take no part and lose nothing; rows that
    repeat id and text are one document given again, and each gives its result;
    rows that repeat an id with other texts are documents of their own, in order
    of a hash of the text.
    """
    return _apply(docs, id_col, text_col, "kept binary", pa.binary(), bytes, hot)


def _apply(docs: DataFrame, id_col: str, text_col: str, last: str, kind: pa.DataType, finish, hot: int = HOT) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    found = find_repeats(docs, id_col, text_col, hot)
    text = F.coalesce(F.col(quoted(text_col)).cast("binary"), F.lit(b""))
    texts = _pressed(docs.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("t")), id_type)
    same = (F.col("x.doc") == F.col("f.doc")) & (F.col("x.row") == F.col("f.row"))
    met = texts.alias("x").join(found.alias("f").hint("shuffle_hash"), same, "left").select("x.doc", "z", "found")

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for z, f in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                text = _raw(z.as_py())
                spans = repeated_spans(f or [], len(text))
                at, kept = 0, []
                for s, e in spans.tolist():
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                for c, v in zip(out, (len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), finish(b"".join(kept))), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], kind)], names=[id_col, "n_bytes", "n_removed", "n_spans", last.split()[0]])

    return met.mapInArrow(tidy(run), f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, {last}")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _apply(docs, "doc_id", "text", "kept_sha256 string", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest())
