"""Operator 9, suffix-array dedup: byte strings of `length` that occurred before are removed.

Every byte covered by a string of `length` (100) bytes that also starts earlier (smaller doc_id, or
same document and smaller offset) goes; strings are judged on the input and never cross documents.

Sorting all suffixes of a large corpus at once would move each byte many times, so suffixes are dealt
out first, without losing a repeat:

1. Every window of 100 bytes has an anchor, the smallest hash among its 69 substrings of 32 bytes. It
   follows from the window's bytes alone, so equal windows have equal anchors at equal offsets.
   Consecutive windows mostly share an anchor; such a run and its bytes make a stretch. Anchors that
   occur once in the corpus are done: their windows have no equal.
2. Stretches of repeated anchors are grouped by anchor. Of stretches with equal bytes and offsets only
   the earliest stays in; all windows of the others are repeats of its windows.
3. The different stretches of an anchor go through the suffix sort, as windows in segments of (anchor,
   offset). Prefix polynomial hashes give the hash of any substring in constant time; binary search
   over them finds how far two suffixes agree, so a comparison is logarithmic, and a bottom-up
   mergesort (all segments of a batch at once) orders each segment. Neighbours that agree on 100
   bytes by hash are compared byte by byte; in each class of equal windows all but the earliest are
   repeats. Anchors that occur over `HOT` times don't meet in one task: runs of their stretches
   without the outermost, then equal stretches of what is left, then equal blocks of 16 and of 4
   windows, laid from the anchor, then equal windows are found by partial aggregation on their bytes,
   and only the earliest of each goes on to the next of these. Equal blocks hold equal windows in equal
   order, so no window loses its earliest place. Blocks whose shared bytes occur once at their anchor
   hold no repeat and end there.
4. The repeated windows' spans go back to their documents.

A document whose whole text occurs at a smaller doc_id is removed entirely (from 100 bytes on) and
takes no further part, which changes nothing for the others. Two 64-bit hashes name a text.

Null text: empty, nothing removed. Rows that repeat both id and text are one document and get equal
results; rows of one id with other texts are ordered by the text's hashes. A null id comes first. An
empty table gives no rows. Texts under 100 bytes stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, corpus, hash_spans, mix, partitions, ragged, slices, table, unwrapped, utf8, wrapped, written

LENGTH, GRAM = 100, 32
#: Occurrences of an anchor from which its stretches are dealt out; bytes of a batch of whole anchors.
HOT, BATCH = 300, 1 << 19
#: Windows of a block, for anchors of over HOT occurrences; each size divides the one before.
BLOCKS = (16, 4)
#: Bytes of text that are hashed at once.
SLICE = 1 << 18
TEXT = ["ka", "kb"]
_B = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _upto(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def grams(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Polynomial hashes of all substrings of n bytes (a power of two), by doubling."""
    h, size, factor = _BYTE[data], 1, _B
    while size < n:
        h = h[: len(h) - size] * factor + h[size:]
        factor, size = np.uint64(int(factor) ** 2 & (1 << 64) - 1), 2 * size
    return mix(h)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """row, anchor hash, anchor offset, first and last window start (all in the whole buffer) of every run of
    consecutive windows of one row with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none, none
    h = grams(data)
    bits = max(int(len(h)).bit_length(), 1)
    low = h >> np.uint64(bits) << np.uint64(bits) | np.arange(len(h), dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    anchor = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= offsets[row + 1]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.flatnonzero(np.append(change[1:] | ~valid[1:], True) & valid)
    return row[first], h[anchor[first]], anchor[first], first, stop


def suffix_sort(data: np.ndarray, starts: np.ndarray, segments: np.ndarray, limit: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Orders the suffixes that begin at `starts`, cut to `limit` bytes, within each segment (segments
    are ascending). Stable mergesort; comparisons by hash and binary search. Gives the order and, for
    each place, the bytes it has in common with the place before (0 at a segment's first)."""
    n = len(starts)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _upto(_B, len(data)), dtype=np.uint64)))
    back = _upto(_INVERSE, len(data) + 1)
    steps = [1 << i for i in range(limit.bit_length() - 1, -1, -1)]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        for step in steps:
            fits = np.flatnonzero(got + step <= limit)
            x, y = a[fits] + got[fits], b[fits] + got[fits]
            equal = (prefix[x + step] - prefix[x]) * back[x] == (prefix[y + step] - prefix[y]) * back[y]
            got[fits[equal]] += step
        return got

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = common(a, b)
        at = np.minimum(shared, limit - 1)
        return (shared < limit) & (data[a + at] < data[b + at])

    order = np.arange(n)
    begin = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    live = size > 1
    begin_of, size_of = np.repeat(begin, size), np.repeat(size, size)
    width = 1
    while live.any() and width < size.max():
        todo = np.flatnonzero(size_of > width)
        inside = todo - begin_of[todo]
        block = inside // width
        mate = (block ^ 1) * width
        mate_from = begin_of[todo] + np.minimum(mate, size_of[todo])
        mate_to = begin_of[todo] + np.minimum(mate + width, size_of[todo])
        left = block % 2 == 0
        low, high = mate_from.copy(), mate_to.copy()
        own = starts[order[todo]]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            other = starts[order[middle]]
            mine, lefts = own[open_], left[open_]
            # A left element goes before equals of the right block, a right one after equals of the left.
            before = less(np.where(lefts, other, mine), np.where(lefts, mine, other))
            right = np.where(lefts, before, ~before)
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        place = begin_of[todo] + (block // 2) * 2 * width + inside % width + (low - mate_from)
        merged = order.copy()
        merged[place] = order[todo]
        order = merged
        width *= 2
    shared = np.zeros(n, np.int64)
    tied = np.flatnonzero(np.concatenate(([False], segments[1:] == segments[:-1]))) if n else np.zeros(0, np.int64)
    shared[tied] = common(starts[order[tied - 1]], starts[order[tied]])
    return order, shared


def repeated_windows(data: np.ndarray, starts: np.ndarray, segments: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Which of the windows equal one that comes before it in its segment. Windows of a segment are given
    in corpus order."""
    order, shared = suffix_sort(data, starts, segments, limit)
    same = np.flatnonzero(shared == limit)
    # Hashes may collide: the bytes decide.
    for at in range(0, len(same), 1 << 14):
        chunk = same[at : at + (1 << 14)]
        grid = np.arange(limit)
        unequal = (data[starts[order[chunk - 1]][:, None] + grid] != data[starts[order[chunk]][:, None] + grid]).any(1)
        shared[chunk[unequal]] = limit - 1
    out = np.zeros(len(starts), bool)
    out[order[np.flatnonzero(shared == limit)]] = True
    return out


def runs(flags: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within equal keys."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = flags & (new | np.concatenate(([True], ~flags[:-1])))
    last = flags & np.concatenate((new[1:] | ~flags[1:], [True]))
    return np.flatnonzero(first), np.flatnonzero(last)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and anchor, with how often it occurs there."""
    for part in slices(batches, most=SLICE):
        row, anchor, *_ = stretches(*utf8(part.column("text")))
        if len(row):
            order = np.lexsort((anchor, row))
            row, anchor = row[order], anchor[order]
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]))))
            times = np.diff(np.append(first, len(row)))
            yield pa.record_batch({"anchor": pa.array(anchor[first].view(np.int64)), "ka": part.column("ka").take(pa.array(row[first])), "times": pa.array(times.astype(np.int32))})


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches whose anchors are among the row's `anchors`."""
    for part in slices(batches, most=SLICE):
        data, offsets = utf8(part.column("text"))
        row, anchor, at, first, last = stretches(data, offsets)
        again, signed = part.column("anchors").to_pylist(), anchor.view(np.int64)
        keep = np.zeros(len(row), bool)
        edges = np.searchsorted(row, np.arange(part.num_rows + 1))
        for r in range(part.num_rows):
            a, b = edges[r], edges[r + 1]
            if b > a:
                keep[a:b] = np.isin(signed[a:b], np.asarray(again[r], np.int64))
        row, signed, at, first, last = row[keep], signed[keep], at[keep], first[keep], last[keep]
        if len(row):
            raw, of = data.tobytes(), pa.array(row)
            yield pa.record_batch(
                {"anchor": pa.array(signed), "doc_id": part.column("doc_id").take(of), "ka": part.column("ka").take(of), "kb": part.column("kb").take(of), "start": pa.array(first - offsets[row]),
                 "lead": pa.array((at - first).astype(np.int32)), "bytes": pa.array([raw[a : b + LENGTH] for a, b in zip(first, last, strict=True)], pa.binary())}
            )


STRETCH = "anchor long, doc_id long, ka long, kb long, start long, lead int, bytes binary"
SPANS = "ka long, kb long, start long, stop long"


def _solve(rows: pa.Table) -> pa.RecordBatch:
    """The repeated spans of whole anchors' stretches, which come in corpus order within an anchor."""
    rows = rows.combine_chunks()
    blob = rows.column("bytes").combine_chunks()
    data, offsets = utf8(blob)
    anchor, lead, begin = (rows.column(c).to_numpy() for c in ("anchor", "lead", "start"))
    lead = lead.astype(np.int64)
    group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
    # Equal stretches: by hash, then by their bytes.
    name = hash_spans(data, offsets[:-1], offsets[1:]) ^ mix(lead + 1) ^ mix(group + (1 << 32))
    _, first_at, which = np.unique(name, return_index=True, return_inverse=True)
    twin = first_at[which]
    whole = np.flatnonzero(twin != np.arange(len(twin)))
    raw = data.tobytes()
    true = [raw[offsets[i] : offsets[i + 1]] == raw[offsets[j] : offsets[j + 1]] for i, j in zip(whole, twin[whole], strict=True)]
    whole = whole[np.array(true, bool)]
    single = np.ones(len(group), bool)
    single[whole] = False
    kept = np.flatnonzero(single)
    n = np.diff(offsets)[kept] - LENGTH + 1
    owner = np.repeat(kept, n)
    starts = ragged(offsets[:-1][kept], n)
    # How far a window begins before the anchor: equal windows have it equal.
    segment = group[owner] * (LENGTH + 1) + lead[owner] - (starts - offsets[owner])
    by = np.argsort(segment, kind="stable")
    flags = np.zeros(len(starts), bool)
    flags[by] = repeated_windows(data, starts[by], segment[by])
    first, last = runs(flags, owner)
    where = np.concatenate((owner[first], whole))
    inside = np.concatenate((starts[first] - offsets[owner[first]], np.zeros(len(whole), np.int64)))
    stop = np.concatenate((starts[last] - offsets[owner[first]] + LENGTH, np.diff(offsets)[whole]))
    of = pa.array(where)
    return pa.record_batch({"ka": rows.column("ka").combine_chunks().take(of), "kb": rows.column("kb").combine_chunks().take(of), "start": pa.array(begin[where] + inside), "stop": pa.array(begin[where] + stop)})


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of anchor, then of the corpus; batches of whole anchors are solved at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < BATCH:
            continue
        rows = pa.Table.from_batches(held)
        anchor = rows.column("anchor").to_numpy()
        other = np.flatnonzero(anchor != anchor[-1])
        whole, at = (int(other[-1]) + 1 if len(other) else 0), 0
        while at < whole:  # about BATCH bytes at once, up to the end of an anchor
            share = max(int(whole * BATCH / size), 1)
            end = whole if at + share >= whole else int(np.searchsorted(np.cumsum(anchor[1:whole] != anchor[: whole - 1]), np.cumsum(anchor[1:whole] != anchor[: whole - 1])[at + share - 1] + 1)) + 1
            end = min(max(end, at + 1), whole)
            yield _solve(rows.slice(at, end - at))
            at = end
        held = rows.slice(whole).to_batches()
        size = sum(b.nbytes for b in held)
    if size:
        yield _solve(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a stretch."""
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["bytes"]) - LENGTH + 1
            names = [row["bytes"][i : i + LENGTH] for i in range(n)]
            yield pa.record_batch(
                {"window": pa.array(names, pa.binary()), **{c: pa.array([row[c]] * n, pa.int64()) for c in ("doc_id", "ka", "kb")}, "start": pa.array(np.arange(row["start"], row["start"] + n))}
            )


_PLACE = ("doc_id", "ka", "kb", "start")


def _later(rows: DataFrame, keys: list[str], stop: F.Column) -> DataFrame:
    """The spans of rows that share their keys with an earlier row."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    return rows.join(first, keys).where(~F.struct(*_PLACE).eqNullSafe(F.col("first"))).select("ka", "kb", "start", stop.alias("stop"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of texts, where those that follow one another, but for the outermost two, are joined to
    one row whose lead is -1."""
    for batch in _stretches(batches):
        ka, kb, start = (batch.column(c).to_numpy() for c in ("ka", "kb", "start"))
        size = np.diff(utf8(batch.column("bytes"))[1])
        follows = np.zeros(batch.num_rows, bool)
        follows[1:] = (ka[1:] == ka[:-1]) & (kb[1:] == kb[:-1]) & (start[1:] == start[:-1] + size[:-1] - LENGTH + 1)
        inner = follows & np.append(follows[1:], False)
        yield batch.filter(pa.array(~inner))
        first, last = runs(inner, np.cumsum(~follows))
        joined = []
        for a, b in zip(first, last, strict=True):
            parts = batch.column("bytes").slice(a, b - a + 1).to_pylist()
            joined.append(b"".join([x[: len(x) - LENGTH + 1] for x in parts[:-1]] + [parts[-1]]))
        if joined:
            some = batch.take(pa.array(first))
            columns = {c: some.column(c) for c in some.schema.names} | {"lead": pa.array(np.full(len(first), -1, np.int32)), "anchor": pa.array(np.zeros(len(first), np.int64)), "bytes": pa.array(joined, pa.binary())}
            yield pa.record_batch(columns, schema=batch.schema)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of joined rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column("bytes"))
        row, anchor, at, first, last = stretches(data, offsets)
        raw, of = data.tobytes(), pa.array(row)
        begin = batch.column("start").to_numpy()[row]
        yield pa.record_batch(
            {"anchor": pa.array(anchor.view(np.int64)), **{c: batch.column(c).take(of) for c in ("doc_id", "ka", "kb")}, "start": pa.array(begin + first - offsets[row]),
             "lead": pa.array((at - first).astype(np.int32)), "bytes": pa.array([raw[a : b + LENGTH] for a, b in zip(first, last, strict=True)], pa.binary())}
        )


def _blocks(size: int):
    """Cuts stretches into blocks of `size` windows, counted from the anchor, so that equal surroundings of an
    anchor are cut alike. core: a digest of the bytes that all windows of a whole block share; without its
    equal, no window of the block has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lead, begin = (batch.column(c).to_numpy() for c in ("lead", "start"))
            n = np.diff(utf8(batch.column("bytes"))[1]) - LENGTH + 1
            row, inside = np.repeat(np.arange(batch.num_rows), n), ragged(np.zeros(len(n), np.int64), n)
            first, last = runs(np.ones(len(row), bool), row * (LENGTH + 1) + (lead[row] - inside) // size)
            of, a, b = row[first], inside[first], inside[last]
            raw = batch.column("bytes").to_pylist()
            cuts = [raw[r][i : j + LENGTH] for r, i, j in zip(of, a, b, strict=True)]
            ahead = lead[of] - a
            part = (lead[of] - b) // size
            cores = [hashlib.blake2b(x[i : i + LENGTH - size + 1], digest_size=16, salt=bytes([k])).digest() for x, i, k in zip(cuts, ahead - part * size, part, strict=True)]
            columns = {c: batch.column(c).take(pa.array(of)) for c in ("anchor", "doc_id", "ka", "kb")}
            yield pa.record_batch(columns | {"start": pa.array(begin[of] + a), "lead": pa.array(ahead.astype(np.int32)), "bytes": pa.array(cuts, pa.binary()), "core": pa.array(cores, pa.binary())})

    return run


def _equal(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of rows that repeat an earlier one byte by byte, and the rows that come first."""
    keys = ["anchor", "lead", "bytes"]
    spans = _later(rows.select(*keys, *_PLACE), keys, F.col("start") + F.octet_length("bytes"))
    return spans, rows.groupBy(*keys).agg(F.min(F.struct(*_PLACE)).alias("first")).select(*keys, "first.*")


def _hot_spans(joined: DataFrame) -> DataFrame:
    """What _sorted_groups does, for anchors of very many stretches, by partial aggregation. Each step is written,
    so that no plan holds them all."""
    names = [c.split()[0] for c in STRETCH.split(", ")]
    spans, run_first = _equal(joined.where("lead < 0"))
    found = written(spans)
    single = joined.where("lead >= 0").select(names)
    rows = written(single.unionByName(run_first.select(names).mapInArrow(_parted, STRETCH)))
    for size in BLOCKS:
        spans, apart = _equal(rows)
        found = found.union(written(spans))
        cut_up = written(apart.select(names).mapInArrow(_blocks(size), f"{STRETCH}, core binary"))
        again = cut_up.groupBy("anchor", "core").agg(F.count("*").alias("times")).where("times > 1")
        rows = cut_up.join(again, ["anchor", "core"], "left_semi").select(names)
    spans, apart = _equal(rows)
    windows = apart.select("doc_id", "ka", "kb", "start", "bytes").mapInArrow(_windows, "window binary, doc_id long, ka long, kb long, start long")
    return found.union(written(spans)).union(written(_later(windows, ["window"], F.col("start") + LENGTH)))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out = []
        for ka, kb, first_id, text, spans in zip(*(part.column(c).to_pylist() for c in ("ka", "kb", "doc_id", "text", "spans")), strict=True):
            data = text.encode()
            kept, end, removed, count = [], 0, 0, 0
            for start, stop in sorted((x["start"], x["stop"]) for x in spans or ()):
                if start > end or not count:
                    kept.append(data[end:start])
                    count, end = count + 1, start
                if stop > end:
                    removed, end = removed + stop - end, stop
            kept.append(data[end:])
            rest = b"".join(kept)
            out.append((ka, kb, first_id, removed, count, hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["ka", "kb", "first_id", "n_removed", "n_spans", "kept_sha256", "kept"])


def unique_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their text's two hashes, and (ka, kb, doc_id, text) of each text at its smallest id."""
    rows = corpus(docs).withColumn("ka", F.xxhash64("text")).withColumn("kb", F.xxhash64(F.lit(1), F.col("text")))
    unique = rows.groupBy(*TEXT).agg(F.min(F.struct("doc_id", "text")).alias("first")).select(*TEXT, "first.doc_id", "first.text")
    return rows, unique


def cleaned_texts(rows: DataFrame, unique: DataFrame) -> DataFrame:
    """(ka, kb, first_id, n_removed, n_spans, kept_sha256, kept) of every different text."""
    n = partitions(rows.sparkSession)
    anchors = rows.select("ka", "text").mapInArrow(_anchors, "anchor long, ka long, times int")
    # An anchor is repeated if it occurs in two texts, or twice in one; copies of a text don't count.
    again = anchors.groupBy("anchor").agg(F.min("ka").alias("low"), F.max("ka").alias("high"), F.max("times").alias("most"), F.sum("times").alias("all")).where("low <> high or most > 1")
    found = anchors.join(again.select("anchor", (F.col("all") > HOT).alias("hot")), "anchor")
    marked = found.groupBy("ka").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    texts = written(unique.join(rows.select(*TEXT).distinct().join(marked, "ka"), TEXT, "left"))

    def pieces(kind: str, how) -> DataFrame:
        return texts.where(F.size(kind) > 0).select("doc_id", *TEXT, "text", F.col(kind).alias("anchors")).mapInArrow(how, STRETCH)

    ordered = pieces("cold", _stretches).repartition(n, "anchor").sortWithinPartitions("anchor", *_PLACE)
    spans = written(ordered.mapInArrow(_sorted_groups, SPANS))
    if not texts.where(F.size("hot") > 0).isEmpty():
        spans = spans.union(_hot_spans(written(pieces("hot", _runs))))
    by_text = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = texts.select("doc_id", *TEXT, "text").join(by_text, TEXT, "left").select(*TEXT, "doc_id", "text", "spans")
    return out.mapInArrow(_cleaned, "ka long, kb long, first_id long, n_removed long, n_spans long, kept_sha256 string, kept string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    rows, unique = unique_texts(docs)
    known = rows.select("doc_id", *TEXT, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    done = cleaned_texts(rows, unique).drop("kept")
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    gone = copy & (F.col("n_bytes") >= LENGTH)
    short = copy & (F.col("n_bytes") < LENGTH)
    pick = lambda c, if_gone, if_short: F.when(gone, if_gone).when(short, if_short).otherwise(F.col(c)).alias(c)
    return known.join(done, TEXT).select(
        "doc_id", "n_bytes", pick("n_removed", F.col("n_bytes"), F.lit(0)), pick("n_spans", F.lit(1), F.lit(0)), pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("whole"))
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated bytes go (a character that a cut splits goes whole), and documents of
    which that leaves nothing. n_chars follows the text."""
    rows, unique = unique_texts(docs)
    done = cleaned_texts(rows, unique).select(*TEXT, "first_id", "kept")
    size = F.octet_length("text")
    keyed = wrapped(docs, "text", "n_chars").select("doc_id", F.xxhash64("text").alias("ka"), F.xxhash64(F.lit(1), F.col("text")).alias("kb"), size.alias("n_bytes"), F.when(size < LENGTH, F.col("text")).alias("short"), "row")
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    left = keyed.join(done, TEXT).withColumn("left", F.when(copy, F.coalesce("short", F.lit(""))).otherwise(F.col("kept")))
    return unwrapped(left.where("n_bytes = 0 or left <> ''"), docs.columns, text=F.col("left"), n_chars=F.length("left").cast("long"))
