"""Operator 12, personal data: patterns find the entities to protect, and corpus co-occurrence tells which other
terms give them away.

Protected entities are the values (an address, a number) that the base patterns find: e-mail, IP address,
card, phone. A term is a run of letters and digits in lower case. How strongly a term t reveals an entity c
is their pointwise mutual information, as a share of what there is to reveal, the information of c:

    disclosure(c, t) = log(N * n_ct / (n_c * n_t)) / log(N / n_c)

with N all documents, n_c those that hold c, n_t those that hold t, n_ct those in which t stands within
`REACH` words of c. It is 1 if t is only ever seen beside c. A term that reaches `DISCLOSE` for some entity,
and stands beside it in at least `LEAST` different contexts (copies of one context count once), is sanitised
wherever it occurs: from `REMOVE` on it is removed, below it is generalised to the class of its shape.

Three passes over whole texts. Contexts: a row for each mention's different neighbours; counted by key with
partial sums, so an entity that a third of the documents share is a few rows a task. Frequencies: of the terms that
have enough contexts only. Marking: base spans again, and the terms. The terms looked for in a pass are shipped
to the tasks as sorted 64-bit hashes if there are at most `SHIPPED` of them; beyond that, the hashes
of a text's terms are joined with them by key. Both ways give the same rows.

Positions are in code points, ends exclusive. Matching reads bytes in linear time, also in long runs of
digits, dots or letters without a match. Null and empty texts have no spans; a null doc_id stays null; repeated
rows each count as a document and each give a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, corpus, hash_spans, mix, slices, table, utf8, words, written

KINDS = ("email", "ip", "card", "phone")
REACH, LEAST, DISCLOSE, REMOVE = 8, 3, 0.8, 0.999
#: Hashes of terms that are shipped to the tasks of a pass (16 MB).
SHIPPED = 2_000_000
#: Bytes of terms: shorter ones are no terms.
SHORTEST = 3


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGIT = _kind(b"0123456789")
LOCAL, LABEL, PHONE = _kind(_LETTERS + b"0123456789._%+-"), _kind(_LETTERS + b"0123456789-"), _kind(b" ().0123456789-")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values; mask ends with a false one."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask)).astype(np.int8)))
    return edge[::2], edge[1::2]


def emails(data: np.ndarray) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost first, without overlaps."""
    at = np.flatnonzero(data == 64)
    if not len(at):
        return []
    local_start, local_end = _runs(LOCAL[data])
    label_start, label_end = _runs(LABEL[data])

    def label(p: int) -> int:
        """The end of the label that begins at p, or 0."""
        i = int(np.searchsorted(label_start, p))
        return int(label_end[i]) if i < len(label_start) and label_start[i] == p else 0

    out, done = [], 0
    run = np.minimum(np.searchsorted(local_end, at), max(len(local_end) - 1, 0))
    starts = np.where(local_end[run] == at, local_start[run], at) if len(local_end) else at
    for p, start in zip(at.tolist(), starts.tolist(), strict=True):
        start, end, labels = max(start, done), 0, 0
        while start < p and (after := label((end or p) + 1)):
            end, labels = after, labels + 1
            if data[end] != 46:
                break
        if labels > 1:
            out.append((start, end))
            done = end
    return out


def addresses(data: np.ndarray) -> list[tuple[int, int]]:
    """Four numbers joined by dots, each at most 255."""
    start, end = _runs(DIGIT[data])
    if len(start) < 4:
        return []
    joined = np.concatenate(([False], (start[1:] == end[:-1] + 1) & (data[end[:-1]] == 46)))
    first = np.flatnonzero(~joined)
    place = np.arange(len(start)) - first[np.cumsum(~joined) - 1]  # in its chain of numbers
    begin = np.flatnonzero(place % 4 == 0)
    begin = begin[begin + 3 < len(start)]
    begin = begin[place[begin + 3] == place[begin] + 3]
    small = lambda a, b: len(x := data[a:b].tobytes().lstrip(b"0")) < 4 and int(x or b"0") <= 255
    return [(int(start[i]), int(end[i + 3])) for i in begin.tolist() if all(small(start[j], end[j]) for j in range(i, i + 4))]


def _luhn(digits: np.ndarray) -> bool:
    x = digits[::-1].astype(np.int64) - 48
    twice = x[1::2] * 2
    return int(x[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def cards(data: np.ndarray) -> list[tuple[int, int]]:
    """Digits with at most one space or hyphen between two, 13 to 19 of them, that pass Luhn's check."""
    p = np.flatnonzero(DIGIT[data])
    if len(p) < 13:
        return []
    gap = np.diff(p)
    between = data[p[:-1] + 1]
    joined = (gap == 1) | ((gap == 2) & ((between == 32) | (between == 45)))
    first = np.flatnonzero(np.concatenate(([True], ~joined)))
    n = np.diff(np.append(first, len(p)))
    return [(int(p[a]), int(p[a + k - 1]) + 1) for a, k in zip(first.tolist(), n.tolist(), strict=True) if 13 <= k <= 19 and _luhn(data[p[a : a + k]])]


def phones(data: np.ndarray) -> list[tuple[int, int]]:
    """`\\+[0-9][\\x20().0-9-]+[0-9]` with 9 to 15 digits."""
    plus = np.flatnonzero(data == 43)
    plus = plus[DIGIT[data[np.minimum(plus + 1, len(data) - 1)]]]
    if not len(plus):
        return []
    starts, ends = _runs(PHONE[data])
    digits = np.flatnonzero(DIGIT[data])
    end = ends[np.searchsorted(starts, plus + 1, "right") - 1]
    low, high = np.searchsorted(digits, plus + 1), np.searchsorted(digits, end)
    last = digits[high - 1]  # of the run; there must be a character between it and the first digit
    n = high - low
    return [(int(a), int(b) + 1) for a, b, k in zip(plus, last, n, strict=True) if b >= a + 3 and 9 <= k <= 15]


FINDERS = (emails, addresses, cards, phones)


def base_spans(data: np.ndarray) -> list[list[tuple[int, int]]]:
    """Byte spans by kind in bytes whose last one is 0; rows are parted by bytes of 0."""
    return [f(data) for f in FINDERS]


class Slice:
    """Rows of text as one run of bytes with a 0 after each; spans and terms by row."""

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = utf8(column)
        rows = len(offsets) - 1
        # A byte of 0 in a text matches no pattern, as the ones between rows.
        self.data = np.insert(raw, offsets[1:], 0) if rows else np.zeros(0, np.uint8)
        self.at = offsets + np.arange(rows + 1)
        self.low = LOWER[self.data]
        self.spans = base_spans(self.data) if rows else [[] for _ in KINDS]
        self.starts, self.ends, _ = words(self.low, self.at, ALNUM)
        long = self.ends - self.starts >= SHORTEST
        self.starts, self.ends = self.starts[long], self.ends[long]
        self.row = np.searchsorted(self.at, self.starts, "right") - 1
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = hash_spans(self.low, self.starts, self.ends).view(np.int64)
        return self._hashes

    def free(self) -> np.ndarray:
        """Which terms lie outside all base spans."""
        depth = np.zeros(len(self.data) + 1, np.int32)
        for found in self.spans:
            for a, b in found:
                depth[a] += 1
                depth[b] -= 1
        inside = np.concatenate(([0], np.cumsum(np.cumsum(depth)[:-1] > 0)))
        return inside[self.ends] == inside[self.starts]


def _entity(kind: int, value: bytes) -> np.int64:
    """Numbers are the same entity however they are parted."""
    plain = value.lower() if kind < 2 else bytes(c for c in value if 48 <= c <= 57)
    data = np.frombuffer(bytes([65 + kind]) + plain, np.uint8)
    return hash_spans(data, np.array([0]), np.array([len(data)])).view(np.int64)[0]


MENTIONS = "entity long, term long, context long, docs long"
_SELF = 0


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every slice: for an entity, its documents (term 0); for a term beside it, its documents by context."""
    for piece in slices(batches):
        s = Slice(piece.column("text"))
        if not any(s.spans):
            continue
        free = np.flatnonzero(s.free())
        starts, ends, row = s.starts[free], s.ends[free], s.row[free]
        around = []  # kind, mention, row, and the terms before and after it
        for kind, found in enumerate(s.spans):
            for a, b in found:
                r = int(np.searchsorted(s.at, a, "right") - 1)
                left, right = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))
                low, high = max(left - REACH, int(np.searchsorted(row, r))), min(right + REACH, int(np.searchsorted(row, r, "right")))
                around.append((kind, a, b, r, np.concatenate((np.arange(low, left), np.arange(right, high)))))
        near_some = np.unique(np.concatenate([x[4] for x in around]))
        hashes = np.zeros(len(starts), np.int64)
        hashes[near_some] = hash_spans(s.low, starts[near_some], ends[near_some]).view(np.int64)
        seen: dict[tuple[int, int, int], list] = {}
        counts: dict[tuple[int, int, int], int] = {}
        for kind, a, b, r, which in around:
            e, near = int(_entity(kind, s.data[a:b].tobytes())), hashes[which]
            context = int(np.bitwise_xor.reduce(mix(near.view(np.uint64) + np.arange(len(near), dtype=np.uint64))).view(np.int64)) if len(near) else 0
            if (r, e, _SELF) not in seen:
                seen[r, e, _SELF] = True
                counts[e, _SELF, 0] = counts.get((e, _SELF, 0), 0) + 1
            for t in dict.fromkeys(near.tolist()):
                new = (r, e, t) not in seen  # the first context in a document counts it
                seen[r, e, t] = True
                counts[e, t, context] = counts.get((e, t, context), 0) + new
        keys = np.array(list(counts), np.int64).reshape(-1, 3)
        yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(keys[:, 2]), pa.array(list(counts.values()), pa.int64())], names=[x.split()[0] for x in MENTIONS.split(", ")])


def _frequencies(wanted: np.ndarray | None):
    """Documents of the slice with each term that is wanted, or with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            s = Slice(piece.column("text"))
            free, hashes = s.free(), s.hashes
            use = free if wanted is None else free & _among(hashes, wanted)
            if use.any():
                pairs = np.unique(np.stack((hashes[use], s.row[use])), axis=1)[0]
                terms, n = np.unique(pairs, return_counts=True)
                yield pa.record_batch({"term": pa.array(terms), "docs": pa.array(n.astype(np.int64))})

    return run


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def disclosures(docs: DataFrame) -> DataFrame:
    """(term, entity, n_ct, n_c, n_t, disclosure) of the pairs with enough contexts, entity and term as hashes."""
    texts = corpus(docs).select("text")
    by_context = texts.mapInArrow(_mentions, MENTIONS).groupBy("entity", "term", "context").agg(F.sum("docs").alias("docs"))
    pairs = written(by_context.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("docs").alias("n_ct")).where((F.col("term") == _SELF) | (F.col("contexts") >= LEAST)))
    entities = pairs.where(F.col("term") == _SELF).select("entity", F.col("n_ct").alias("n_c"))
    beside = pairs.where(F.col("term") != _SELF).select("entity", "term", "n_ct")
    terms = beside.select("term").distinct()
    wanted = shipped(terms)
    counted = texts.mapInArrow(_frequencies(wanted), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("n_t"))
    total = docs.count()
    gain = F.try_divide(F.log(F.lit(float(total)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))), F.log(F.lit(float(total)) / F.col("n_c")))
    # An entity of all documents has nothing to reveal.
    return beside.join(counted, "term").join(entities, "entity").where(F.col("n_c") < total).withColumn("disclosure", gain)


def shipped(terms: DataFrame) -> np.ndarray | None:
    """The hashes, sorted, where there are at most SHIPPED."""
    terms = written(terms)
    return np.sort(np.array([r.term for r in terms.collect()], np.int64)) if terms.count() <= SHIPPED else None


MARKED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_terms long, text string"


def _marked(reveal: tuple[np.ndarray, np.ndarray] | None):
    """reveal: the terms' hashes, sorted, and their disclosure; None where each row brings its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            s = Slice(piece.column("text"))
            rows = piece.num_rows
            points = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))  # code points before a byte
            use = np.zeros(len(s.starts), bool)
            if reveal is not None and len(reveal[0]):
                use = _among(s.hashes, reveal[0])
            elif reveal is None:
                own = piece.column("reveal").to_pylist()
                mine = [np.array([t.get("term") for t in x or []], np.int64) for x in own]
                ends = np.searchsorted(s.row, np.arange(rows + 1))
                for r in (r for r in range(rows) if len(mine[r])):
                    use[ends[r] : ends[r + 1]] = np.isin(s.hashes[ends[r] : ends[r + 1]], mine[r])
            terms: list[list[tuple[int, int, float]]] = [[] for _ in range(rows)]
            if use.any():
                for i in np.flatnonzero(use & s.free()).tolist():
                    r, h = int(s.row[i]), s.hashes[i]
                    d = float(reveal[1][np.searchsorted(reveal[0], h)]) if reveal is not None else next(t["disclosure"] for t in own[r] if t["term"] == h)
                    terms[r].append((int(s.starts[i]), int(s.ends[i]), d))
            found: list[list[list[tuple[int, int]]]] = [[[] for _ in KINDS] for _ in range(rows)]
            for kind, all_of in enumerate(s.spans):
                for a, b in all_of:
                    found[int(np.searchsorted(s.at, a, "right") - 1)][kind].append((a, b))
            out: list[tuple] = []
            for r in range(rows):
                at = points[s.at[r]]
                named = [f"{k}:{points[a] - at}:{points[b] - at}" for k, spans in zip(KINDS, found[r], strict=True) for a, b in spans]
                more = [f"term:{points[a] - at}:{points[b] - at}" for a, b, _ in terms[r]]
                text = _sanitised(s.data, int(s.at[r]), int(s.at[r + 1]) - 1, found[r], terms[r]) if named or more else None
                out.append((*(len(x) for x in found[r]), ",".join(named), ",".join(named + more), len(more), text))
            columns = list(zip(*out, strict=True))
            names = [x.split()[0] for x in MARKED.split(", ")]
            whole = piece.column("text").to_pylist()
            columns[-1] = [t if t is not None else whole[r] for r, t in enumerate(columns[-1])]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.record_batch([piece.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return run


def _sanitised(data: np.ndarray, start: int, end: int, found: list[list[tuple[int, int]]], terms: list[tuple[int, int, float]]) -> str:
    """The text with each base span as its kind, and each term removed or as the class of its shape."""
    edits = [(a, b, f"<{k}>".encode()) for k, spans in zip(KINDS, found, strict=True) for a, b in spans]
    for a, b, d in terms:
        word = data[a:b].tobytes()
        edits.append((a, b, b"" if d >= REMOVE else b"<number>" if any(48 <= c <= 57 for c in word) else b"<name>" if 65 <= word[0] <= 90 else b"<word>"))
    out, at = [], start
    for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a >= at:  # else it overlaps what has just been replaced, and its rest goes too
            out += [data[at:a].tobytes(), new]
        at = max(at, b)
    return b"".join([*out, data[at:end].tobytes()]).decode("utf-8", "replace")


def sanitised(docs: DataFrame) -> DataFrame:
    """MARKED: counts and spans of each document, and its text with the spans generalised or removed."""
    found = disclosures(docs).where(F.col("disclosure") >= DISCLOSE).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    found = written(found)
    rows = corpus(docs)
    if found.count() <= SHIPPED:
        told = sorted((r.term, r.disclosure) for r in found.collect())
        reveal = (np.array([t for t, _ in told], np.int64), np.array([d for _, d in told], np.float64))
        return rows.mapInArrow(_marked(reveal), MARKED)
    # The terms of each different text that are among them, by key.
    digest = F.md5("text")
    hashed = rows.select(digest.alias("key"), "text").mapInArrow(_terms, "key string, term long").distinct()
    own = hashed.join(found, "term").groupBy("key").agg(F.collect_list(F.struct("term", "disclosure")).alias("reveal"))
    return rows.withColumn("key", digest).join(own, "key", "left").select("doc_id", "text", "reveal").mapInArrow(_marked(None), MARKED)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        s = Slice(piece.column("text"))
        pairs = pd.DataFrame({"row": s.row, "term": s.hashes}).drop_duplicates()
        yield pa.record_batch({"key": piece.column("key").take(pa.array(pairs["row"].to_numpy())), "term": pa.array(pairs["term"].to_numpy(), pa.int64())})


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitised(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_terms", F.sha2("text", 256).alias("sanitised_sha256"))
