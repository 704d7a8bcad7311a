"""A positions index of marked-up files: one scan a file gives every identifier, node, note, law mention, path, link and digest
with its place, the note that encloses it and the nearest identifier before it. Inventories of notes, sections and mentions
are then aggregations of index rows; no file is read twice and no order is needed again.

Index rows: (file, start, end, kind, value, note, placement, part, digest). `start` and `end` are code points. `note` is the start
of the enclosing project note, `placement` the nearest identifier before the row, `part` what the kind adds: a path's section, a
law's form (href or name), an element's law. `digest` names the text around a node or the text of a note.

Null texts give no rows. Files of one name are indexed each; a null name stays null. Text that isn't well formed is scanned as it is:
closing tags without an opening one are passed over, elements that never end give no element row, and a note that never
ends reaches `OPEN_NOTE` characters far.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX = "file string, start int, end int, kind string, value string, note int, placement string, part string, digest string"
#: Characters on each side of a node that count as its context, and of a note without an end.
AROUND, OPEN_NOTE = 1200, 4000
#: Rows that a task holds before it hands them on.
ROWS = 20_000

#: How project notes, identifiers, paths, laws and digests are written.
NOTE = re.compile(r'<note\b[^>]*\bid="(rp-pl(\d{3})(\d{3})[^"]*)"[^>]*>')
IDENTIFIER = re.compile(r'\bidentifier="(/us/usc/[^"]+)"')
PATH = re.compile(r"/us/usc/t(\d+[A-Za-z]?)/s([^/\"'<>&?#\s]+)")
LAW_HREF = re.compile(r"/us/pl/(\d{1,3})/(\d{1,4})", re.I)
LAW_NAME = re.compile(r"Pub\.\s*L\.\s*(\d{1,3})[–—-](\d{1,4})", re.I)
DIGEST = re.compile(r"SHA-?256\s+([0-9a-fA-F]{64})")
QUOTED = re.compile(r"<quotedContent\b", re.I)
HEADING = re.compile(r"<heading[^>]*>(.*?)</heading>", re.S)
STATUS = re.compile(r"<b>\s*Status\.?\s*</b>\s*([^<]+)")
PROJECT = "rp-"
_NODE = re.compile(r'\bid="([^"]+)"')
_HREF = re.compile(r'\bhref="([^"]+)"')
_LINK = re.compile(r'https?://[^\s<"]+')
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")


def law_id(congress: str, number: str) -> str:
    return f"PL-{int(congress):03d}-{int(number):03d}"


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", text)).strip()


def _name(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _elements(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, id, section) of the outermost project elements, with the identifier of the innermost open section."""
    open_tags: list[str] = []
    sections: list[tuple[int, str]] = []
    root: tuple[int, int, str, str] | None = None
    for m in _TAG.finditer(text):
        closing, name, rest = m[1], m[2].rsplit(":", 1)[-1], m[3]
        if closing:
            if name not in open_tags:
                continue
            while open_tags.pop() != name:
                pass
            depth = len(open_tags)
            if root and depth <= root[0]:
                if depth == root[0]:
                    yield root[1], m.end(), root[2], root[3]
                root = None
            while sections and sections[-1][0] >= depth:
                sections.pop()
            continue
        node = _NODE.search(rest)
        empty = rest.endswith("/")
        if name == "section" and not empty:
            said = re.search(r'\bidentifier="([^"]*)"', rest)
            sections.append((len(open_tags), said[1] if said else ""))
        if not root and node and node[1].startswith(PROJECT):
            section = sections[-1][1] if sections else ""
            if empty:
                yield m.start(), m.end(), node[1], section
            else:
                root = (len(open_tags), m.start(), node[1], section)
        if not empty:
            open_tags.append(name)


def scan(text: str) -> Iterator[tuple]:
    """(start, end, kind, value, note, placement, part, digest) of one text. Linear but for the binary searches."""
    known = [(m.start(), m[1]) for m in IDENTIFIER.finditer(text)]
    places = [at for at, _ in known]
    notes = []
    for m in NOTE.finditer(text):
        end = text.find("</note>", m.end())
        notes.append((m.start(), end + len("</note>") if end >= 0 else min(len(text), m.start() + OPEN_NOTE), m))
    starts = [n[0] for n in notes]

    def row(at: int, end: int, kind: str, value: str, part: str | None = None, digest: str | None = None) -> tuple:
        i, k = bisect_right(starts, at) - 1, bisect_right(places, at - 1) - 1
        inside = notes[i][0] if i >= 0 and at < notes[i][1] else None
        return at, end, kind, value, inside, known[k][1] if k >= 0 else None, part, digest

    for at, end, m in notes:
        whole = text[at:end]
        heading, status = HEADING.search(whole), STATUS.search(whole)
        yield row(at, end, "note", m[1], f"{int(m[2])}-{int(m[3])}", _name(whole))
        if heading:
            said = _plain(heading[1])
            cited = LAW_NAME.search(said)
            yield row(at, end, "heading", said, f"{int(cited[1])}-{int(cited[2])}" if cited else None)
        if status and status[1].strip():
            yield row(at, end, "status", status[1].strip())
        if QUOTED.search(whole):
            yield row(at, end, "dump", "")
    for at, value in known:
        yield row(at, at + len(value), "identifier", value)
    for m in _NODE.finditer(text):
        yield row(m.start(), m.end(), "node", m[1], None, _name(text[max(0, m.start() - AROUND) : m.start() + AROUND]))
    for kind, pattern in (("href", _HREF), ("link", _LINK), ("digest", DIGEST)):
        for m in pattern.finditer(text):
            yield row(m.start(), m.end(), kind, m[1] if pattern.groups else m[0])
    for m in PATH.finditer(text):
        yield row(m.start(), m.end(), "path", m[1].lstrip("0") or "0", m[2].rstrip(".,;:|)]}"))
    laws = {}
    for part, pattern in (("href", LAW_HREF), ("name", LAW_NAME)):
        laws[part] = [(m.start(), law_id(m[1], m[2])) for m in pattern.finditer(text)]
        for at, law in laws[part]:
            yield row(at, at, "law", law, part)
    for at, end, node, section in _elements(text):
        # Later mentions in an element are of laws it touches; the first one, a link before a name, made it.
        firsts = [found[i][1] for found in laws.values() if (i := bisect_right(found, (at,))) < len(found) and found[i][0] < end]
        start, _, kind, value, inside, _, _, _ = row(at, end, "element", node)
        yield start, end, kind, value, inside, section or None, firsts[0] if firsts else None, None


def index(files: DataFrame, file_col: str = "file", text_col: str = "content") -> DataFrame:
    """The index rows of all files, each file scanned in its own row and handed on in batches of bounded size."""
    names = [part.split(" ")[0] for part in INDEX.split(", ")]
    kinds = [pa.int32() if part.endswith(" int") else pa.string() for part in INDEX.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        flush = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                for found in scan(batch.column(1)[i].as_py() or ""):
                    held.append((file, *found))
                    if len(held) >= ROWS:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    return files.select(F.col(file_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, INDEX)


def assemble(pieces: DataFrame, file_col: str = "file", ord_col: str = "ord", text_col: str = "piece") -> DataFrame:
    """(file, content): the pieces of each file in their order."""
    said = F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(text_col).alias("t"))))
    return pieces.groupBy(F.col(file_col).alias("file")).agg(F.array_join(F.transform(said, lambda x: x["t"]), "").alias("content"))


def _only(kind: str, value: Column) -> Column:
    return F.max(F.when(F.col("kind") == kind, value))


def note_inventory(rows: DataFrame) -> DataFrame:
    """(file, start, note_id, law, heading, heading_law, placement, status, dump, links, digests, length): one row a project
    note. A link or digest counts for the note that encloses it; both are sorted, equal ones stay."""
    used = rows.where(F.col("kind").isin("note", "heading", "status", "dump", "link", "digest") & F.col("note").isNotNull())
    every = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))
    return used.groupBy("file", F.col("note").alias("start")).agg(
        _only("note", F.col("value")).alias("note_id"), _only("note", F.col("part")).alias("law"), F.coalesce(_only("heading", F.col("value")), F.lit("")).alias("heading"),
        _only("heading", F.col("part")).alias("heading_law"), _only("note", F.col("placement")).alias("placement"), F.coalesce(_only("status", F.col("value")), F.lit("")).alias("status"),
        F.coalesce(_only("dump", F.lit(True)), F.lit(False)).alias("dump"), every("link").alias("links"), every("digest").alias("digests"), _only("note", F.col("end") - F.col("start")).alias("length"),
    )


def note_laws(notes: DataFrame) -> DataFrame:
    """(law, file, notes, files) of laws with more than one note: a row a file; `files` counts a law's files."""
    by_file = notes.groupBy("law", "file").agg(F.count("*").alias("notes"))
    several = by_file.groupBy("law").agg(F.sum("notes").alias("all"), F.count("*").alias("files")).where(F.col("all") > 1)
    return by_file.join(several.drop("all"), "law").select("law", "file", "notes", "files")


def note_summary(notes: DataFrame) -> DataFrame:
    """One row: notes, laws, files, notes with a dump, with a link, with a digest, whose heading cites another law, laws with several
    notes, and laws in several files. Laws are counted by (law, file) rows first, so that no task holds all notes of a law."""
    of = lambda c: F.sum(c.cast("long"))
    by_file = notes.groupBy("law", "file").agg(
        F.count("*").alias("n"), of(F.col("dump")).alias("d"), of(F.size("links") > 0).alias("l"), of(F.size("digests") > 0).alias("s"), of(F.col("heading_law").isNotNull() & (F.col("heading_law") != F.col("law"))).alias("o"),
    )
    by_law = by_file.groupBy("law").agg(F.count("*").alias("f"), *[F.sum(c).alias(c) for c in "ndlso"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    laws = by_law.agg(
        total("n").alias("notes"), F.count("*").alias("laws"), total("d").alias("dumps"), total("l").alias("linked"), total("s").alias("with_digest"), total("o").alias("other_law"),
        total((F.col("n") > 1).cast("long")).alias("laws_repeated"), total((F.col("f") > 1).cast("long")).alias("laws_in_files"),
    )
    return laws.crossJoin(notes.agg(F.countDistinct("file").alias("files")))


def section_index(rows: DataFrame) -> DataFrame:
    """(title, section_key, section): the first spelling of each section that any path names, by file and place."""
    paths = rows.where((F.col("kind") == "path") & (F.col("part") != ""))
    return paths.groupBy(F.col("value").alias("title"), F.lower("part").alias("section_key")).agg(F.min_by("part", F.struct("file", "start")).alias("section"))


def law_mentions(rows: DataFrame, laws: DataFrame | None = None, law_col: str = "law_id") -> DataFrame:
    """(law_id, file, by_href, by_name, first): the files whose text cites a law, of all laws or of the given ones."""
    said = rows.where(F.col("kind") == "law")
    if laws is not None:
        said = said.join(laws.select(F.col(law_col).alias("value")).distinct(), "value", "left_semi")
    of = lambda form: F.sum((F.col("part") == form).cast("long"))
    return said.groupBy(F.col("value").alias("law_id"), "file").agg(of("href").alias("by_href"), of("name").alias("by_name"), F.min("start").alias("first"))


def incorporated(rows: DataFrame) -> DataFrame:
    """(law_id, location): the section, or else the file, of each outermost project element, by the law that made it; distinct."""
    made = rows.where((F.col("kind") == "element") & F.col("part").isNotNull())
    return made.select(F.col("part").alias("law_id"), F.coalesce("placement", "file").alias("location")).distinct()
