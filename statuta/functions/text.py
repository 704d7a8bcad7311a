"""Column functions over strings: normal forms, identifiers, law numbers, citations and excerpts.

All are built-in expressions. `\\s` is ASCII in Spark's regular expressions, as it is in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no subject.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "have", "in", "into", "is", "it", "its", "law", "of", "on",
    "or", "public", "section", "shall", "that", "the", "this", "to", "under",
    "united", "states", "with", "act", "title", "code", "amend", "amended",
]
#: Fixed value: how an enactment is named in text.
LAW_PATTERN = r"(?i)(?:Public\s+Law|Pub\.?\s*L\.?|P\.?L\.?)\s*(\d{1,3})\s*[-–—]\s*(\d{1,4})"
#: Fixed value: a bare pair at the beginning of a field.
BARE_PATTERN = r"(?i)^\s*(?:P\.?L\.?\s*)?(\d{1,3})\s*[-–—]\s*(\d{1,4})(?:\b|\s*[|:—-])"
#: Fixed value: the numbers in what either of them finds.
PAIR_PATTERN = r"(\d{1,3})\s*[-–—]\s*(\d{1,4})"
URL_PATTERN = r"""(?i)https?://[^\s<>\]\[)("']+"""
#: Suffixes of a section that name a note.
NOTE_SUFFIXES = ["note", "notes", "prec", "nt", "new", "et-seq", "preceding", "proposed", "added"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _each(col: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        col = F.regexp_replace(col, pattern, by)
    return col


def normalize_whitespace(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\ufeff"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    # Each of the patterns needs a line end or two blanks in a row: one search spares most texts five.
    return F.btrim(F.when(~c.rlike("[\r\n]|[ \t]{2}"), c).otherwise(_each(c, ("\r\n?", "\n"), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("[ \t]{2,}", " "), ("\n{3,}", "\n\n"))), F.lit(" \t\n\r"))


def clean_xml_text(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}]", "")


def law_id(congress: Column, number: Column) -> Column:
    wide = lambda x: F.lpad(x, 3, "0")
    pad = lambda x: F.when(F.length(x) >= 3, x).otherwise(wide(x))
    return F.concat(F.lit("PL-"), pad(congress), F.lit("-"), pad(number))


def extract_law_number(*cols: Column) -> Column:
    """struct(law_id, congress, number) of the first field that names a law; only if none does, of the
    first that begins with a bare pair. Nulls where there is neither."""
    said = lambda c, p: bound(F.regexp_extract(c, p, 0), lambda m: F.when(m != "", m))
    number = lambda hit, i: F.regexp_extract(hit, PAIR_PATTERN, i).try_cast("int")
    law = lambda n: F.struct(law_id(n["congress"].cast("string"), n["number"].cast("string")).alias("law_id"), n["congress"], n["number"])
    # A field is searched once a pattern; the numbers come from what was found.
    return bound(
        F.coalesce(*[said(c, p) for p in (LAW_PATTERN, BARE_PATTERN) for c in cols]),
        lambda hit: F.when(hit.isNotNull(), bound(F.struct(number(hit, 1).alias("congress"), number(hit, 2).alias("number")), law)),
    )


def parse_law_id(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, r"(?i)PL-(\d+)-(\d+)", i)
    return F.when(part(1) != "", F.struct(part(1).try_cast("int").alias("congress"), part(2).try_cast("int").alias("number")))


def law_sort_key(c: Column) -> Column:
    """Orders laws by number; what isn't one comes last, by its text."""
    parsed = parse_law_id(c)
    return F.struct(F.coalesce(parsed["congress"], F.lit(10**6)).alias("congress"), F.coalesce(parsed["number"], F.lit(10**6)).alias("number"), c.alias("law"))


def title_from_card_name(c: Column) -> Column:
    out = _each(c, (LAW_PATTERN, ""), (r"(?i)^\s*(?:P\.?L\.?\s*)?\d{1,3}\s*[-–—]\s*\d{1,4}\s*(?:[|:—-]\s*)?", ""), (r"^[\s|:–—-]+|[\s|:–—-]+$", ""), (r"\s+", " "))
    return F.coalesce(F.nullif(out, F.lit("")), F.trim(c))


def tokenize(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9'-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def deterministic_id(*parts: Column) -> Column:
    return F.concat(F.lit("rp-"), F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(20)))


def safe_slug(c: Column, fallback: str = "item") -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), F.lit("-.")), F.lit("")), F.lit(fallback))


def unescape(c: Column) -> Column:
    for entity, said in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(said))
    return c


def strip_tags(c: Column) -> Column:
    return normalize_whitespace(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


def html_to_text(c: Column) -> Column:
    return unescape(_each(c, ("(?is)<script.*?</script>|<style.*?</style>", " "), (r"(?i)<br\s*/?>|</p>|</div>|</li>|</tr>|</h[0-9]>", "\n"), ("<[^>]+>", " ")))


def rtf_to_text(c: Column) -> Column:
    return _each(c, (r"\\pard?\b", "\n"), (r"\\'[0-9a-fA-F]{2}", " "), (r"\\[a-zA-Z]+-?[0-9]* ?", ""), ("[{}]", ""))


def paragraphs(c: Column) -> Column:
    """Blank-line separated paragraphs, inner line ends as spaces."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")


def normalize_text(c: Column, mode: str = "dash") -> Column:
    """dash: `-` to `_`; space: also single spaces; runs: runs of space or dash to one `_`."""
    low = F.lower(F.trim(c))
    if mode == "runs":
        return F.regexp_replace(low, "[ -]+", "_")
    return F.translate(low, "- " if mode == "space" else "-", "__" if mode == "space" else "_")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def section_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def normalize_section(c: Column) -> Column:
    first = F.btrim(F.element_at(F.split(F.trim(c), r"\s+"), 1), F.lit("\"'“”.,;:()[]"))
    return F.regexp_replace(F.replace(first, F.lit("?"), F.lit("-")), "(?i)(?:-(?:" + "|".join(NOTE_SUFFIXES) + "))+$", "")


def compact(c: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.rtrim(F.left(flat, F.lit(limit - 1)), F.lit(" .,;:"))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def law_display(c: Column) -> Column:
    p = parse_law_id(c)
    return F.when(p.isNotNull(), F.concat_ws("–", p["congress"].cast("string"), p["number"].cast("string"))).otherwise(c)


def law_href(c: Column) -> Column:
    p = parse_law_id(c)
    return F.when(p.isNotNull(), F.concat(F.lit("/us/pl/"), p["congress"].cast("string"), F.lit("/"), p["number"].cast("string"))).otherwise("")


IDENTIFIER = r"^/us/usc/t([0-9A-Za-z]+)/s([^/]+)"


def citation_url(c: Column, site: str = "https://example.test") -> Column:
    t, s = (F.regexp_extract(c, IDENTIFIER, i) for i in (1, 2))
    return F.when(t != "", F.concat(F.lit(f"{site}/cite/"), t, F.lit("/"), s, F.lit("/"))).otherwise("")


def citation(c: Column) -> Column:
    """`/us/usc/t5/s301/a/1` as `5 U.S.C. § 301(a)(1)`."""
    t, s = (F.regexp_extract(c, IDENTIFIER, i) for i in (1, 2))
    pin = F.regexp_extract(c, IDENTIFIER + "/(.*)$", 3)
    said = F.when(pin == "", "").otherwise(F.array_join(F.transform(F.split(pin, "/"), lambda x: F.concat(F.lit("("), x, F.lit(")"))), ""))
    return F.when(t != "", F.concat(t, F.lit(" U.S.C. § "), s, said)).otherwise("")


def pinpoint(c: Column) -> Column:
    """The dotted pinpoint of an identifier: `a.1` of /us/usc/t5/s301/a/1."""
    return F.replace(F.regexp_extract(c, IDENTIFIER + "/(.*)$", 3), F.lit("/"), F.lit("."))


def pinpoint_absolute(base: Column, dotted: Column) -> Column:
    return F.when(dotted == "", base).otherwise(F.concat(base, F.lit("/"), F.replace(dotted, F.lit("."), F.lit("/"))))


def route(url: Column) -> Column:
    """struct(title, section, pin) of a citation link; the query beats the path."""
    get = lambda *keys: F.coalesce(*[F.nullif(F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1), F.lit("")) for k in keys])
    path = lambda i: F.nullif(F.regexp_extract(url, r"/cite/([^/?#]+)/([^/?#]+)", i), F.lit(""))
    return F.struct(F.coalesce(get("title", "t"), path(1)).alias("title"), F.coalesce(get("section", "s"), path(2)).alias("section"), get("pin", "p").alias("pin"))


def section_label(number: Column) -> Column:
    return F.btrim(_each(number, ("[\u202f\u00a0]", " "), (r"^\[?§+\s*", ""), ("—$", ""), (r"\.+$", ""), (r"\]$", "")), F.lit(" "))


def heading_label(heading: Column) -> Column:
    clean = F.trim(heading)
    return F.when(clean.rlike("[.!?]$"), clean).otherwise(F.concat(clean, F.lit(".")))


def file_kind(name: Column, mime: Column, head: Column) -> Column:
    """Extension by header name, else by type, else by the first bytes."""
    ext = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in {"application/pdf": ".pdf", "application/rtf": ".rtf", "text/rtf": ".rtf", "text/plain": ".txt", "text/html": ".html"}.items() for x in pair])
    magic = F.when(head.startswith("%PDF"), ".pdf").when(head.startswith("PK"), ".docx").when(F.ltrim(head).startswith("<"), ".html").otherwise(".bin")
    return F.coalesce(F.nullif(ext, F.lit("")), known[F.lower(F.trim(F.substring_index(mime, ";", 1)))], magic)


def snippet(c: Column, at: Column, length: Column, around: int = 160) -> Column:
    """Text around a match that begins at `at` (from 1), with … where it is cut."""
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + length + around - 1, F.length(c))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(c, start, end - start + 1), F.when(end < F.length(c), "…").otherwise(""))


def heading_body_split(c: Column, fallback: str) -> Column:
    """(heading, body) of a block without the quotes around it: the rest of a line that begins with a section's number, else a first line of under 160
    characters that opens no subsection, else the fallback and all of it."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    numbered = r"(?is)^\s*(?:§+|SEC(?:TION)?\.?)\s*[0-9A-Za-z.-]+\s*[.\-—:]\s*([^\n]+)\n?(.*)$"

    def split(clean: Column) -> Column:
        first = F.regexp_extract(clean, r"^[^\r\n]*", 0)
        rest = strip(F.regexp_replace(F.substring(clean, F.length(first) + 1, F.length(clean)), r"\r\n?", "\n"))
        trimmed = lambda x: F.btrim(x, F.lit(" .—-"))
        line = (clean != "") & (F.length(first) < 160) & ~first.rlike(r"^\s*\([a-zA-Z0-9]+\)")
        named = clean.rlike(numbered)
        heading = F.when(named, trimmed(strip(F.regexp_extract(clean, numbered, 1)))).when(line, trimmed(first)).otherwise(fallback)
        return F.struct(heading.alias("heading"), F.when(named, strip(F.regexp_extract(clean, numbered, 2))).when(line, rest).otherwise(clean).alias("body"))

    return bound(F.btrim(strip(clean_xml_text(F.coalesce(c, F.lit("")))), F.lit('"“”')), split)


def excerpt(c: Column, limit: int = 420) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("...")))


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often `use` refers to it: Catalyst writes a plain
    column out at every place instead."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_text(c: Column, phrase: Column) -> Column:
    """How often phrase occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, phrase, F.lit("")))) / F.length(phrase)).cast("int")


def xml_file_for(identifier: Column) -> Column:
    t = F.regexp_extract(identifier, r"/t(\d+)", 1)
    return F.when(t == "", "").otherwise(F.concat(F.lit("usc"), F.when(F.length(t) < 2, F.lpad(t, 2, "0")).otherwise(t), F.lit(".xml")))


def friendly_status(c: Column) -> Column:
    return F.initcap(F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))


def valid_node_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*$") & ~c.endswith(".xml")


def percent_encoded(c: Column, safe: str = "") -> Column:
    """Percent encoding of all but letters, digits, `_.-~` and the characters of `safe`."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, sign in (("%7E", "~"), *((f"%{ord(s):02X}", s) for s in safe)):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.replace(out, F.lit("*"), F.lit("%2A")) if "*" not in safe else out


def make_target(title: Column, section: Column, rest: Column, repealed: Column, identifier: Column, inferred: Column | None = None) -> Column:
    """(identifier, title, section, citation, href, historical, inferred) of a place in the Code. A title loses its leading zeros; without a section the
    whole title is meant. Only a section of a law in force has a link, with the pinpoint where its identifier is known."""
    number = F.coalesce(F.nullif(F.ltrim(title, F.lit("0")), F.lit("")), F.when(title != "", F.lit("0")), title)
    part, more = F.nullif(F.trim(section), F.lit("")), F.coalesce(rest, F.lit(""))
    pinpoint = F.array_join(F.transform(F.filter(F.split(more, "/"), lambda p: p != ""), lambda p: F.concat(F.lit("("), p, F.lit(")"))), "")
    named, gone = F.nullif(identifier, F.lit("")), F.coalesce(repealed, F.lit(False))
    query = F.when(named.isNotNull() & (more != ""), F.concat(F.lit("?p="), percent_encoded(named))).otherwise("")
    link = F.concat(F.lit("cite/"), percent_encoded(number, "/"), F.lit("/"), percent_encoded(part, "/"), F.lit("/"), query)
    return F.struct(
        F.coalesce(named, F.concat(F.lit("/us/usc/t"), number, F.coalesce(F.concat(F.lit("/s"), part, more), F.lit("")))).alias("identifier"), number.alias("title"), part.alias("section"),
        F.when(part.isNotNull(), F.concat(number, F.lit(" U.S.C. § "), part, pinpoint)).otherwise(F.concat(F.lit("Title "), number, F.lit(", United States Code (title-wide material)"))).alias("citation"),
        F.when(part.isNotNull() & ~gone, link).alias("href"), gone.alias("historical"), (inferred if inferred is not None else F.lit(False)).alias("inferred"),
    )


def stamp_defaults(reports: DataFrame, reviewer: Column, manifest: Column, output: Column, also: list[str]) -> DataFrame:
    """Reports with reviewer, source_manifest and output_path as given, and `reviewed_against` where it is empty: the manifest and `also`."""
    kept = F.when(F.size("reviewed_against") > 0, F.col("reviewed_against")).otherwise(F.array(manifest, *[F.lit(x) for x in also]))
    return reports.withColumns({"reviewer": reviewer, "source_manifest": manifest, "output_path": output, "reviewed_against": kept})
