"""From raw text to clean paragraphs, sections, sentences and passages."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A reference in a text: a number, or a name that may be followed by more letters.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What numbers stand for that are no characters: those of an old code page, and those that stand for nothing.
_PAGE = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160))
_MOST = 0x10FFFF
CHUNK_WORDS, PACK, SPLIT, MAX_WORDS = 180, 1.3, 1.6, 15_000
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z(\[])"


def _names() -> dict[str, str]:
    """Every named reference of HTML, without the ampersand; those that may lack a semicolon stand with and without."""
    return html.entities.html5


def _of_number(ref: Column) -> Column:
    """The character of a numeric reference as browsers read it."""
    hexed = F.lower(F.substring(ref, 3, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(ref, r"^&#[xX]?", ""), ";$", "")
    # digits beyond any character are cut, not computed
    trimmed = F.regexp_replace(digits, "^0+(?=.)", "")
    fits = F.when(hexed, F.length(trimmed) <= 6).otherwise(F.length(trimmed) <= 7)
    short = F.when(fits, trimmed).otherwise("0")
    number = F.when(hexed, F.conv(short, 16, 10)).otherwise(short).cast("int")
    replaced = F.lit("\ufffd")
    old = F.substr(F.lit(_PAGE), number - 127, F.lit(1))
    odd = number.isin(0xB, *(x for plane in range(17) for x in (plane * 0x10000 + 0xFFFE, plane * 0x10000 + 0xFFFF))) | number.between(1, 8) | number.between(0xE, 0x1F) | number.between(0x7F, 0x9F) | number.between(0xFDD0, 0xFDEF)
    return (
        F.when(~fits | (number == 0) | number.between(0xD800, 0xDFFF) | (number > _MOST), replaced).when(number == 13, "\r").when(number.between(128, 159), old).when(odd, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0")), "utf-32"))
    )


def unescaped(text: Column) -> Column:
    """``text`` with every named and numeric reference of HTML resolved, in one pass: what a reference gives is not read again.

    Of a name without a semicolon the longest beginning that is known counts, and the rest stays.
    """
    # a map that is made of literals is made once, not for each row; no name or character has these two signs
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _names().items())), F.lit("\x01"), F.lit("\x02"))

    def resolved(ref: Column) -> Column:
        name = F.substr(ref, F.lit(2))
        sizes = F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1))
        lead = F.filter(F.transform(F.when(F.length(name) > 2, sizes), lambda n: F.substr(name, F.lit(1), n)), lambda x: F.try_element_at(known, x).isNotNull())
        first = F.get(lead, F.lit(0))
        part = F.when(first.isNotNull(), F.concat(F.try_element_at(known, first), F.substr(name, F.length(first) + 1)))
        return F.when(F.substring(ref, 2, 1) == "#", _of_number(ref)).otherwise(F.coalesce(F.try_element_at(known, name), part, ref))

    refs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), resolved)
    between = F.split(text, REFERENCE, -1)
    joined = F.array_join(F.zip_with(between, refs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def clean(text: Column) -> Column:
    """References resolved, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(unescaped(text), r"(?U)\s+", " "))


def strip_citations(text: Column) -> Column:
    """Without bracketed numbers, author-year notes and figure notes, and the blanks they leave before punctuation."""
    out = F.regexp_replace(text, r"\[\d+(?:\s*[,–-]\s*\d+)*\]", "")
    out = F.regexp_replace(out, r"\((?:[A-Z][A-Za-z'-]+(?: et al\.)?,? \d{4}[a-z]?(?:; )?)+\)", "")
    out = F.regexp_replace(out, r"\((?:Fig|Figure|Table)s?\.? ?\d+[A-Za-z]?\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([.,;:])", "$1"), r"\s+", " "))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")


def upper_case(text: Column) -> Column:
    """Capitals one for one: characters whose capitals are several keep their own, sharp s the capital one, as DuckDB has it."""
    long = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, (i for i in range(0x80, 0xFFFF) if not 0xD800 <= i < 0xE000)) if len(c.upper()) > 1} | {"\u00df": "\u1e9e"}
    whole, own = "".join(long), "".join(long.values())
    return F.when(text.rlike(f"[{whole}]"), F.concat_ws("", F.transform(F.split(text, ""), lambda c: F.when(c.rlike(f"[{whole}]"), F.translate(c, whole, own)).otherwise(F.upper(c))))).otherwise(F.upper(text))


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text", blank: str = "\n") -> DataFrame:
    """(doc, pos, block): trimmed, non-empty blocks in order."""
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(dehyphenate(F.col(text)), blank)).alias("pos", "block"))
    return each.select("doc", "pos", F.trim("block").alias("block")).where("block <> ''")


#: Heading starts and the kind of section that they open; earlier ones win.
HEADINGS = (
    ("abstract|summary|executive summary", "ABSTRACT"), ("introduction|background", "INTRO"), (".*results", "RESULTS"), ("discussion", "DISCUSS"),
    ("conclusion|concluding|conclusions|closing", "CONCL"), ("method|materials and method|experiment|apparatus|procedure|approach", "METHODS"), ("reference|bibliography", "REFS"),
    ("acknowledg|appendix|nomenclature|table of contents|contents|list of", "SKIP"),
)


def heading(block: Column) -> Column:
    """Kind of section that a short heading, numbered or not, opens, else null; results win over discussion."""
    h = F.lower(F.regexp_replace(block, r"^\s*(?:\d+(?:\.\d+)*\.?|[IVX]+\.)?\s*", ""))
    out = F.lit(None).cast("string")
    for start, kind in reversed(HEADINGS):
        out = F.when(h.rlike(rf"^(?:{start})[a-z ,&]*[:.]?$"), kind).otherwise(out)
    return F.when(F.length(block) < 70, out)


def sections(blocks: DataFrame, kind: Column | None = None) -> DataFrame:
    """Blocks with the section they belong to: the latest heading before them, BODY before the first.

    Ends at a reference list after 300 words, and where 15,000 words are passed.
    """
    in_order = Window.partitionBy("doc").orderBy("pos")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumn("head", heading(F.col("block")) if kind is None else kind).withColumn("words", F.when(F.col("head").isNull(), F.size(F.split("block", " "))).otherwise(0))
    told = marked.withColumn("kind", F.coalesce(F.last("head", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("BODY"))).withColumn("so_far", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ended = told.withColumn("stop", F.max(((F.col("head") == "REFS") & (F.col("so_far") > 300)).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return ended.where((F.coalesce("stop", F.lit(0)) == 0) & (F.col("so_far") < MAX_WORDS) & F.col("head").isNull() & ~F.col("kind").isin("SKIP", "REFS")).select("doc", "pos", "kind", "words", "block")


def relabelled(parts: DataFrame) -> DataFrame:
    """BODY becomes INTRO where a document has headings and DISCUSS where it has none.

    A document without results, discussion or conclusion discusses from its third introducing paragraph on.
    """
    whole = Window.partitionBy("doc")
    any_head = F.max((F.col("kind") != "BODY").cast("int")).over(whole)
    named = parts.withColumn("kind", F.when(F.col("kind") != "BODY", F.col("kind")).when(any_head == 1, "INTRO").otherwise("DISCUSS"))
    argued = F.max(F.col("kind").isin("RESULTS", "DISCUSS", "CONCL").cast("int")).over(whole)
    nth = F.sum((F.col("kind") == "INTRO").cast("int")).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = named.withColumn("_argued", argued).withColumn("_nth", nth)
    return placed.withColumn("kind", F.when((F.col("_argued") == 0) & (F.col("kind") == "INTRO") & (F.col("_nth") > 2), "DISCUSS").otherwise(F.col("kind"))).drop("_argued", "_nth")


def with_abstract(parts: DataFrame, papers: DataFrame) -> DataFrame:
    """Sections (doc, pos, kind, block) in which a curated abstract takes the place of parsed ones.

    ``papers`` has (doc, title, abstract).  A document without any text has its title as the abstract.
    """
    cleaned = papers.select("doc", clean(F.coalesce("title", F.lit(""))).alias("title"), clean(F.coalesce("abstract", F.lit(""))).alias("abstract"))
    body = parts.join(cleaned.select("doc", (F.col("abstract") != "").alias("curated")), "doc", "left").where(~(F.coalesce("curated", F.lit(False)) & (F.col("kind") == "ABSTRACT"))).select("doc", "pos", "kind", "block")
    first = cleaned.where("abstract <> ''").select("doc", F.lit(-1).alias("pos"), F.lit("ABSTRACT").alias("kind"), F.col("abstract").alias("block"))
    both = body.unionByName(first)
    bare = cleaned.join(both.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit(-1).alias("pos"), F.lit("ABSTRACT").alias("kind"), F.col("title").alias("block"))
    return both.unionByName(bare)


def sizes(parts: DataFrame, papers: DataFrame) -> DataFrame:
    """(doc, word_count, full_text): whether there is far more text than an abstract."""
    rolled = parts.groupBy("doc").agg(F.sum(F.length("block") + 1).alias("chars"), F.sum(F.size(F.split(F.trim("block"), r"\s+"))).alias("word_count"))
    short = papers.select("doc", F.greatest(F.length(clean(F.coalesce("abstract", F.lit("")))), F.lit(400)).alias("least"))
    return rolled.join(short, "doc").select("doc", "word_count", (F.col("chars") - 1 > 2 * F.col("least")).alias("full_text"))


def good_block(block: Column) -> Column:
    """Not a line of dots, 40 characters or more, and mostly letters."""
    dense = F.length(F.regexp_replace(block, r"\s", ""))
    return ~block.rlike(r"\.{5,}") & (F.length(block) >= 40) & (F.regexp_count(block, F.lit(r"\p{L}")) >= 0.6 * dense)


def sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, SENTENCE)).alias("pos", "sentence")).select("doc", "pos", F.trim("sentence").alias("sentence")).where("sentence <> ''")


def _packed(parts: Iterable[tuple[str, str]], size: int) -> list[tuple[str, str]]:
    """Passages (kind, text) of a document's (kind, block): see :func:`chunks`."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    count, kind = 0, None

    def close() -> None:
        nonlocal held, count
        if held:
            out.append((kind, " ".join(held)))
        held, count = [], 0

    for k, block in parts:
        if k != kind:
            close()
            kind = k
        long = len(block.split()) > SPLIT * size
        limit = size if long else PACK * size
        for piece in re.split(SENTENCE, block) if long else [block]:
            words = len(piece.split())
            if count and count + words > limit:
                close()
            held.append(piece)
            count += words
    close()
    return out


def chunks(parts: DataFrame, size: int = CHUNK_WORDS) -> DataFrame:
    """(doc, n, kind, text): passages of about ``size`` words that never cross a kind of section.

    Paragraphs are packed up to 1.3 times the size; one of over 1.6 times is cut at sentence
    ends into parts of at most the size, and its last part stays open for what follows.  The
    rule resets at every passage, so it is a fold; documents are the groups, of bounded size
    through the word budget of :func:`sections`.
    """

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = _packed(part.sort_values("pos")[["kind", "block"]].itertuples(index=False, name=None), size)
        return pd.DataFrame({"doc": key[0], "n": range(len(out)), "kind": [k for k, _ in out], "text": [t for _, t in out]})

    return parts.groupBy("doc").applyInPandas(fold, "doc long, n int, kind string, text string")


_NUMBER = re.compile(r"^\s*(?:\d+(?:\.\d+)*\.?|[IVX]+\.)?\s*", re.A)
_OPENS = [(re.compile(rf"(?:{p})[a-z ,&]*[:.]?$"), k) for p, k in HEADINGS]


def _labelled(text: str) -> list[tuple[str, str]]:
    """(kind, block) of one whole document: sections, word budget and labels in one pass."""
    out, kind, so_far = [], "BODY", 0
    for raw in re.sub(r"(\w)-\n(\w)", r"\1\2", text, flags=re.A).split("\n"):
        block = raw.strip(" ")
        if not block:
            continue
        low = _NUMBER.sub("", block, count=1).lower() if len(block) < 70 else ""
        head = next((k for p, k in _OPENS if p.match(low)), None) if low else None
        if head:
            if head == "REFS" and so_far > 300:
                break
            kind = head
        elif so_far < MAX_WORDS and kind not in ("SKIP", "REFS"):
            out.append((kind, block))
        so_far += 0 if head else len(block.split(" "))
    body = "INTRO" if any(k != "BODY" for k, _ in out) else "DISCUSS"
    named = [(body if k == "BODY" else k, b) for k, b in out]
    if any(k in ("RESULTS", "DISCUSS", "CONCL") for k, _ in named):
        return named
    nth = 0
    for i, (k, b) in enumerate(named):
        nth += k == "INTRO"
        if k == "INTRO" and nth > 2:
            named[i] = ("DISCUSS", b)
    return named


def document_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = CHUNK_WORDS) -> DataFrame:
    """The rows of :func:`chunks` of relabelled sections, for documents that are one row each: nothing is shuffled."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, k, t) for d, whole in zip(batch["doc"], batch["text"], strict=True) if whole for n, (k, t) in enumerate(_packed(_labelled(whole), size))]
            yield pd.DataFrame(rows, columns=["doc", "n", "kind", "text"])

    picked = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return picked.mapInPandas(fold, "doc long, n int, kind string, text string")


#: Notes to sources and figures in running text; headings; lines of a table of contents; captions.
CITED_NUMBERS = r"\s?\[\d{1,3}(?:\s?[-–,]\s?\d{1,3})*\]"
CITED_AUTHORS = r"\s?\((?:(?:see |e\.g\., ?)?[A-Z][\w'\-]+(?: et al\.?| and [A-Z][\w'\-]+| & [A-Z][\w'\-]+)?,? (?:19|20)\d{2}[a-z]?(?:, ?(?:19|20)\d{2}[a-z]?)*;?\s?)+\)"
_FIGURE = r"(?:Supplementary |Suppl\.? )?(?:Fig(?:ure)?s?|Tables?)\.?\s?S?\d+[A-Za-z]?(?:\s?[,–\-]\s?S?\d*[A-Za-z]?)*"
CITED_FIGURES = rf"\s?\((?:see )?{_FIGURE}(?:\s?[;,]\s?(?:and )?{_FIGURE})*\)"
HEADING = (
    r"^\s*(?:(?:\d{1,2}(?:\.\d{1,2})*|[IVX]{1,4})[.)]?\s+)?(abstract|summary|introduction|background|nomenclature|"
    r"experimental(?: (?:setup|set-up|apparatus|methods?|procedures?|hardware|approach))?|(?:experiment|test) (?:description|setup|set-up|apparatus|hardware|procedures?)|apparatus|hardware|"
    r"(?:materials? and )?methods?|methodology|approach|numerical (?:model|method)s?|(?:the )?model|results?(?: and discussion)?|discussion|observations|"
    r"conclusions?|concluding remarks|summary and conclusions?|references|bibliography|literature cited|acknowledge?ments?)\s*:?\s*$"
)
CAPTION, CONTENTS = r"^\s*(?:Fig(?:ure)?\.?|Table)\s*\d+[.:]", r"\.{5,}|(?:\. ){5,}"
#: What opens each kind of section, by how a heading begins or what it contains; earlier ones win, all others are methods.
_OPENING = (
    ("REFS", lambda h: h.startswith(("references", "bibliography", "literature cited"))), ("SKIP", lambda h: h.startswith(("acknow", "nomenclature"))), ("RESULTS", lambda h: "result" in h),
    ("ABSTRACT", lambda h: h.startswith("abstract") or h == "summary"), ("CONCL", lambda h: "conclu" in h), ("DISCUSS", lambda h: "discussion" in h or "observation" in h),
    ("INTRO", lambda h: h.startswith(("introduction", "background"))),
)
_PATTERNS = {k: re.compile(p, f) for k, p, f in (("numbers", CITED_NUMBERS, 0), ("authors", CITED_AUTHORS, 0), ("figures", CITED_FIGURES, 0), ("heading", HEADING, re.I), ("caption", CAPTION, re.I), ("contents", CONTENTS, 0))}


def _tidy(text: str, running: bool) -> str:
    """References of HTML resolved and white space made single; from running text notes to sources and figures go too."""
    text = re.sub(r"\s+", " ", html.unescape(text)).strip()
    if running:
        for note in ("numbers", "authors", "figures"):
            text = _PATTERNS[note].sub("", text)
        text = re.sub(r"\s+([.,;:])", r"\1", text).strip()
    return text


def _parsed(report: str) -> list[tuple[str, str]]:
    """(kind, paragraph) of one report; see :func:`report_sections`."""
    out: list[tuple[str, str]] = []
    kind, headed, words = "BODY", False, 0
    joined = re.sub(r"(\w)-\n(\w)", r"\1\2", report.replace("\r", ""))
    for block in re.split(r"\n\s*\n", joined):
        lines = [x for x in (y.strip() for y in block.split("\n")) if x]
        if lines and len(lines[0]) < 70 and (met := _PATTERNS["heading"].match(lines[0])):
            opened = next((k for k, opens in _OPENING if opens(met[1].lower())), "METHODS")
            if opened == "REFS" and words > 300:
                break
            kind, headed, lines = "SKIP" if opened == "REFS" else opened, True, lines[1:]
        paragraph = " ".join(lines)
        letters = sum(map(str.isalpha, paragraph))
        if len(paragraph) < 40 or _PATTERNS["contents"].search(paragraph) or letters < 0.6 * len(paragraph.replace(" ", "")):
            continue
        own = "FIG" if _PATTERNS["caption"].match(paragraph) else kind
        if own != "SKIP":
            out.append((own, _tidy(paragraph, own != "FIG")))
            words += len(out[-1][1].split())
            if words >= MAX_WORDS:
                break
    named = [("INTRO" if headed else "DISCUSS", t) if k == "BODY" else (k, t) for k, t in out]
    if not any(k in ("RESULTS", "DISCUSS", "CONCL") for k, _ in named):
        opening = [i for i, (k, _) in enumerate(named) if k == "INTRO"]
        for i in opening[2:]:
            named[i] = ("DISCUSS", named[i][1])
    return named


def report_sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, kind, block): paragraphs of reports, parted by blank lines, with their sections; nothing is shuffled.

    A short first line that is a known heading, numbered or not, opens a section for what follows.  Lines of a table of
    contents, blocks under 40 characters and those mostly of digits and signs go; captions are of kind FIG, and what thanks,
    names symbols or lists sources goes, the latter with all after it once 300 words are kept.  Words hyphenated across lines are
    joined, notes to sources and figures taken out of running text.  The paragraph that reaches 15,000 words is the last.
    Text before any heading introduces; without headings it discusses, and without a section that argues, what introduces does from
    its third paragraph on.  A null text has no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, k, t) for d, whole in zip(batch["doc"], batch["text"], strict=True) if whole for n, (k, t) in enumerate(_parsed(whole))]
            yield pd.DataFrame(rows, columns=["doc", "pos", "kind", "block"])

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInPandas(parse, "doc long, pos int, kind string, block string")


def report_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = CHUNK_WORDS) -> DataFrame:
    """(doc, n, kind, text): passages, as of :func:`chunks`, of the paragraphs of :func:`report_sections`."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, k, t) for d, whole in zip(batch["doc"], batch["text"], strict=True) if whole for n, (k, t) in enumerate(_packed(_parsed(whole), size))]
            yield pd.DataFrame(rows, columns=["doc", "n", "kind", "text"])

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInPandas(fold, "doc long, n int, kind string, text string")
