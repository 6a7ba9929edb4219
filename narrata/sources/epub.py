"""EPUB files, one a row: written from chapters, and read back to tables of contents and blocks of text."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions.slices import mapped

MEDIA = "application/epub+zip"
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "div", "section", "td", "th"}


class BadBook(ValueError):
    """A file that isn't an EPUB as it should be."""


def _page(title: str, body: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body>{body}</body></html>'


def build(title: str, chapters: list[tuple[str, list[str]]], annotations: str = "{}") -> bytes:
    """A book of chapters (title, paragraphs): its type first and stored as it is, then contents, pages and annotations."""
    names = [f"c{k}.xhtml" for k in range(len(chapters))]
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
    links = "".join(f'<li><a href="{n}">{escape(c[0])}</a></li>' for n, c in zip(names, chapters, strict=True))
    files = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="book/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "book/book.opf": f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{spine}</spine></package>',
        "book/nav.xhtml": _page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>'),
        "book/annotations.json": annotations,
        **{f"book/{n}": _page(c[0], f"<h1>{escape(c[0])}</h1>" + "".join(f"<p>{escape(p)}</p>" for p in c[1])) for n, c in zip(names, chapters, strict=True)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MEDIA, zipfile.ZIP_STORED)
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def entries(raw: bytes, most_entries: int = 0, most_bytes: int = 0) -> dict[str, bytes]:
    """The files of an archive by name. Names that lead outside, occur twice or are encrypted, links, and damage are refused.

    most_entries, most_bytes: of an archive, and of an entry; 0 for any number.
    """
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise BadBook("not an archive") from e
    out: dict[str, bytes] = {}
    infos = z.infolist()
    if most_entries and len(infos) > most_entries:
        raise BadBook("too many entries")
    for i in infos:
        name = i.filename
        if name.startswith("/") or "\\" in name or ".." in name.split("/") or ":" in name.split("/")[0]:
            raise BadBook(f"unsafe name {name[:80]!r}")
        if i.flag_bits & 1 or (i.external_attr >> 16) & 0o170000 == 0o120000 or most_bytes and i.file_size > most_bytes or name in out:
            raise BadBook(f"entry {name[:80]!r} is refused")
        if not i.is_dir():
            try:
                out[name] = z.read(i)
            except (zlib.error, zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError) as e:
                raise BadBook(f"entry {name[:80]!r} is damaged") from e
    return out


def _tree(files: dict[str, bytes], name: str) -> ElementTree.Element:
    if name not in files:
        raise BadBook(f"no {name[:80]}")
    if b"<!ENTITY" in files[name]:
        raise BadBook("entities of its own")
    try:
        return ElementTree.fromstring(files[name])
    except ElementTree.ParseError as e:
        raise BadBook(f"{name[:80]}: {e}") from e


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def blocks_of(page: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(tag, text) of the blocks of a page, white space collapsed, empty ones left out.

    A block goes from where an element opens it to where the next one does, so that nothing comes twice or is lost.
    """
    found: list[tuple[str, list[str]]] = [("p", [])]
    left: list[ElementTree.Element | str] = [page]
    while left:
        e = left.pop()
        if isinstance(e, str):
            found[-1][1].append(e)
            continue
        if _local(e) in ("head", "script", "style"):
            continue
        if _local(e) in BLOCKS:
            found.append((_local(e), []))
        for child in reversed(e):
            left += [child.tail or "", child]
        left.append(e.text or "")
    for tag, parts in found:
        if text := " ".join("".join(parts).split()):
            yield tag, text


def read(raw: bytes) -> tuple[dict[str, str], list[tuple[int, int, str, str, str]]]:
    """(titles by href from the table of contents, rows (chapter, block, tag, text, href) in the order of the spine)."""
    files = entries(raw)
    if files.get("mimetype", b"").strip() != MEDIA.encode():
        raise BadBook("not of its type")
    roots = [e.get("full-path", "") for e in _tree(files, "META-INF/container.xml").iter() if _local(e) == "rootfile"]
    opf = _tree(files, roots[0] if roots else "")
    home = posixpath.dirname(roots[0])
    at = lambda href: posixpath.normpath(posixpath.join(home, unquote(href.partition("#")[0])))
    manifest = {e.get("id"): e for e in opf.iter() if _local(e) == "item"}
    toc: dict[str, str] = {}
    for item in manifest.values():
        if "nav" in (item.get("properties") or "").split():
            for a in _tree(files, at(item.get("href", ""))).iter():
                if _local(a) == "a" and a.get("href"):
                    toc.setdefault(at(a.get("href", "")), " ".join("".join(a.itertext()).split()))
    rows = []
    for chapter, ref in enumerate(e for e in opf.iter() if _local(e) == "itemref"):
        item = manifest.get(ref.get("idref"))
        if item is None:
            raise BadBook("the spine names what isn't there")
        href = at(item.get("href", ""))
        rows += [(chapter, k, tag, text, href) for k, (tag, text) in enumerate(blocks_of(_tree(files, href)))]
    return toc, rows


def members(files: DataFrame, key: str = "book", most_entries: int = 0, most_bytes: int = 0) -> DataFrame:
    """key, name, content, error: the files in each archive; an archive that can't be read gives one row, with the error."""
    kind = files.schema[key].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for k, raw in zip(f[key], f["content"], strict=True):
            try:
                rows += [(k, name, data, None) for name, data in entries(bytes(raw or b""), most_entries, most_bytes).items()]
            except BadBook as e:
                rows.append((k, None, None, str(e)))
        return pd.DataFrame(rows, columns=[key, "name", "content", "error"])

    return mapped(files.select(key, "content"), run, f"{key} {kind}, name string, content binary, error string")


def zipped(files: DataFrame) -> DataFrame:
    """book, content: an archive of each book's files (book, name, text), its type first and stored as it is."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("name") != "mimetype", "name", "text")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        made = []
        for parts in f["rows"]:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for x in parts:
                    z.writestr(zipfile.ZipInfo(x["name"]), x["text"], zipfile.ZIP_STORED if x["name"] == "mimetype" else zipfile.ZIP_DEFLATED)
            made.append(out.getvalue())
        return pd.DataFrame({"book": f["book"], "content": made})

    return mapped(files.groupBy("book").agg(rows.alias("rows")), run, "book long, content binary")


def built(paragraphs: DataFrame) -> DataFrame:
    """book, content: an EPUB for each book of paragraphs (book, chapter, title, position, text)."""
    rows = F.array_sort(F.collect_list(F.struct("chapter", "position", "title", "text")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        made = []
        for book, parts in zip(f["book"], f["rows"], strict=True):
            chapters: dict[int, tuple[str, list[str]]] = {}
            for x in parts:
                chapters.setdefault(x["chapter"], (x["title"] or "", []))[1].append(x["text"] or "")
            made.append(build(f"book {book}", list(chapters.values())))
        return pd.DataFrame({"book": f["book"], "content": made})

    return mapped(paragraphs.groupBy("book").agg(rows.alias("rows")), run, "book long, content binary")


def blocks(files: DataFrame, key: str = "book") -> DataFrame:
    """key, chapter, title, block, tag, text, error for every block of files (key, content), as of spark.read.format("binaryFile").

    A file that can't be read gives one row, with the error.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, raw in zip(f[key], f["content"], strict=True):
            try:
                toc, got = read(bytes(raw or b""))
                rows += [(k, chapter, toc.get(href), block, tag, text, None) for chapter, block, tag, text, href in got]
            except BadBook as e:
                rows.append((k, None, None, None, None, None, str(e)))
        out = pd.DataFrame(rows, columns=[key, "chapter", "title", "block", "tag", "text", "error"])
        return out.astype({"chapter": "Int64", "block": "Int64"})

    return mapped(files.select(key, "content"), run, f"{key} {kind}, chapter long, title string, block long, tag string, text string, error string")
