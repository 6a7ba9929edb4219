"""Rows of markup against a walk over the tree of an XML parser; contents and chapters by hand-made cases; damaged files."""

import random
from xml.etree import ElementTree

from narrata.operators import markup
from narrata.sources import epub


def local(e):
    return e.tag.rpartition("}")[2]


def walk(root):
    """[tag, text, ruby] of each block: a block goes from where an element begins it to the next one that does."""
    blocks, anchors = [["p", "", []]], {}

    def put(text):
        piece = " ".join((text or "").split())
        start = len(blocks[-1][1])
        blocks[-1][1] += piece
        return start, start + len(piece), piece

    def visit(e):
        tag = local(e)
        if tag in markup.SKIPPED:
            return
        if tag in markup.BLOCKS:
            blocks.append([tag, "", []])
        if tag in markup.IMAGES:
            blocks.append([tag, "", []])
        for name in [e.get("id"), e.get("name") if tag == "a" else None]:
            if name:
                anchors.setdefault(name, (len(blocks) - 1, len(blocks[-1][1])))
                break
        if tag in markup.IMAGES:
            blocks.append(["p", "", []])
            return
        if tag == "ruby":
            base, said = [e.text or ""], []
            for c in e:
                if local(c) == "rt":
                    said.append("".join(c.itertext()).strip())
                elif local(c) != "rp":
                    base.append("".join(c.itertext()))
                base.append(c.tail or "")
            start, end, piece = put("".join(base))
            if piece and any(said):
                blocks[-1][2].append((start, end, piece, " ".join(x for x in said if x)))
            return
        put(e.text)
        for c in e:
            visit(c)
            put(c.tail)

    visit(root)
    kept = [k for k, b in enumerate(blocks) if b[1] or b[0] in markup.IMAGES]
    places = {n: (kept.index(b) if b in kept else sum(k < b for k in kept), o if b in kept else 0) for n, (b, o) in anchors.items()}
    return [blocks[k] for k in kept], places


def markup_at_random(r, depth=0):
    out = []
    for _ in range(r.randint(0, 4)):
        kind = r.random()
        if kind < 0.45:
            out.append(r.choice([" one ", "two  three", "\n", "x &amp; y", "&#x4e00;&#8230;", "<![CDATA[<p> &amp;]]>", "<!-- <p> -->", "<?x <p>?>", " a<!-- c --> b "]))
        elif kind < 0.55:
            out.append(r.choice(["<br/>", "<hr/>", "<img src='s' alt=\"a > b\"/>", "<script>p</script>", "<a id='q%d'/>" % r.randrange(9)]))
        elif kind < 0.65:
            out.append("<ruby>b1 <rp>(</rp><rt> t%d</rt><rp>)</rp>%s<rt/></ruby>" % (r.randrange(9), r.choice(["", " <b>b2</b>"])))
        elif depth < 4:
            tag = r.choice(["p", "div", "blockquote", "b", "span", "h2", "li", "ns:em"])
            named = r.choice(["", f" id='n{r.randrange(9)}'", f' data-x="a>b" id="m{r.randrange(9)}"'])
            out.append(f"<{tag}{named}>{markup_at_random(r, depth + 1)}</{tag}>")
    return "".join(out)


def test_blocks_and_anchors_at_random(spark):
    r = random.Random(3)
    pages = [(1, f"p{k}", f"<html xmlns:ns='n'><head><title>t</title></head><body>{markup_at_random(r)}</body></html>") for k in range(120)]
    blocks, anchors = markup.page_blocks(spark.createDataFrame(pages, "book long, path string, markup string"))
    got, places = {}, {}
    for x in sorted(blocks.collect(), key=lambda x: x.block):
        got.setdefault(x.path, []).append([x.tag, x.text, [tuple(y) for y in x.ruby]])
    for x in anchors.collect():
        places.setdefault(x.path, {})[x.anchor] = (x.block, x.offset)
    for _, path, text in pages:
        want, named = walk(ElementTree.fromstring(text))
        assert got.get(path, []) == want, text
        assert places.get(path, {}) == named, text


def test_repairs(spark):
    pages = {
        "good": b"<p>&amp;</p>", "named": "<p>&eacute;&nbsp;<!-- &eacute; --><![CDATA[&eacute;]]></p>".encode(), "broken": b"<p>&eacute;", "own": b'<!DOCTYPE p [<!ENTITY x "y">]><p>&eacute;</p>',
        "utf16": "<?xml version='1.0' encoding='utf-16'?><p>é</p>".encode("utf-16"), "latin": "<?xml version='1.0' encoding='iso-8859-1'?><p>é</p>".encode("latin-1"), "empty": b"", "none": None,
    }
    got = {x.path: x for x in markup.repaired(spark.createDataFrame([(1, k, v) for k, v in pages.items()], "book long, path string, content binary")).collect()}
    assert {k for k, x in got.items() if x.error is None} == {"good", "named", "utf16", "latin"}
    assert {k for k, x in got.items() if x.mended} == {"named", "broken"}
    assert got["named"].markup == "<p>&#233;&#160;<!-- &eacute; --><![CDATA[&eacute;]]></p>" and got["utf16"].markup.endswith("<p>é</p>") and "é" in got["latin"].markup


def test_contents_and_chapters(spark):
    nav = "<html><body><nav type='landmarks'><ol><li><a href='no'>no</a></li></ol></nav><nav><ol><li><a href='b.xhtml'>Part <i>I</i></a><ol><li><a href='b.xhtml'>One</a> more</li><li><span>Two</span><ul><li><a href='b.xhtml#mid'>Deep</a></li></ul></li></ol></li><li><a href='gone.xhtml'>x</a></li><li><a href='b.xhtml#no'>y</a></li><li><a href='http://e.org/b.xhtml'>z</a></li><li><a href='b.xhtml#end'>E</a></li></ol></nav></body></html>"
    entries = markup.contents(spark.createDataFrame([(1, "nav.xhtml", nav)], "book long, path string, markup string"))
    told = {x.entry: (x.parent, x.title, x.volume, x.is_parent, x.href) for x in entries.collect()}
    assert told == {
        0: (None, "Part I", "", True, "b.xhtml"), 1: (0, "One", "Part I", False, "b.xhtml"), 2: (0, "Two", "Part I", True, ""), 3: (2, "Deep", "Part I · Two", False, "b.xhtml#mid"),
        4: (None, "x", "", False, "gone.xhtml"), 5: (None, "y", "", False, "b.xhtml#no"), 6: (None, "z", "", False, "http://e.org/b.xhtml"), 7: (None, "E", "", False, "b.xhtml#end"),
    }
    pages = [(1, "a.xhtml", "<p>front</p>"), (1, "b.xhtml", "<body><p>first</p><p>half<a id='mid'/>rest</p><p>last<a id='end'/></p></body>"), (1, "c.xhtml", "<p>tail</p>")]
    blocks, anchors = markup.page_blocks(spark.createDataFrame(pages, "book long, path string, markup string"))
    spine = spark.createDataFrame([(1, p[1], k) for k, p in enumerate(pages)], "book long, path string, position long")
    got = sorted((x.chapter, x.title, x.block, x.text, x.continues) for x in markup.chapters(blocks, anchors, entries, spine).collect())
    assert got == [(0, "卷首", 0, "front", False), (1, "Part I · One", 1, "first", False), (1, "Part I · One", 2, "half", False), (2, "Part I · Two · Deep", 2, "rest", True), (2, "Part I · Two · Deep", 3, "last", False), (3, "E", 4, "tail", False)]
    assert markup.chapters(blocks, anchors, entries.limit(0), spine).count() == 0


def test_damaged_archives(spark):
    book = bytearray(epub.build("t", [("a", ["one two three " * 200])]))
    at = book.find(b"book/c0.xhtml") + 40
    book[at : at + 2] = bytes(255 - x for x in book[at : at + 2])
    rows = epub.members(spark.createDataFrame([(1, book), (2, bytearray(b"no")), (3, None)], "book long, content binary")).collect()
    assert {x.book for x in rows if x.error} == {1, 2, 3} and len(rows) == 3
    assert epub.blocks(spark.createDataFrame([(1, book)], "book long, content binary")).first().error
    page = ElementTree.fromstring("<body>bare<div>in <blockquote><p>one</p>after</blockquote></div></body>")
    assert list(epub.blocks_of(page)) == [("p", "bare"), ("div", "in"), ("p", "oneafter")]
