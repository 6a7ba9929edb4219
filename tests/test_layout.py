"""Columns of style sheets against a walk over the tree with a plain matcher; the cascade by cases."""

import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from narrata.operators import layout

PAGES = "book long, path string, markup string"
SHEETS = "book long, path string, css string"


def base(e):
    return "" if e.tag in ("rt", "rp") else (e.text or "") + "".join(base(c) + (c.tail or "") for c in e)


def finds(selector, e, parents):
    """Whether a selector, a list of (combinator, compound), finds e."""
    comb, (tag, marks) = selector[-1]
    own = e.tag in (tag, e.tag if tag == "*" else None) and all((e.get("id") == m[1:]) if m[0] == "#" else m[1:] in (e.get("class") or "").split() for m in marks)
    if not own or len(selector) == 1:
        return own
    up = parents.get(e)
    while up is not None:
        if finds(selector[:-1], up, parents):
            return True
        if comb == ">":
            return False
        up = parents.get(up)
    return False


def expected(text, rules):
    """(markup, columns) by rules: (selector, name, value, important) in order."""
    root = ElementTree.fromstring(text)
    parents = {c: e for e in root.iter() for c in e}
    found = {}
    for e in root.iter():
        ps = [c for c in e if c.tag == "p"]
        if e.tag not in layout.WRAPPERS or not 3 <= len(ps) <= 160 or (e.text or "").strip() or any(c.tag not in ("p", "br") or (c.tail or "").strip() for c in e):
            continue
        sizes = [len(base(p).strip()) for p in ps]
        if all(n.tag in layout.INLINE for p in ps for n in p.iter()) and min(sizes) > 0 and max(sizes) <= 12 and sum(sizes) <= 160:
            found[e] = (ps, max(sizes) == 1)
    style = {}
    for e in root.iter():
        best = {}
        for k, (s, name, value, important) in enumerate(rules):
            if finds(s, e, parents):
                marks = [m for _, (_, ms) in s for m in ms]
                rank = (important, 0, sum(m[0] == "#" for m in marks), sum(m[0] == "." for m in marks), sum(t != "*" for _, (t, _) in s), k)
                best[name] = max(best.get(name, (rank, value)), (rank, value))
        for k, d in enumerate(x for x in (e.get("style") or "").split(";") if x):
            name, value = d.split(":")
            rank = ("!" in value, 1, 0, 0, 0, k)
            best[name] = max(best.get(name, (rank, "")), (rank, value.split("!")[0]))
        mine = {n: v for n, (_, v) in best.items()}
        mode = style[parents[e]].get("writing-mode") if e in parents else None
        if mine.get("writing-mode", "inherit") == "inherit" and mode:
            mine["writing-mode"] = mode
        style[e] = mine
    beside = {e for e in found if style[e].get("float") in layout.BESIDE}
    two = sum(found[e][1] for e in beside) >= 2
    won = {e for e, (_, one) in found.items() if (one and style[e].get("writing-mode") in layout.UPRIGHT) or (e in beside and (one or two))}
    for e in won:
        for p in found[e][0]:
            p.tag = "span"
    for e in list(root.iter()):
        cs = list(e)
        if len(cs) >= 2 and all(c in won and found[c][1] for c in cs) and not (e.text or "").strip() and not any((c.tail or "").strip() for c in cs) and sum(len(base(c).strip()) for c in cs) <= 160:
            for c in cs:
                c.tag = "span"
    return ElementTree.tostring(root, encoding="unicode"), len(won)


def page_at_random(r):
    style = lambda: r.choice(["", "", "", " style='float:right'", " style='writing-mode:tb-rl;float:none!important'", " style='writing-mode:inherit'"])
    mark = lambda: r.choice(["", " class='a'", " class='b a'", " class='c'", " id='i'"])

    def column():
        letters = r.random() < 0.7
        word = lambda: r.choice("天地xy") if letters else r.choice(["two", "x y", "thirteen long", " ok "])
        inner = lambda: r.choice([word(), f"<b>{word()}</b>", f"<ruby>{word()}<rt>long reading</rt></ruby>", f" {word()}"])
        parts = [f"<p{mark()}>{inner()}</p>" for _ in range(r.choice([2, 3, 3, 4, 5]))]
        if r.random() < 0.2:
            parts.insert(1, r.choice(["<br/>", "text", "<hr/>", "<p/>", "<p><i><img/></i></p>"]))
        tag = r.choice(["div", "section", "div", "span"])
        return f"<{tag}{mark()}{style()}>" + r.choice(["", "\n"]).join(parts) + f"</{tag}>"

    def block(depth=0):
        inner = "".join(column() if depth > 1 or r.random() < 0.6 else block(depth + 1) for _ in range(r.randint(1, 3)))
        tag = r.choice(["div", "article", "blockquote"])
        return f"<{tag}{mark()}{style()}>{r.choice(['', '', 'said '])}{inner}</{tag}>"

    return "<body>" + "".join(block() for _ in range(r.randint(1, 3))) + "<div/></body>"


def test_columns_at_random(spark):
    r = random.Random(5)
    compound = lambda: (r.choice(["*", "div", "section", "blockquote", "article"]), r.choice([[], [".a"], [".b"], [".a", ".b"], ["#i"], [".c"]]))
    pages, want = [], {}
    for k in range(150):
        rules = []
        for _ in range(r.randint(0, 6)):
            s = [(None, compound())] + [(r.choice([" ", ">"]), compound()) for _ in range(r.choice([0, 0, 1, 2]))]
            # The combinator before a compound tells how it hangs on what is before it.
            name, value = r.choice([("float", "left"), ("float", "none"), ("writing-mode", "vertical-rl"), ("writing-mode", "horizontal-tb"), ("writing-mode", "inherit")])
            rules.append((s, name, value, r.random() < 0.2))
        told = lambda s: "".join((f" {c} " if c == ">" else c or "") + t + "".join(ms) for c, (t, ms) in s)
        css = "@import 'x;{';@media print { div { float: left } } /* p{ */ p::before{float:left} " + "".join(f"{told(s)} {{ color: red; {n.upper()} : {v}{' ! important' if i else ''} }}" for s, n, v, i in rules)
        body = page_at_random(r)
        pages.append((1, f"p{k}", f"<html><head><style>{css.replace('>', '&gt;')}</style></head>{body}</html>"))
        want[f"p{k}"] = expected(pages[-1][2], rules)
    got = layout.running(spark.createDataFrame(pages, PAGES), spark.createDataFrame([], SHEETS)).collect()
    assert len(got) == 150 and sum(n > 0 for _, n in want.values()) > 30 and sum("<span" in m for m, _ in want.values()) > 30
    for x in got:
        tree, n = want[x.path]
        page = next(p for p in pages if p[1] == x.path)[2]
        assert x["columns"] == n, page
        assert ElementTree.tostring(ElementTree.fromstring(x.markup), encoding="unicode") == tree, page


def test_linked_sheets_and_bounds(spark):
    column = "<div class='v'><p>a</p><p>b</p><p>c</p></div>"
    link = lambda *to: "<html><head>" + "".join(f"<link rel='alternate StyleSheet' href='{x}'/>" for x in to) + f"</head><body>{column}</body></html>"
    long = " " * layout.SHEET_BYTES
    pages = [
        (1, "a/x.xhtml", link("../c/v.css")), (1, "a/other.xhtml", link("v.css")), (1, "a/web.xhtml", link("http://e.org/v.css")), (2, "a/x.xhtml", link("../c/v.css")), (1, "long.xhtml", link("c/long.css")),
        (1, "many.xhtml", link(*["c/most.css"] * 5, "c/v.css")), (1, "full.xhtml", link(*["c/most.css"] * 4, "c/v.css")), (1, "late.xhtml", link("c/h.css", "c/v.css")), (1, "first.xhtml", link("c/v.css", "c/h.css")),
        (1, "none.xhtml", None), (1, "empty.xhtml", ""), (1, "doc.xhtml", f"<?xml version='1.0'?><!DOCTYPE html><!-- <p> --><html xmlns:h='h'><body><h:div style='float:left'><h:p>a</h:p> <h:p>b</h:p><p>c</p></h:div></body></html>"),
    ]
    sheets = [(1, "c/v.css", ".v{writing-mode:vertical-rl}"), (1, "c/h.css", "@media all{@supports (x){.v{float:left}}}.v{writing-mode:horizontal-tb}"), (1, "c/long.css", ".v{float:left}" + long), (1, "c/most.css", " " * (layout.SHEET_BYTES - 1)), (1, "c/null.css", None)]
    x = layout.running(spark.createDataFrame(pages, PAGES).withColumn("extra", F.lit(1)), spark.createDataFrame(sheets, SHEETS))
    got = {(r.book, r.path): r for r in x.collect()}
    assert len(got) == len(pages) and x.columns == ["book", "path", "markup", "extra", "columns"]
    assert {k for k, r in got.items() if r["columns"]} == {(1, "a/x.xhtml"), (1, "late.xhtml"), (1, "doc.xhtml")}
    assert got[1, "a/x.xhtml"].markup.endswith("<div class='v'><span>a</span><span>b</span><span>c</span></div></body></html>")
    assert got[1, "doc.xhtml"].markup == "<?xml version='1.0'?><!DOCTYPE html><!-- <p> --><html xmlns:h='h'><body><h:div style='float:left'><span>a</span> <span>b</span><span>c</span></h:div></body></html>"
    assert got[1, "none.xhtml"].markup is None and got[1, "empty.xhtml"].markup == "" and layout.running(spark.createDataFrame([], PAGES), spark.createDataFrame(sheets, SHEETS)).count() == 0


def test_elements_that_may_be_columns_are_a_row_each(spark, monkeypatch):
    """No table that is kept has a row for each paragraph of an element that is too long for a column."""
    kept, settled = [], layout.settled
    monkeypatch.setattr(layout, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    put = lambda n: "".join("<p>天</p>" for _ in range(n))
    hidden = "<!-- <div> --><p>a<![CDATA[<div>]]></p>"
    body = f"<div>{put(2000)}</div><h:div style='float:left'>{put(3)}</h:div><td><div class='v' title='</div>'>{put(3)}</div > <section class='v'><p>x<p/></p>{put(2)}</section></td><div style='float:left'>{hidden}{put(2)}</div><rt><div style='float:left'>{put(3)}</div></rt>"
    page = f"<html xmlns:h='h'><head><style>.v{{writing-mode:vertical-rl}}</style></head><body>{body}</body></html>"
    got = layout.running(spark.createDataFrame([(1, "x", page)], PAGES), spark.createDataFrame([], SHEETS)).first()
    span = lambda n: put(n).replace("p>", "span>")
    assert got["columns"] == 3
    assert got.markup == page.replace(f"<h:div style='float:left'>{put(3)}", f"<h:div style='float:left'>{span(3)}").replace(
        f"<td><div class='v' title='</div>'>{put(3)}</div > <section class='v'><p>x<p/></p>{put(2)}</section>", f"<td><span class='v' title='</div>'>{span(3)}</span > <span class='v'><span>x<p/></span>{span(2)}</span>"
    )
    assert kept and max(x.count() for x in kept) < 200
