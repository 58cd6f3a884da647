"""HTML to Markdown against a recursive writer over the trees it was made from, and hand examples."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import markup
from lumenfold.functions.markup import Writer
from lumenfold.plans import registry

registry.load()
BLOCK = {"p", "h2", "ul", "ol", "blockquote", "pre", "table", "hr", "div", "nav", "article", "footer", "h1", "li", "section", "html", "head", "body"}


def md(html, **sources):
    return Writer(sources).write(html)


def squeeze(text):
    return " ".join(text.split(" "))


def words(rng):
    return " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(1, 3)))


def inline(rng, depth):
    kind = rng.choice(["text", "text", "b", "em", "code", "a", "span"] if depth else ["text"])
    if kind in ("text", "code"):
        return words(rng) if kind == "text" else (kind, [words(rng)])
    # blanks and words between, since marks side by side are drawn together
    return (kind, [words(rng) + " ", inline(rng, depth - 1), " " + words(rng)])


def block(rng, depth):
    kind = rng.choice(["p", "h2", "ul", "ol", "blockquote", "pre", "table", "hr", "div"] if depth else ["p", "h2", "pre", "hr"])
    some = lambda: [block(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    if kind in ("p", "h2"):
        return (kind, [inline(rng, 2)])
    if kind in ("ul", "ol"):
        return (kind, [("li", [words(rng), *([block(rng, depth - 1)] if rng.random() < 0.4 else [])]) for _ in range(rng.randint(1, 3))])
    if kind == "table":
        return (kind, [("tr", [("td", [words(rng)]) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 3))])
    return (kind, {"pre": [words(rng) + "\n  x = 1"], "hr": []}.get(kind) or (some() if kind != "hr" else []))


def html_of(node):
    if isinstance(node, str):
        return node
    name, kids = node
    inner = "".join(map(html_of, kids))
    return "<hr>" if name == "hr" else f'<a href="http://x/y">{inner}</a>' if name == "a" else f"<{name}>{inner}</{name}>"


def line(node):
    if isinstance(node, str):
        return node
    name, kids = node
    inner = "".join(map(line, kids))
    return {"b": f"**{inner}**", "em": f"*{inner}*", "code": f"`{inner}`", "a": f"[{inner}](http://x/y)"}.get(name, inner)


def runs(kids):
    """Blocks of some nodes, inline ones between them as paragraphs."""
    out, run = [], ""
    for k in kids:
        if isinstance(k, tuple) and k[0] in BLOCK:
            out += [run] * bool(run.strip()) + blocks(k)
            run = ""
        else:
            run += line(k)
    return out + [run] * bool(run.strip())


def deeper(text):
    return "\n".join("    " + x if x else "" for x in text.split("\n"))


def blocks(node):
    name, kids = node
    if name == "hr":
        return ["---"]
    if name in ("h1", "h2"):
        return [f"{'#' * int(name[1])} {''.join(map(line, kids))}"]
    if name == "pre":
        return ["```\n" + "".join(kids) + "\n```"]
    if name == "blockquote":
        return ["\n".join("> " + x if x else ">" for x in "\n\n".join(runs(kids)).split("\n"))]
    if name == "table":
        rows = [[line(c) for c in r[1]] for r in kids]
        wide = max(map(len, rows))
        made = ["| " + " | ".join(r + [" "] * (wide - len(r))) + " |" for r in rows]
        return ["\n".join([made[0], "|" + " --- |" * wide, *made[1:]])]
    if name in ("ul", "ol"):
        items = []
        for n, li in enumerate(kids):
            first, *rest = runs(li[1])
            item, listed = (f"{n + 1}. " if name == "ol" else "- ") + first, False
            for b in rest:
                one = b.startswith(("- ", "1. "))
                item += ("\n" if one and not listed else "\n\n") + deeper(b)
                listed = one
            items.append(item)
        return ["\n".join(items)]
    return runs(kids)


@pytest.mark.parametrize("seed", range(60))
def test_random_trees(seed):
    rng = random.Random(seed)
    tree = [block(rng, 3) for _ in range(4)]
    html = "\n".join(map(html_of, tree))
    assert md(html) == "\n\n".join(runs(tree))


def test_hand_examples():
    assert md("<h3>1.&nbsp;<strong>Main &amp; first</strong></h3><ul><li><b><u><a href='http://e/a?x=1&amp;y=2'>T</a></u></b>: in</li><li><p>Two</p><ol start=\"3\"><li>x</li><li>y</li></ol></li></ul>") == "### 1. **Main & first**\n\n- **[T](http://e/a?x=1&y=2)**: in\n- Two\n    3. x\n    4. y"
    assert md("<p>One<br>two</p><p># no</p><p>12. no</p><p>- no</p><p>a | b</p><p>| no</p>") == "One\\\ntwo\n\n\\# no\n\n12\\. no\n\n\\- no\n\na | b\n\n\\| no"
    assert md("<p>s_c _d_ [e](f) *g* `h` &#233;&#x2014;&deg; &nix; ~~i~~ \\j \\! &lt;k &lt; l</p>") == "s_c \\_d\\_ \\[e\\](f) \\*g\\* \\`h\\` é—° &nix; \\~\\~i\\~\\~ \\j \\\\! \\<k < l"
    assert md("<table><thead><tr><th>N<th>V | w<tbody><tr><td><p>a</p><p>b</p><td><ul><li>c</ul><tr><td>d</table>") == "| N | V \\| w |\n| --- | --- |\n| a b | - c |\n| d |   |"
    assert md("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>") == "| a \\| b \\| \\| --- \\| |\n| --- |"
    assert md('<pre><code class="x language-python">a &lt; b\n```c```</code></pre>') == "````python\na < b\n```c```\n````"
    assert md("x <code>a `b` c`</code> y<script>no</script><style>no</style><!-- no --><svg>no</svg> <img src='http://i/p q.png' alt='[z]'><img src=local>") == "x `` a `b` c` `` y ![z](http://i/p%20q.png)"
    assert md("<ul><li>a</li><ul><li>b</li></ul><li>c</li>loose</ul><li>out</li>") == "- a\n    - b\n- c\n- loose\n\n- out"
    assert md("<blockquote><p>a<p>b<blockquote>c</blockquote></blockquote>") == "> a\n>\n> b\n>\n> > c"
    assert md("") == md("  \n ") == md("<p> </p><div></div>") == "" and md("2 < 3 > 1 </nothing>") == "2 < 3 > 1"
    assert md("<i> a </i><b>b</b><b>c</b><a href='javascript:x'>d</a><a href='u v'> e </a>") == "*a* **bc**d [e](u%20v)"
    deep = 20_000
    assert md("<div>" * deep + "x" + "</div>" * deep) == "x" and md("<b>" * 50 + "x") == "*" * 100 + "x" + "*" * 100
    assert md("<p>" + "word " * 100_000) == ("word " * 100_000).strip()


def test_highlights():
    data = '%7B%22attachmentURI%22%3A%22http%3A//z/items/AAA%22%2C%22color%22%3A%22%235FB236%22%2C%22position%22%3A%7B%22pageIndex%22%3A4%7D%2C%22citationItem%22%3A%7B%22uris%22%3A%5B%22http%3A//z/items/BBB%22%5D%7D%7D'
    html = f'<p>before <span class="highlight" data-annotation="{data}">“Said *so*”</span> <span class="citation">(Him, p. 5)</span> after</p>'
    assert md(html) == "before\n\n> Said \\*so\\*\n\nafter"
    assert md(html, BBB="src 1") == 'before\n\n```quote source="src 1" page="4" color="green"\nSaid \\*so\\*\n```\n\nafter'
    assert md(f'<h1><span class="highlight" data-annotation="{data}">in a heading</span></h1><p><span class="highlight" data-annotation="%7B">broken</span></p>') == "# in a heading\n\nbroken"


class Tree(HTMLParser):
    """Pages as trees; a paragraph ends where a block begins, unless another block is open in it."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.silent = [("", [])], False
        self.feed(html)
        self.close()
        self.upto(1)

    def upto(self, n):
        while len(self.stack) > n:
            node = self.stack.pop()
            self.stack[-1][1].append(node)

    def handle_starttag(self, name, attrs):
        self.silent = name in ("script", "style")
        if self.silent or name in ("meta", "br"):
            if name == "br":
                self.stack[-1][1].append(("br", []))
            return
        if name in BLOCK:
            opened = [i for i, (n, _) in enumerate(self.stack) if n == "p"]
            if opened and not any(n in BLOCK for n, _ in self.stack[opened[-1] + 1 :]):
                self.upto(opened[-1])
        self.stack.append((("a", dict(attrs).get("href", "")) if name == "a" else name, []))

    def handle_endtag(self, name):
        self.silent = False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name or name == "a" and self.stack[i][0][0] == "a":
                return self.upto(i)

    def handle_data(self, text):
        if not self.silent:
            self.stack[-1][1].append(text)


def page_line(node):
    """Inline Markdown; a paragraph under an unclosed mark is words among others."""
    if isinstance(node, str):
        node = " ".join(node.replace("\n", " ").split(" "))
        out = ""
        for i, c in enumerate(node):
            before, after = node[i - 1 : i], node[i + 1 : i + 2]
            hit = c in "*`" or c == "_" and not (before.isalnum() and after.isalnum()) or c == "~" and "~" in (before, after) or c in "[]" and "](" in node
            hit = hit or c == "\\" and after.isascii() and after.isprintable() and after and not after.isalnum() and after != " " or c == "<" and (after in ("/", "!") and after or after.isascii() and after.isalpha())
            out += "\\" * bool(hit) + c
        return out
    name, kids = node
    inner = "" if name != "br" else "\\\n"
    for k in kids:
        if isinstance(k, tuple) and k[0] in BLOCK:
            told = " ".join(page_blocks([k])).replace("\n", " ")
            inner += " " * bool(inner and told and not inner.endswith(" ")) + told
        else:
            inner += page_line(k)
    core = inner.strip(" \n")
    if name == "b" and core:
        return inner.replace(core, f"**{core}**")
    return f"[{inner}]({name[1]})" if isinstance(name, tuple) and inner.strip() and name[1] else inner


def page_blocks(kids):
    out, run = [], ""
    for k in [*kids, ("end", [])]:
        name = k[0] if isinstance(k, tuple) else ""
        if name in BLOCK or name == "end":
            text = run.strip(" \n\xa0")
            if text and text.strip("\\/ "):
                out.append("\n".join("\\" + x if x[:1] in ("#", ">", "|") or x[:2] in ("- ", "+ ") or x == "-" or x[:3] in ("---", "===", "```", "~~~") else x for x in text.split("\n")))
            run = ""
            if name == "h1":
                heading = "".join(map(page_line, k[1])).strip()
                out += ["# " + heading] * bool(heading)
            elif name == "ul":
                out.append("\n".join("- " + page_line(li).strip() for li in k[1] if li[0] == "li"))
            elif name != "end":
                out += page_blocks(k[1])
        else:
            run += page_line(k)
    return out


def test_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.markdown for r in registry.QUERIES["page_markdown"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        assert got[i] == "\n\n".join(page_blocks(Tree(html).stack[0][1])).strip(), i


def test_columns(spark):
    df = spark.createDataFrame([("<b>x</b>", {"K": "s"}), (None, None)], "h string, k map<string,string>")
    assert [r[0] for r in df.select(markup.html_to_markdown(F.col("h"), F.col("k"))).collect()] == ["**x**", None]
    text = spark.createDataFrame([("<p>Salt &amp; tin</p><P class='a'>Lead<br/>zinc<b>\n  iron  </b><x <li>gold</ul>&lt;&amp;lt;<p",)], "h string").select(markup.note_text(F.col("h"))).first()[0]
    assert text == "Salt & tin\nLead\nzinc\niron\ngold<&lt;"
