"""Tags in plain form, which are read without the standard parser, give the trees that it gives."""

import random
import re

from chronoweave.llm import html_text


def shape(root):
    out, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, str):
            out.append((depth, node))
        else:
            out.append((depth, node.tag, node.drop, node.shown, node.step))
            stack.extend((k, depth + 1) for k in reversed(node.kids))
    return out


def test_same_trees_as_the_parser(monkeypatch):
    draw = random.Random(17)
    parts = ['<div class="post-body">', "<DIV ID=\"Nav\" >", "</div>", "</DIV>", "</div >", '<p>', "</p>", "<br/>", '<br />', '<img alt="a" src="x y"/>', "<header>", "</header>", "<article>", "</article>", '<a href="/x?a=1&amp;b" class="">',
        "</a>", "<g/>", '<path d="m"/>', "<svg>", "</svg>", "<title>", "</title>", "<script>", "</script>", "<textarea>", "</textarea>", "<xmp>", "</xmp>", '<td data-x1="2">', "<li class='a'>", "<li>", "<ul>", "</ul>", "<tr>", '<span style="display:none">', "</span>", '<b hidden>',
        '<i role="search">', '<div class="a" class="ad-box">', '<p class="a<b">', '<p class="unclosed>', "<", ">", "&lt;", "&am", "text", "  \x1f two ", "<!-- c -->", "<![if x]>", "<html>", "<body>", "</body>", "<table>", "</table>", '<div class="' + "w" * 300 + '">', "<option/>", "<div/>"]
    pages = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(3000)]
    fast = [(shape(r := html_text.parse(p)), html_text.main_text(r), html_text.template_candidates(r)) for p in pages]
    for name in ("_PLAIN", "_PLAIN_END"):
        monkeypatch.setattr(html_text, name, re.compile("(?!)"))
    for page, told in zip(pages, fast, strict=True):
        assert told == (shape(r := html_text.parse(page)), html_text.main_text(r), html_text.template_candidates(r)), page


def test_repeated_tags_are_judged_once(monkeypatch):
    judged, plain = [], html_text._furniture
    monkeypatch.setattr(html_text, "_furniture", lambda *x: judged.append(x) or plain(*x))
    html_text._said.clear()
    for k in range(200):
        html_text.parse(f'<nav class="top"><ul><li>{k}</li></ul></nav><article class="post"><p>{k}</p></article>')
    assert len(judged) == 5
    for k in range(3 * html_text._SAID):
        html_text.parse(f'<a href="{k}">x</a>')
    assert len(html_text._said) <= html_text._SAID
