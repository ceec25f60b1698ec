"""What a page shows: rules one by one, and random pages whose visible words are known when they are made."""

import random

import pytest

from voxelweave.llm import html_text

CASES = {
    "<table><tr><td rowspan=2>A<td>b<tr><td>c</table>": "A  b\n   c",
    "<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>": "A  b\n   c\n   d",
    "<table><tr><td>a<td rowspan=2 colspan=2>B<td>c<tr><td>d<td>e</table>": "a  B  c\nd     e",
    "<table><tr><td colspan=60>w<td>x<tr>" + "<td>a" * 60 + "<td>y</table>": "w" + " " * 179 + "x\n" + "a  " * 60 + "y",
    "<table><tr><td colspan=5000>w<td>x</table>": "w  x",
    "<details><summary>s</summary>no<p>no<summary>no</summary></details>t": "s\nt",
    "<details open><summary>s</summary>shown</details>t": "s\nshown\nt",
    "<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>": "b",
    "<div style='display:none'>a<b style='display:block; visibility:visible'>b</b></div>c": "c",
    "<pre>\nx\n y</pre>": "x\n y",
    "<pre>\n\nx</pre>": "x",
    "<textarea>\na  b</textarea>": "a  b",
    "<style>.off, em {display:none} p.x { color: red; visibility: hidden } @media print { div { display:none } }</style><p class='a off'>no<p class=x>no<div>yes <em>no</em></div>": "yes",
    "<style>/* .a{display:none} */ #b{display:none} .a > i {display:none}</style><p class=a>a <i>i</i><p id=b>no": "a i",
    "<style>p{display:none}</style><p>no</p><p style='display:block'>yes</p>": "yes",
    "é a\x0bb": "é a\x0bb",
    "e a\x0bb": "e a\x0bb",
    "é b  c": "é b c",
    "<p class=one class=off>a": "a",
}


@pytest.mark.parametrize("html", CASES)
def test_rules(html):
    assert html_text.visible_text(html) == CASES[html]


def page(r, shown, depth=0):
    """A random piece of a page, and the words of it that are shown."""
    html, words = [], []
    for _ in range(r.randint(1, 4)):
        if depth > 4 or r.random() < 0.4:
            w = "".join(r.choice("abcdefghé") for _ in range(5)) + str(r.randint(0, 10**6))
            html.append(r.choice([" ", "\n", "<br>", " &nbsp; "]) + w + r.choice([" ", "\n"]))
            words += [w] if shown == "yes" else []
            continue
        kind = r.choice(["div", "span", "ul", "table", "hide", "off", "unseen", "seen", "details", "p", "script", "blockquote", "ol"])
        state = {"hide": "no", "off": "no", "details": "no"}.get(kind, shown)
        state = "no" if shown == "no" else "dim" if kind == "unseen" else "yes" if kind == "seen" else state
        if kind in ("ul", "ol"):
            parts = [page(r, state, depth + 1) for _ in range(r.randint(1, 3))]
            html.append(f"<{kind}>" + "".join("<li>" + p[0] + r.choice(["", "</li>"]) for p in parts) + f"</{kind}>")
        elif kind == "table":
            parts = [page(r, state, depth + 1)]  # one cell: lines of neighbouring cells are mixed
            html.append("<table><tr><td>" + parts[0][0] + r.choice(["</table>", "</td></tr></table>"]))
        elif kind == "script":
            html.append("<script>var a = '<p>no</p>';</script><!-- <b>no</b> -->")
            parts = []
        else:
            parts = [page(r, state, 9 if kind == "p" else depth + 1)]  # a block would end the paragraph and all in it
            start, end = {
                "hide": ("<div hidden>", "</div>"), "off": ("<section class='big off'>", "</section>"), "unseen": ("<div style='visibility:hidden'>", "</div>"),
                "seen": ("<i style='visibility:visible'>", "</i>"), "details": ("<details><summary></summary>", "</details>"), "p": ("<div><p>", "</div>"),
            }.get(kind, (f"<{kind}>", f"</{kind}>"))
            html.append(start + parts[0][0] + end)
        for p in parts:
            words += p[1]
    return "".join(html), words


@pytest.mark.parametrize("seed", range(60))
def test_all_that_is_shown_and_nothing_else(seed):
    r = random.Random(seed)
    html, words = page(r, "yes")
    got = html_text.visible_text("<html><head><style>.off { display: none }</style><title>no</title></head><body>" + html)
    assert [w.strip(" ") for w in got.split() if any(c.isdigit() for c in w) and len(w) > 4] == words


@pytest.mark.parametrize("seed", range(30))
def test_cells_stand_where_a_grid_of_slots_has_them(seed):
    r = random.Random(seed)
    rows = [[([f"c{i}x{j}"], r.choice([1, 1, 2, 3]), r.choice([1, 1, 2, 4])) for j in range(r.randint(0, 5))] for i in range(8)]
    taken, want = set(), []
    for i, row in enumerate(rows):
        at, found = 0, []
        for lines, columns, deep in row:
            while (i, at) in taken:
                at += 1
            taken |= {(i + a, at + b) for a in range(deep) for b in range(columns)}
            found.append((lines, at, at + columns))
            at += columns
        want.append(found)
    assert html_text.placed(rows) == want


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, "<p>b")], "page_id long, url string, html string")
    assert sorted((str(x.page_id), x.text, x.n_lines) for x in html_text.digests(df).collect()) == [("1", "a", 1), ("1", "a", 1), ("None", "b", 1)]
