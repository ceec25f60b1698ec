"""Chats, pages and transport streams."""

import hashlib
import os
import zlib

import pytest

from voxelweave.llm import chat, html_text, transport


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "How do I read a file?\nIt is large."),
        (1, 1, "assistant", "Use a reader.\n\nIt reads by line."),
        (1, 2, "user", "On Monday someone wrote:\n> Use a reader.\n\nWhich reader is that?"),
        (1, 3, "user", "> > How do I read a file?\n> > It is large.\n> Use a reader.\n>\n> It reads by line.\nThanks, both."),
        (1, 4, "assistant", "> Which reader is that?\nThe plain one."),
        (1, 5, "user", "> something that nobody said\nNo link."),
        (2, 0, "user", "> Use a reader.\nAnother conversation."),
        (2, 1, None, None),
        (2, 1, None, ""),
        (None, 1, "user", "> Use a reader."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.formatted(df).collect()}
    assert {k: got[1, k].parent_turn for k in range(6)} == {0: None, 1: None, 2: 1, 3: 1, 4: 2, 5: None}
    assert got[1, 4].reply_path == [1, 2, 4] and got[1, 2].own == "Which reader is that?" and got[1, 3].own == "Thanks, both."
    assert got[1, 2].chat == "<|user|>\nWhich reader is that?\n" and got[1, 5].n_quoted == 1 and got[1, 5].n_linked == 0
    assert got[2, 0].parent_turn is None and got[2, 1].own == "" and len(chat.formatted(df).collect()) == len(rows)
    order = [r.turn for r in sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: r.reply_path)]
    assert order == [0, 1, 2, 4, 3, 5]
    assert chat.formatted(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, k, "user", (f"> message number {k - 1} of all\n" if k else "") + f"message number {k} of all") for k in range(40)]
    got = {r.turn: r.reply_path for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[39] == list(range(40))


CASES = {
    "Hello <b>bold</b>!<p>One<p>Two <br>lines": "Hello bold!\n\nOne\n\nTwo\nlines",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>": "- a\n- b\n  3. c\n  4. d",
    "<table><tr><td>a<td>bbbb<tr><th>ccc<td>d<br>e</table>": "a    bbbb\nccc  d\n     e",
    "<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>": "wide cell  x\na  b       c",
    "<div hidden>no</div><div style='color:red; display: none'>no</div>yes<script>var a = '</p>'</script><!-- c -->": "yes",
    "<head><title>t</title></head><pre>  x\n   y</pre>tail &amp; end": "  x\n   y\n\ntail & end",
    "<p>a</div></span> b": "a b",
    "<select><option>a<option>b</select>": "a\nb",
    "a<table><tr><td>x<p>y</table>b": "a\n\nx\n\ny\n\nb",
    "": "",
    "a < b &lt; c": "a < b < c",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert html_text.visible_text(html) == CASES[html]


def test_depth_and_operator(spark):
    assert html_text.visible_text("<div>" * 20_000 + "x") == "x" and html_text.visible_text("<table><tr><td>" * 300 + "x") == "x"
    df = spark.createDataFrame([(1, "u", "<p>a<p>b"), (2, "u", None), (3, None, "")], "page_id long, text string, html string")
    got = {r.page_id: (r.text, r.n_lines) for r in html_text.extract(df).collect()}
    assert got == {1: ("a\n\nb", 3), 2: ("", 0), 3: ("", 0)} and html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [64, 128, 150, 152, *range(158, 188), 4096, 4097, 4096 * 9, 100_000])
def test_streams_round_trip(n):
    x = os.urandom(n)
    found = transport.read(transport.write(x))
    assert found.payload == x and not found.continuity_errors and not found.bad_sections and all(u[3] for u in found.units)
    assert [u[0] for u in found.units] == [k * transport.TICKS for k in range(-(-n // transport.UNIT))] and [k for k, u in enumerate(found.units) if u[1]] == list(range(0, len(found.units), transport.RANDOM))


def test_broken_streams():
    m = transport.write(os.urandom(50_000))
    lost = transport.read(m[: 188 * 10] + m[188 * 11 :])
    assert lost.continuity_errors == 1 and not lost.units[0][3] and lost.units[1][3]
    assert transport.read(m[: 188 * 5] + m[188 * 4 :]).continuity_errors == 0  # a packet sent twice
    assert transport.read(b"").units == [] and transport.section_crc(b"123456789") == 0x0376E6E7
    for bad in (m[:-1], b"\0" * 188):
        with pytest.raises(ValueError):
            transport.read(bad)


def test_stream_operators(spark, docs_of):
    texts = ["é" * 70, None, "", "x" * 200_000]
    df = docs_of(texts, media="clash")
    for r in transport.digests(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    back = {r.doc_id: bytes(r.payload) for r in transport.decode(transport.encode(df)).collect()}
    assert back[0].rstrip(b"\0").decode() == texts[0] and back[1] == b"\0" * 64
    assert transport.digests(df.limit(0)).count() == 0
