"""Pages unlike those that the extractor learns from, written by hand."""

from __future__ import annotations

import pytest

from echograph.llm import html

L = "Long words here. " * 10


def W(body):
    return f"<html><body>{body}</body></html>"



SHAPES = [
    (W(f"<article><p>One.</p><p>Two sentence here.</p><p>{L}</p></article>"), ["One.","Two sentence here.",L.strip()]),
    (W("<article><p>"+"nine char "*9+"</p></article>"), [("nine char "*9).strip()]),
    ("<article><p>Hello, it's me</p><p>Next one's here</p></article>", ["Hello, it's me","Next one's here"]),
    (W(f"<article><header><h1>A headline of this</h1></header><p>{L}</p><p>And so it ended.</p></article>"), ["A headline of this",L.strip(),"And so it ended."]),
    (W(f"<article><h1>Title</h1><p>{L}</p><footer>Posted in News</footer></article>"), ["Title",L.strip()]),
    (W(f"<table><tr><td><a href='/'>Home</a> <a href='/n'>News</a> <a href='/c'>Contact</a></td><td><p>{L}</p><p>Second part of it.</p></td></tr></table>"), [L.strip(),"Second part of it."]),
    (W(f"<main><p>{L}</p><p>Short end.</p></main>"), [L.strip(),"Short end."]),
    (W(f"<p>{L}</p><p>Short middle.</p><p>{L}</p>"), [L.strip(),"Short middle.",L.strip()]),
    (W(f"<article>{L}</article>"), [L.strip()]),
    (W(f"<nav><a href='/'>Home</a> <a href='/x'>About</a></nav><main><h1>Title here</h1><p>{L}</p></main><footer>© 2020 Us</footer>"), ["Title here",L.strip()]),
    (W(f"<div><p>{L}</p><p>{L}</p></div>"), [L.strip()]*2),
    (W(f"<header><h1>My Site</h1></header><article><h2>Story</h2><p>{L}</p></article><section class='comments'><p>Nice one, thanks for it!</p></section>"), ["Story",L.strip()]),
]


@pytest.fixture(scope="module")
def chain():
    return html.train()


@pytest.mark.parametrize(("page", "main"), SHAPES)
def test_plain_shapes(chain, page, main):
    assert html.main_text(page, chain) == "\n\n".join(main)


def test_repeated_blocks_stay(chain):
    page = W(f"<article><h1>Title here</h1><p>{L}</p><p>{L}</p><p>{L}</p></article>")
    assert html.main_text(page, chain) == "\n\n".join(["Title here", *[L.strip()] * 3])


def test_pages_made_from_another_seed(chain):
    held = html.labelled_pages(150, 77)
    right = sum("\n\n".join(" ".join(x.split()) for x in main) == html.main_text(page, chain) for page, main in held)
    assert right / len(held) > 0.85
