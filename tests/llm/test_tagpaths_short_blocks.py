"""Articles with many short blocks: tables, lists and reference lists, however long."""

import pytest

from beamspark.llm import tagpaths
from beamspark.llm.tagpaths import main_text

WORDS = "A paragraph of usual length, with marks. "
BODY = [(WORDS * 8).strip() for _ in range(10)]
MADE = {
    "cells": lambda n: ("<table>" + "".join(f"<tr><td>c{i:05}</td></tr>" for i in range(n)) + "</table>", [f"c{i:05}" for i in range(n)]),
    "linked items": lambda n: ("<ul>" + "".join(f"<li><a href='/{i}'>Linked item no {i:06}</a></li>" for i in range(n)) + "</ul>", [f"Linked item no {i:06}" for i in range(n)]),
    "references": lambda n: ("<ol>" + "".join(f"<li><a href='/{i}'>Author {i}</a> Title {i}</li>" for i in range(n)) + "</ol>", [f"Author {i} Title {i}" for i in range(n)]),
    "glossary": lambda n: ("<dl>" + "".join(f"<dt>term {i}<dd>sense {i}" for i in range(n)) + "</dl>", [x for i in range(n) for x in (f"term {i}", f"sense {i}")]),
}


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("kind", MADE)
def test_all_blocks_of_the_article_stay(kind, tag):
    for n in (1, 60, 400, 3000):
        source, texts = MADE[kind](n)
        paragraphs = [f"<p>{x}</p>" for x in BODY]
        page = f"<body><{tag}>{''.join(paragraphs[:5])}{source}{''.join(paragraphs[5:])}</{tag}></body>"
        assert main_text(page) == "\n".join([*BODY[:5], *texts, *BODY[5:]])


def test_ratios_do_not_depend_on_how_often_a_path_occurs():
    block = tagpaths.Block(1, 0, "short, cell", 3)
    assert tagpaths.ratios([block], "path") == tagpaths.ratios([block] * 500, "path") == {1: (8, 2)}


def test_long_lists_without_a_frame():
    for n in (10, 30, 300):
        items = "".join(f"<li>An item of some forty characters, no {i:05}" if i % 50 == 0 else f"<li>An item of about forty characters no {i:05}" for i in range(n))
        text = main_text(f"<body>{''.join(f'<p>{x}</p>' for x in BODY)}<ul>{items}</ul></body>")
        assert text.count("An item of") == n
