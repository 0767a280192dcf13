"""Word rules, very deep pages and the tag-path ratios of the page extraction, the last against a plain recount."""

import random
import time
from xml.etree import ElementTree

import pytest

from cohortlake.llm import htmltext

STORY = "".join(f"<p>Paragraph {i} of the story tells, in plain words, what was seen. It goes on for a while.</p>" for i in range(6))
OTHER = "<p>Some other words stand here, and they say little. They were written by somebody.</p>"


@pytest.mark.parametrize("names", ["class='comment-body'", "class='cookie-content'", "class='ad-container'", "id='sidebar-wrapper'", "class='commentary'", "class='ad comments x'"])
def test_named_boilerplate_beside_the_article_is_left_out(names):
    beside = htmltext.main_text(f"<html><body><div class='post'>{STORY}</div><div {names}>{OTHER}</div></body></html>")
    within = htmltext.main_text(f"<html><body><article>{STORY}<div {names}>{OTHER}</div></article></body></html>")
    for text in (beside, within):
        assert text.count("Paragraph") == 6 and "other words" not in text


@pytest.mark.parametrize("names", ["hidden-gems", "rail travel", "menu recipe", "content-sidebar-wrap", "container has-sidebar", "commentary"])
def test_words_do_not_lose_the_only_article(names):
    assert htmltext.main_text(f"<body><div class='{names}'>{STORY}</div></body>").count("Paragraph") == 6


def test_an_article_with_a_menu_beside_it_stays():
    text = htmltext.main_text(f"<body><div id='x'>Home Places Contact</div><div class='hidden-gems'>{STORY}</div><div class='comments'>{OTHER}</div></body>")
    assert text.count("Paragraph") == 6 and "other words" not in text


def test_comments_alone_and_notices_alone():
    assert htmltext.main_text(f"<body><div class='cookie-notice'>{OTHER}</div></body>") == ""
    assert htmltext.main_text("") == ""


def test_very_deep_pages():
    began = time.time()
    assert htmltext.main_text("<div>" * 100_000 + "text of it." + "</div>" * 100_000) == "text of it."
    assert htmltext.main_text("<div><p>a b c.</p>" * 4000 + "</div>" * 4000).count("a b c.") == 4000
    htmltext.main_text("<div class='ad comment x'><b>" * 20_000 + "</i>" * 3000)
    assert time.time() - began < 60  # work in proportion to the page


def _page(rng: random.Random, depth: int = 0) -> str:
    if depth == 3 or rng.random() < 0.3:
        return f"<p class='{rng.choice(['lead', 'tale', ''])}'>{' '.join(rng.choice(['word', 'word,', 'end.', 'x']) for _ in range(rng.randint(1, 30)))}</p>"
    return f"<div class='{rng.choice(['alpha', 'beta', ''])}'>{''.join(_page(rng, depth + 1) for _ in range(rng.randint(1, 4)))}</div>"


def test_paths_equal_a_recount_over_the_parsed_page():
    rng = random.Random(3)
    for _ in range(150):
        page = f"<html><body>{''.join(_page(rng) for _ in range(3))}</body></html>"
        leaves: list[tuple[tuple, str]] = []

        def walk(node, path):
            path = (*path, (node.tag, node.get("class") or ""))
            if node.tag == "p":
                leaves.append((path, node.text))
            for child in node:
                walk(child, path)

        walk(ElementTree.fromstring(page), ())
        order = list(dict.fromkeys(path for path, _ in leaves))
        ratio = []
        for path in order:
            texts = [t for p, t in leaves if p == path]
            ratio.append(sum(map(len, texts)) / len(texts) * (1 + sum(t.count(",") + t.count(".") for t in texts) / len(texts)))
        at = range(len(order))
        smooth = [(ratio[max(i - 1, 0)] + 2 * ratio[i] + ratio[min(i + 1, len(order) - 1)]) / 4 for i in at]
        want = [t for p, t in leaves if smooth[order.index(p)] >= htmltext.THRESHOLD * max(smooth) - 1e-9]
        found = htmltext.blocks(page)
        chosen = htmltext.content_paths(found, htmltext.THRESHOLD)
        assert [t for _, t, _ in found] == [t for _, t in leaves]
        assert [t for e, t, _ in found if e.path in chosen] == want
