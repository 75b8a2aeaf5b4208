"""Words of hand-made pages of several makes: how many of the main text are kept, and how many of what is kept belong to it."""

import re
import time
from collections import Counter

import pytest

from ravelin.llm.html_text import blocks_of, main_text, stretches

LONG = "The {n} part of the story is told in plain words that go on for a while, so that the line is long enough to count as text of the page."
OTHER = "Somebody else wrote this {n} remark that goes on for quite some time and would pass for a paragraph of the story by its length alone."


def paragraphs(*names):
    return "".join(f"<p>{LONG.format(n=n)}</p>" for n in names)


MENU = "<nav><ul>" + "".join(f"<li><a href='/{n}'>menuword {n}</a></li>" for n in ("home", "news", "sport")) + "</ul></nav>"
FOOT = f"<footer><p>footword {OTHER.format(n='legal')}</p></footer>"

#: The page, and words that only its main text or only the rest has come by (the main text's are those of LONG and capitals).
PAGES = {
    "article with everything around": f"<html><head><title>t</title></head><body>{MENU}<header><h2>Site</h2></header><main><article><h1>HEADLINE</h1>{paragraphs('first', 'second')}<ul><li>SHORT ITEM</li><li>OTHER ITEM</li></ul>{paragraphs('third')}</article></main><aside><p>{OTHER.format(n='side')}</p></aside>{FOOT}</body></html>",
    "comments as articles": f"<body>{MENU}<article><h1>HEADLINE</h1>{paragraphs('first', 'second')}<section class='comments'><article><p>{OTHER.format(n='reader')}</p></article><article><p>{OTHER.format(n='second')}</p></article></section></article>{FOOT}",
    "comment list of a blog": f"<body><div id='content'><article class='post type-post hentry'><h1>HEADLINE</h1>{paragraphs('first', 'second', 'third')}</article><div id='comments'><ol class='comment-list'><li class='comment'><article class='comment-body'><p>{OTHER.format(n='reader')}</p></article></li></ol></div></div>{FOOT}",
    "related teasers within": f"<body><main><article><h1>HEADLINE</h1>{paragraphs('first')}<div class='related'><article><h3>other</h3><p>{OTHER.format(n='teaser')}</p></article></div>{paragraphs('second')}</article></main>",
    "divisions only": f"<body><div class='topbar'>menuword menuword</div><div id='page'><div class='entry'><h1>HEADLINE</h1>{paragraphs('first', 'second')}<h2>SECTION</h2>{paragraphs('third')}</div><div class='sidebar'><p>{OTHER.format(n='side')}</p></div></div><div class='footer'>footword</div>",
    "end tags left out": f"<nav><p>menuword<main><h1>HEADLINE</h1><p>{LONG.format(n='first')}<p>{LONG.format(n='second')}<dl><dt>TERM<dd>MEANING</dl></main><footer>footword",
    "a table as frame": f"<table><tr><td class='menu'>menuword<td><h1>HEADLINE</h1>{paragraphs('first', 'second', 'third')}</table>",
    "advert and share bar between": f"<article><h1>HEADLINE</h1>{paragraphs('first')}<div class='advert'><p>{OTHER.format(n='advert')}</p></div><div class='share-buttons'>menuword</div>{paragraphs('second')}<form><p>{OTHER.format(n='form')}</p></form></article>",
    "a single aside with an article": f"<main>{paragraphs('first', 'second')}<aside><article><p>{OTHER.format(n='side')}</p></article></aside></main>",
}
CAPITALS = {"HEADLINE", "SHORT", "ITEM", "OTHER", "SECTION", "TERM", "MEANING"}


def wanted(page):
    """The words of LONG and those in capitals, as often as the page has them."""
    out = Counter()
    for n in re.findall(r"The (\w+) part of the story", page):
        out.update(LONG.format(n=n).split())
    out.update(w for w in re.findall(r"[A-Z]{4,}", page) if w in CAPITALS)
    return out


def between(page):
    """Surge and dive alone: the lines of the stretch with most text."""
    blocks, _ = blocks_of(page)
    lengths = [0 if linked else len(t) for t, _, linked in blocks]
    found = stretches(lengths)
    low, high = max(found, key=lambda s: sum(lengths[s[0] : s[1]])) if found else (0, len(blocks))
    return "\n\n".join(t for t, *_ in blocks[low:high])


def measured(extract):
    kept = right = all_ = 0
    for page in PAGES.values():
        got, gold = Counter(extract(page).split()), wanted(page)
        kept, all_ = kept + sum(got.values()), all_ + sum(gold.values())
        right += sum((got & gold).values())
    return right / kept, right / all_


@pytest.mark.parametrize("name", PAGES)
def test_each_page(name):
    assert Counter(main_text(PAGES[name]).split()) == wanted(PAGES[name])


def test_words_kept_and_words_right():
    precision, recall = measured(main_text)
    alone = measured(between)
    print(f"precision {precision:.3f} recall {recall:.3f}; surge and dive alone {alone[0]:.3f} {alone[1]:.3f}")
    assert precision >= 0.98 and recall >= 0.98 and recall > alone[1]


@pytest.mark.parametrize("part", ["<!", "<a ", "<p class='", '<a "', "<!-- ", "<![CDATA[", "<a = ", "<", "<nav><article>"])
def test_hard_tokens_take_linear_time(part):
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        main_text(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_quotes_and_tags_that_never_end():
    long = LONG.format(n="only")
    assert main_text(f'<p class="x>lost</p><p class="y">{long}</p>') == long
    assert main_text(f"<p>{long}</p><p class='x>lost") == long
    assert main_text(f"<p>{long}</p><p lost") == long
    assert main_text(f"<p>it's \"{long}\"</p><!x><![CDATA[y]]>") == f"it's \"{long}\""
    assert main_text(f"<p title=it's>{long}</p>") == long
