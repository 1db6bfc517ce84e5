"""Shapes of pages: what frames, classes and neighbours of an article may look like, with the text that must come out."""

from __future__ import annotations

import pytest

from attesta.llm import html_text

LONG = "A story with commas, names, and dates goes on for some time, as stories do, and holds what readers came for, in whole sentences. " * 3
TWO = [LONG.strip() + " First.", LONG.strip() + " Second."]
BODY = "".join(f"<p>{t}</p>" for t in TWO)
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'
FOOT = "<footer><p>All rights reserved, and so on, by the people of this site.</p></footer>"
SIDE = '<div class="sidebar"><h3>More stories</h3><p>Another story, with commas, that is not this one, is told elsewhere on this site.</p></div>'
REMARK = '<div id="comments"><h2>Comments</h2>' + "".join(f"<p>Reader {k} says that this is great, really, and that they liked it a lot.</p>" for k in range(3)) + "</div>"
FRAMES = {
    "article": "<article>{}</article>",
    "main": "<main>{}</main>",
    "section in main": "<main><section><div>{}</div></section></main>",
    "entry without a sidebar": '<div class="entry-content no-sidebar">{}</div>',
    "frame named after its parts": '<div id="content-sidebar-wrap"><article>{}</article></div>',
    "open to comments": '<article class="post comments-open">{}</article>',
    "closed to comments": '<div class="post comments-closed">{}</div>',
    "promoted story": '<div class="story promo-top">{}</div>',
    "has a sidebar": '<div class="has-sidebar layout"><div>{}</div></div>',
    "with adverts": '<div class="with-ads content">{}</div>',
    "shared frame": '<div class="main-sidebar-container"><div class="post">{}</div></div>',
    "sponsored post": '<div class="sponsored"><div class="copy">{}</div></div>',
    "reply page": '<div class="reply"><div>{}</div></div>',
    "newsletter issue": '<div class="newsletter"><div id="issue">{}</div></div>',
    "related in name": '<div class="related-reading"><div>{}</div></div>',
    "search result shown whole": '<div id="search-page"><div>{}</div></div>',
    "modal turned page": '<div class="modal"><div class="overlay"><div>{}</div></div></div>',
    "no classes": "<div><div>{}</div></div>",
    "old table": "<table><tr><td>{}</td></tr></table>",
    "hidden until scripts run": '<div class="hidden js"><div class="text">{}</div></div>',
}
AROUND = {
    "alone": "{}",
    "menu and footer": MENU + "{}" + FOOT,
    "all around": MENU + '<div class="cookie-banner"><p>We use cookies, many of them, to serve you better, as they say.</p></div>{}' + SIDE + REMARK + FOOT,
}


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("frame", FRAMES)
def test_frames(frame, around):
    page = f'<html><head><title>T</title></head><body class="no-sidebar comments-open">{AROUND[around].format(FRAMES[frame].format(BODY))}</body></html>'
    assert html_text.main_text(page).split("\n\n") == TWO


@pytest.mark.parametrize("inside", [
    REMARK, SIDE, FOOT, MENU, '<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Mail</a></div>', '<form><p>Your mail address, please, and your name too.</p></form>',
    '<div class="advert"><p>Buy this, now, it is cheap, and good, they say.</p></div>', "<script>var x = '<p>no</p>';</script>", '<aside><p>An aside, with commas, of the site.</p></aside>',
    '<div class="post-comments"><p>One reader says that this is great, really, and more.</p></div>', '<div role="navigation"><p>Next, previous, first, last.</p></div>',
    '<div style="display: none"><p>Hidden words, with commas, for machines.</p></div>', '<div hidden><p>Hidden words, with commas, for machines.</p></div>',
    '<div id="newsletter-signup"><p>Get our mail, each day, for free, for ever.</p></div>', '<ul class="pagination"><li>1</li><li>2</li></ul>', "<!-- <p>A comment, with commas.</p> -->",
])
@pytest.mark.parametrize("frame", ["article", "no classes", "open to comments", "promoted story"])
def test_what_is_inside_but_no_part(frame, inside):
    for content in (BODY + inside, f"<p>{TWO[0]}</p>{inside}<p>{TWO[1]}</p>"):
        assert html_text.main_text(f"<html><body>{FRAMES[frame].format(content)}</body></html>").split("\n\n") == TWO


def test_many_comments_stay_out_of_a_short_article():
    remarks = '<section class="comments">' + f"<p>{LONG}</p>" * 4 + "</section>"
    for frame in ("article", "main", "no classes"):
        page = f"<html><body>{MENU}{FRAMES[frame].format(BODY)}{remarks}{FOOT}</body></html>"
        assert html_text.main_text(page).split("\n\n") == TWO
